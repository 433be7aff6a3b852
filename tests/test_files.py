"""Readers and writers on small files, configuration."""

import json

import pytest
from pyspark.sql import functions as F

from braidwork.plans.pipeline import evaluate_files, run_config
from braidwork.operators import strategies
from braidwork.sources import files, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    p = write(tmp_path / "d.jsonl", '{"id":"a","text":"x","type":"train","relations":{"R":[["h","t"]]}}\n{bad\n{"document_id":"b","text":"y","type":"test"}\n{"id":"a","text":"z","type":"train","relations":{"R":[]}}\n{"text":"no id"}\n')
    gold = {r.document_id: r.relations for r in files.gold_relations(spark, p).collect()}
    assert gold == {"a": {"R": []}, "b": {}}
    assert [r.text for r in files.slice_of(spark, p, ["train", "test"], 1, 1).collect()] == ["y"]
    assert {r.document_id: r.text for r in files.field(spark, p, "text").collect()} == {"a": "z", "b": "y"}
    with pytest.raises(Exception, match="each row needs an id"):
        files.documents(spark, p).collect()
    ok = write(tmp_path / "ok.jsonl", '{"id":"a","text":"x"}\n{"document_id":"b","text":""}\n')
    assert sorted(r.id for r in files.documents(spark, ok).collect()) == ["a", "b"]


def test_evaluation_of_files(spark, tmp_path):
    g = write(tmp_path / "g.jsonl", '{"document_id":"1","relations":{"A":[["x","y"],["u","v"]]}}\n{"document_id":"3","relations":{"null":[["q","r"]]}}\n')
    p = write(tmp_path / "p.jsonl", '{"document_id":"1","pred_relations":{"A":[["x","y"],["x","y"]]}}\n{"document_id":"2","pred_relations":{"A":[["x","y"]]}}\n{"document_id":"3","pred_relations":{}}\n')
    s, c = evaluate_files(spark, g, p)
    r = s.where("total").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 0, 2, 1.0, 1 / 3) and tuple(c.first()) == (3, 2, 1)
    assert evaluate_files(spark, g, p, ignore=("null",))[0].where("total").first().f1 == pytest.approx(0.666667, abs=1e-6)


SHAPES = [
    '{"document_id":"D","triples":[["a","R","b"],{"h":"c","r":"S","t":"d"}]}',
    '{"doc_id":"E","kg_triples":[{"source":"a","target":"b"}]}',
    '{"graph":{"edges":[["a","R","b",{"document_id":"F","sentence_id":"s1","text":"said"}]]}}',
    '{"edges":[{"head":"a","relation":"R","tail":"b","meta":{"document_id":"G"}}]}',
    '{"H":[["a","R","b"]],"I":[["c","R","d"]]}',
    '[{"document_id":"J","edges":[["a","R","b"]]},["x","R","y"]]',
    '{"head":"a","rel":"R","tail":"b"}',
    "not json",
]


def test_graph_shapes(spark, tmp_path):
    df = spark.createDataFrame([(s,) for s in SHAPES], "value string").coalesce(1)
    got = sorted(((r.document_id or ""), r.head, r.rel, r.tail) for r in files.graph_edges(df).collect())
    assert got == sorted([("D", "a", "R", "b"), ("D", "c", "S", "d"), ("E", "a", "RELATED", "b"), ("F", "a", "R", "b"), ("G", "a", "R", "b"), ("H", "a", "R", "b"), ("I", "c", "R", "d"), ("J", "a", "R", "b"), ("", "x", "R", "y"), ("", "a", "R", "b")])
    f = files.graph_edges(df).where("document_id = 'F'").first()
    assert (f.sentence_id, f.text) == ("s1", "said")
    named = files.unknown_documents(files.graph_edges(df)).where("document_id = 'unknown_doc'").collect()
    assert sorted(r.sentence_id for r in named) == ["unknown_doc::edge_0", "unknown_doc::edge_1"]
    whole = write(tmp_path / "g.json", json.dumps(json.loads(SHAPES[0]), indent=1))
    lines = write(tmp_path / "g.jsonl", SHAPES[0] + "\n" + SHAPES[6] + "\n")
    assert files.graph_file(spark, whole).count() == 2 and files.graph_file(spark, lines).count() == 3


def test_tables(spark, tmp_path):
    t = write(tmp_path / "c.tsv", "cause\teffect\nrain\tflood\n\tx\nheat\tfire\n")
    assert [(r.document_id, r.text) for r in files.cause_effect(spark, t).orderBy("document_id").collect()] == [("causalbank_0", "rain -> flood"), ("causalbank_1", " -> x"), ("causalbank_2", "heat -> fire")]
    a = write(tmp_path / "a.csv", "Index;Text;Cause\n1;a, b;c\n;;\n")
    df = files.sniffed_csv(spark, a)
    assert df.columns == ["index", "text", "cause"] and [r.text for r in df.collect()] == ["a, b"]
    b = write(tmp_path / "b.csv", "Text,Effect\nx;y,z\n")
    assert files.sniffed_csv(spark, b).first().effect == "z"


def test_annotations(spark, tmp_path):
    x = write(tmp_path / "f.xml", '<Document><token t_id="1" sentence="0" number="0">The</token><token t_id="2" sentence="0" number="1">fire</token><Markables><ACTION_OCCURRENCE m_id="7"><token_anchor t_id="2"/></ACTION_OCCURRENCE><ACTION_OCCURRENCE m_id="8"><token_anchor t_id="1"/><token_anchor t_id="2"/></ACTION_OCCURRENCE></Markables><Relations><PLOT_LINK r_id="9" relType="PRECONDITION"><source m_id="7"/><target m_id="8"/></PLOT_LINK></Relations></Document>')
    assert sorted(map(tuple, files.xml_tokens(spark, x).collect())) == [("f.xml", 1, 0, 0, "The"), ("f.xml", 2, 0, 1, "fire")]
    assert [tuple(r) for r in files.cat_links(spark, x).collect()] == [("f.xml", "9", "PRECONDITION", "7", "8")]
    assert {r.m_id: r.t_ids for r in files.cat_markables(spark, x, "ACTION_OCCURRENCE").collect()} == {"7": [2], "8": [1, 2]}
    t = write(tmp_path / "g.xml", "12_13\t15\tPRECONDITION\n\nbad line\n")
    assert [tuple(r) for r in files.span_relations(spark, t).collect()] == [("g.xml", "12_13", "15", "PRECONDITION")]


def test_config(tmp_path, monkeypatch):
    p = write(tmp_path / "config.yaml", "paths: {data: sub/x}\ntop_k: 3\n")
    assert files.config(p) == {"paths": {"data": str(tmp_path / "sub/x")}, "top_k": 3}
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    monkeypatch.chdir(inner)
    assert files.config()["top_k"] == 3
    monkeypatch.setenv("BRAIDWORK_CONFIG", str(tmp_path / "none.yaml"))
    with pytest.raises(files.ConfigurationError):
        files.config()
    assert files.newest(["a/kg.json", "a/kg__long.json", "b/kg__lonh.json"]) == "b/kg__lonh.json" and files.newest([]) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("qa", [1, 2], "out", {"f1": 0.5, "a": 1.0}), ("qa", None, "x", {"f1": 1.0})], "task_type string, evidence array<int>, output string, metrics map<string,double>")
    sinks.json_result(df.limit(1), str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text())["output"] == "out"
    with pytest.raises(ValueError, match="one row"):
        sinks.json_result(df, str(tmp_path / "two.json"))
    for _ in range(2):
        sinks.json_lines(df, str(tmp_path / "j"))
        sinks.csv_table(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    s = sinks.summary(df)
    assert s.columns == ["task_type", "n_evidence", "output", "metric_a", "metric_f1"] and [r.n_evidence for r in s.collect()] == [2, 0]
    e = spark.createDataFrame([("d", "a", "R", "b"), ("d", "b", "R", "c")], "document_id string, head string, rel string, tail string")
    sinks.graph_csv(e, str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g_nodes")).count() == 3
    g = sinks.document_graphs(e.selectExpr("document_id", "head AS id", "head AS label"), e).first().graph
    assert len(json.loads(g)["nodes"]) == 2 and json.loads(g)["edges"][0] == {"source": "a", "target": "b", "relation": "R"}
    sinks.artefacts(str(tmp_path / "art"), edges=e)
    assert spark.read.parquet(str(tmp_path / "art/edges")).count() == 2
    rows = spark.createDataFrame([("m", "d", 3, 1.234, 2.0, 0.5, "OK"), ("m", "d", 3, 1.0, 2.0, 0.5, "FAILED")], "method string, dataset string, n_eligible_documents bigint, elapsed_seconds_doc double, estimated_total_minutes double, estimated_total_co2_g double, status string")
    assert [r.x for r in rows.select(sinks.latex_row().alias("x")).collect()] == ["m & d & 3 & 1.23 & 2.00 & 0.5000 \\\\", None]


def test_run_from_configuration(spark, tmp_path):
    p = write(tmp_path / "d.jsonl", '{"id":"a","text":"the pump failed"}\n{"id":"b","text":"calm day"}\n')
    out = run_config(spark, {"documents": p, "queries": ["pump failed"], "top_k": 1, "output": str(tmp_path / "run")}, strategies.echo)
    assert out.first().evidence == "[a/a-c0] the pump failed"
    assert json.loads((tmp_path / "run/metrics.json").read_text())["tasks"] == 1
    assert out.select(F.col("n_evidence")).first()[0] == 1


def test_command_line(spark, tmp_path, capsys):
    from braidwork.__main__ import main

    assert main(["queries"]) == 0 and "eval_rollup" in capsys.readouterr().out
    assert main(["run", "eval_micro", "/root/testdata/sf0.001", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    g = write(tmp_path / "g.jsonl", '{"document_id":"1","relations":{"A":[["x","y"],["u","v"]]}}\n')
    p = write(tmp_path / "p.jsonl", '{"document_id":"1","pred_relations":{"A":[["x","y"]]}}\n')
    main(["evaluate", g, p])
    assert "P=1.0000 R=0.5000 F1=0.6667" in capsys.readouterr().out
    raw = write(tmp_path / "train.jsonl", '{"id":"1","title":"t","sentences":["A fire ."],"events":[{"id":"e1","type":"T","mention":[]},{"id":"e2","type":"T","mention":[]}],"causal_relations":{"CAUSE":[["e1","e2"]]}}\n')
    main(["convert", "maven_ere", raw, str(tmp_path / "docs")])
    assert spark.read.json(str(tmp_path / "docs")).first().type == "train"
    with pytest.raises(SystemExit):
        main(["run", "nothing", "a", "b"])


def test_registered_names(spark):
    from braidwork.functions.register import register

    assert register(spark, lambda texts: [[1.0]] * len(texts)) == ["first_json", "hash_embed", "embed"]
    r = spark.sql("SELECT first_json('x {\"a\": 1}') AS j, size(hash_embed('pump')) AS n, embed('x') AS e").first()
    assert (r.j, r.n, r.e) == ('{"a":1}', 256, [1.0])
