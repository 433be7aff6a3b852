"""Converters on small raw rows."""

from pyspark.sql import functions as F

from braidwork.operators import convert
from braidwork.operators.relations import triples
from braidwork.sources.schema import NORMALISED


def rels(df):
    return sorted((r.rel, r.head, r.tail) for r in triples(df).collect())


def test_maven(spark):
    ev = [("e1", "T", [("m1", "fire", 0, [0, 1])]), ("e2", None, None), (None, "T", []), ("", "T", [])]
    rows = [
        ("train", "t", None, ["A fire .", "It spread ."], ev, {"CAUSE": [["e1", "e2"], ["e1", "zz"]], "PRECONDITION": []}),
        ("dev", None, [["Only", "tokens"]], None, ev, {"CAUSE": [["e2", "e1"]]}),
        ("train", "nothing", None, None, None, {"CAUSE": []}),
    ]
    df = spark.createDataFrame(rows, "split string, " + convert.MAVEN.removeprefix("id string, ").replace("tokens array<array<string>>, sentences array<string>", "tokens array<array<string>>, sentences array<string>"))
    out = convert.convert("maven_ere", df)
    assert out.columns == list(NORMALISED) and out.count() == 2
    got = {r.text: r for r in out.collect()}
    a, b = got["A fire . It spread ."], got["Only tokens"]
    assert a.relations == {"CAUSE": [["e1", "e2"]], "PRECONDITION": []} and set(a.entities) == {"e1", "e2"} and a.tokens[0] == ["A", "fire", "."]
    assert b.title == b.document_id and b.document_id.startswith("MAVEN_ERE - ") and b.sentences == ["Only tokens"]
    assert convert.maven(df, keep_empty=True).count() == 3
    s = spark.createDataFrame([("x/Train.jsonl",), ("x/valid.jsonl",), ("a/TEST.x",), ("train/other",)], "p string").select(convert.split_of(F.col("p")).alias("s"))
    assert [r.s for r in s.collect()] == ["train", "validation", "test", "unknown"]
    assert convert.convert("maven_ere", df, truncate=1).count() == 1


def test_docred(spark):
    rows = [("dev", "t", [["Bonn", "is", "in", "Germany"], ["It", "is"]], [[("Bonn", [0, 1], 0, "LOC"), ("It", [0, 1], 1, "LOC")], [("Germany", [3, 4], 0, None)], []], [(0, 1, "P17", [0]), (1, 0, "P9", []), (0, 9, "P17", [])]), ("test", None, [["x"]], [], None)]
    df = spark.createDataFrame(rows, "split string, " + convert.DOCRED)
    out = convert.docred(df, spark.createDataFrame([("P17", "country")], "r string, name string"))
    assert {r for r, _, _ in rels(out)} == {"P17 : country", "P9"} and len(rels(out)) == 2 and out.count() == 2
    d = out.where("type = 'dev'").first()
    ms = {k: [m.trigger_word for m in v.mentions] for k, v in d.entities.items()}
    assert sorted(ms.values()) == [["Bonn", "It"], ["Germany"]] and all(k.startswith("Event_") and len(k) == 18 for k in ms)
    assert convert.docred(df, spark.createDataFrame([], "r string, name string"), keep_empty=False).count() == 1


def test_event_spans(spark):
    tok = [("f", i + 1, s, n, w) for i, (s, n, w) in enumerate([(0, 0, "A"), (0, 1, "huge"), (0, 2, "fire"), (1, 0, "began"), (1, 1, "today")])]
    tokens = spark.createDataFrame(tok, "file string, t_id int, sentence int, number int, text string")
    links = spark.createDataFrame([("f", "2_3", "4", "PRECONDITION"), ("f", "2_99", "4", "X"), ("f", "3_4", "5", "Y")], "file string, source string, target string, relation string")
    out = convert.eventstoryline(tokens, links, "train").first()
    assert out.tokens == [["A", "huge", "fire"], ["began", "today"]] and set(out.relations) == {"PRECONDITION", "Y"}
    m = {v.mentions[0].trigger_word: v.mentions[0] for v in out.entities.values()}
    assert (m["huge fire"].sent_id, m["huge fire"].offset) == (0, [1, 3]) and m["fire began"].sent_id == 0 and set(m) == {"huge fire", "began", "fire began", "today"}


def test_fincausal(spark):
    rows = [("<e1>Rates rose</e1> and <e2>shares fell</e2>.", None, None), ("Sales fell due to rain", "rain", "Sales fell"), (" ", "a", "b"), ("No pair here", None, "pair here")]
    out = convert.fincausal(spark.createDataFrame(rows, "Text string, Cause string, EFFECT string"))
    got = {r.text: r for r in out.collect()}
    assert set(got) == {"Rates rose and shares fell.", "Sales fell due to rain", "No pair here"}
    a = got["Rates rose and shares fell."]
    m = {v.type: v.mentions[0] for v in a.entities.values()}
    assert (m["CAUSE"].trigger_word, m["CAUSE"].offset) == ("Rates rose", [0, 2]) and (m["EFFECT"].trigger_word, m["EFFECT"].offset) == ("shares fell", None)
    b = got["Sales fell due to rain"]
    assert {v.type: v.mentions[0].offset for v in b.entities.values()} == {"CAUSE": [4, 5], "EFFECT": [0, 2]} and len(b.relations["CAUSE"]) == 1
    assert got["No pair here"].relations == {"CAUSE": []} and len(got["No pair here"].entities) == 1
    t = spark.createDataFrame([(" x <e1>ab</e1> <e2>c</e2>",)], "s string").select(convert.tagged(F.col("s"), "e2").alias("t")).first().t
    assert (t.start, t.end, t.text) == (5, 6, "c")


def test_causalbank(spark):
    stems = lambda ws: [r.s for r in spark.createDataFrame([(w,) for w in ws], "w string").select(convert.stem(F.col("w")).alias("s")).collect()]
    assert stems(["Raining,", "flooded", "boxes", "is", "quickly", "cats!", "sing", "..."]) == ["rain", "flood", "box", "is", "quick", "cat", "sing", ""]
    lines = spark.createDataFrame([("raining->floods\t3\ta\tb",), ("two words->x\t1",), ("no arrow",), ("heat->fires",)], "value string")
    pairs = convert.lexicon(lines)
    assert sorted(map(tuple, pairs.collect())) == [("heat", "fir"), ("rain", "flood")]
    rows = spark.createDataFrame([("f", 1, "causes", "Heavy rain", "a flood"), ("f", 2, "x", "nothing", "here"), ("f", 3, "x", "", "y"), ("f", 4, "so", "the heat", "many fires"), ("f", 5, "so", "rain", "flood")], "file string, line int, connector string, p1 string, p2 string")
    out = convert.causalbank(rows, pairs, 0, 3)
    assert sorted(r.text for r in out.collect()) == ["Heavy rain causes a flood", "the heat so many fires"]
    d = out.where("text like 'Heavy%'").first()
    assert {v.lemma: (v.mentions[0].text, v.mentions[0].token_id) for v in d.entities.values()} == {"rain": ("rain", 1), "flood": ("flood", 4)} and len(d.relations["causal_relation"]) == 1
    assert [r.text for r in convert.causalbank(rows, pairs, 3).collect()] == ["rain so flood"]


def test_gold(spark):
    links = spark.createDataFrame([("f", "5_6", "2", "PRECONDITION"), ("f", "1", "1_2", "X")], "file string, source string, target string, relation string")
    chains = spark.createDataFrame([("f", "5_6", "5_6"), ("f", "5_6", "1")], "file string, span string, member string")
    assert sorted((r.source, r.target, r.relation) for r in convert.merged_gold(links, chains).collect()) == [("1", "2", "PRECONDITION"), ("2", "5_6", "FALLING_ACTION")]
    lines = spark.createDataFrame([("d", 1, "s", [1, 2]), ("d", 1, "t", [9])], "doc_id string, line int, side string, t_ids array<int>")
    anchors = spark.createDataFrame([("d", "e1", 0, [2]), ("d", "e2", 1, [1, 2]), ("d", "e3", 2, [1, 2])], "doc_id string, event_id string, pos int, t_ids array<int>")
    assert sorted(((r.side, r.event_id) for r in convert.aligned(lines, anchors).collect()), key=str) == [("s", "e2"), ("t", None)]
    e = spark.createDataFrame([("d", "a", "b", "R"), ("d", "a", "b", "R")], "doc_id string, source string, target string, relation string")
    assert convert.gold_union(e, e).count() == 1
    docs = spark.createDataFrame([("d", {"P17 : x": [["a", "b"]], "own": []})], "document_id string, relations map<string,array<array<string>>>")
    assert convert.schema_of(docs, spark.createDataFrame([("P17", "country"), ("P1", "z")], "r string, name string")).first().types == ["P1 : z", "P17 : country", "own"]
