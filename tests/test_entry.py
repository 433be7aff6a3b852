"""The driver contract: names, columns, streams, and that the core stands without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from braidwork.streaming import incremental

ROOT = Path(__file__).resolve().parent.parent
D = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_plans(spark):
    from braidwork.plans.catalogue import QUERIES

    for name, q in QUERIES.items():
        columns = q(spark, D).columns
        assert len(columns) == len(set(columns)) > 0, name


def test_core_stands_alone():
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n == 'braidwork.llm' else f(n, *a); import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    assert not [p for p in (ROOT / "braidwork").rglob("*.py") if "llm" not in p.parts and "braidwork.llm" in p.read_text()]


def test_stream_replaces_deliveries(spark, tmp_path):
    schema = "row_id bigint, document_id string, ingested_at timestamp, relations map<string,array<array<string>>>, pred_relations map<string,array<array<string>>>"
    src = tmp_path / "in"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    from datetime import datetime

    gold = {"R": [["a", "b"], ["c", "d"]]}
    deliver([(1, "d1", datetime(2024, 1, 1), gold, {"R": [["x", "y"]]}), (2, "d2", datetime(2024, 1, 1), gold, gold), (3, "d3", datetime(2024, 1, 1), gold, None)])
    run = lambda: incremental.follow_predictions(incremental.file_stream(spark, str(src), spark.read.parquet(str(src)).schema), str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination()
    run()
    r = incremental.scores(spark, str(tmp_path / "counts")).first()
    assert (r.documents, r.tp, r.fp, r.fn) == (3, 2, 1, 4)
    deliver([(4, "d1", datetime(2024, 1, 2), gold, gold)])
    run()
    r = incremental.scores(spark, str(tmp_path / "counts")).first()
    assert (r.documents, r.tp, r.fp, r.fn) == (3, 4, 0, 2)


def test_stream_equals_batch(spark):
    from braidwork.sources.tables import table

    events = table(spark, D, "events")
    stream = incremental.file_stream(spark, f"{D}/events.parquet", events.schema)
    for f, name in ((incremental.windowed, "w_test"), (incremental.sessions, "s_test")):
        got = incremental.run_to_end(f(stream), name)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, f(events).collect()), key=str)
