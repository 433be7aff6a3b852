"""Memory of tasks that hold the items of a search."""

import resource
import time

import pyarrow as pa

from braidwork.operators import retrieve


def peak(spark):
    """MB of the largest Python worker so far."""

    def own(batches):
        for _ in batches:
            time.sleep(0.5)
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], names=["mb"])

    return max(r.mb for r in spark.range(8, numPartitions=8).mapInArrow(own, "mb bigint").collect())


def test_scores_are_made_in_blocks(spark):
    """6000 queries in one batch and 20 000 items: their scores together would take 960 MB."""
    items = spark.range(20_000).selectExpr("id AS item", "concat('w', id % 50, ' w', id % 7, ' v', id % 3) AS t")
    asked = spark.range(6000, numPartitions=1).selectExpr("id AS q", "concat('w', id % 60, ' w', id % 7, if(id % 9 = 0, ' ', ' v1')) AS x")
    before = peak(spark)
    got = retrieve.nearest_held(asked, items, ["q"], "x", "item", "t", 4)
    assert got.where("q < 60 OR rank = 4").count() == 240 + 6000 - 60
    assert peak(spark) - before < 400


def test_equals_plain_ranking(spark):
    import numpy as np

    from braidwork.functions.embed import Hasher

    texts = [None, "", *(f"w{i % 50} w{i % 7} v{i % 3}" + " x" * (i % 5 == 0) * (i % 400) for i in range(9000))]
    items = spark.createDataFrame(list(enumerate(texts)), "item int, t string")
    qs = [f"w{i} w{i % 7}" for i in range(40)] + [" ", None, "x x"]
    got = {}
    for r in retrieve.nearest_held(spark.createDataFrame(list(enumerate(qs)), "q int, x string"), items, ["q"], "x", "item", "t", 5).collect():
        got.setdefault(r.q, []).append((r["rank"], r["item"], r.score))
    s = np.round(Hasher()(qs) @ Hasher()(texts).T, 9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert {q: sorted(v) for q, v in got.items()} == {q: [(k + 1, int(i), float(s[q, i])) for k, i in enumerate(order[q])] for q in range(len(qs))}
