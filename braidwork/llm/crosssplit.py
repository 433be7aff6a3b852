"""Same or near-same records across splits, by an exact prefix-filter join on rare words.

Each text of an evaluation or training split becomes the bag of its words, so neither the order of sentences nor where words are changed
matters.  Near-same texts share the words that bags.py bounds; only the prefixes that must meet are joined, evaluation prefixes as the
index and training prefixes as the probe, and what passes the exact filters is verified on the words.  The number of words that must be
shared follows from `one_in` alone: no pair that verification would accept is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import bags
from braidwork.llm.texts import classes, verified
from braidwork.session import stage

# The splits that mean training and those that mean evaluation.
TRAIN, EVALUATION = ("train",), ("test", "dev", "valid", "val")


def split_sides(documents: DataFrame) -> DataFrame:
    """(id, side, text) of the documents of training (0) and evaluation (1) splits that have text."""
    side = F.when(F.col("split").isin(*TRAIN), 0).when(F.col("split").isin(*EVALUATION), 1)
    return documents.select(F.col("doc_id").cast("bigint").alias("id"), side.alias("side"), "text").where("side IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")


def overlaps(documents: DataFrame, least: int = 20, one_in: int = 6) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all pairs of a training and an evaluation document (doc_id, text, split) of at least `least`
    words whose texts are the same or near-same: at most one word in `one_in` inserted, deleted or replaced.

    Copies are one class through all steps and only expanded at the end.  Null ids, texts and splits, and splits of neither kind,
    pair with nothing; repeated rows give their pairs once; without evaluation documents there are no pairs; other columns are not
    read.
    """
    docs = split_sides(documents)
    kept = stage(bags.measured(docs, least))
    members = kept.where("block IS NULL").select("id", "side", "hi", "lo")
    met = bags.candidates(docs.where("side = 1"), docs.where("side = 0"), bags.rarity(kept), least, one_in)
    by_text = classes(members, F.max(F.col("side") == 1).alias("evaluation"), F.max(F.col("side") == 0).alias("training"))
    belongs = stage(members.join(by_text, ["hi", "lo"]).select("id", "side", "cls"))
    ids = belongs.select("id", "cls").distinct()
    met = met.join(ids.toDF("e", "a"), "e").join(ids.toDF("t", "b"), "t").where("a <> b").select("a", "b").distinct()
    near = verified(stage(met), docs.select("id", "text"), one_in)
    both = by_text.where("evaluation AND training").selectExpr("cls AS a", "cls AS b")
    side = lambda n, name, cls: belongs.where(F.col("side") == n).select(F.col("id").alias(name), F.col("cls").alias(cls))
    pairs = near.unionAll(both).join(side(1, "e", "a"), "a").join(side(0, "t", "b"), "b")
    return pairs.selectExpr("least(e, t) AS doc_id_a", "greatest(e, t) AS doc_id_b").where("doc_id_a < doc_id_b").distinct()


def report(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, evaluation_docs, pairs) of the evaluation documents in pairs, by split (validation names as stored) and
    source of the evaluation document."""
    info = documents.selectExpr("doc_id AS id", "split", "source").where(F.col("split").isin(*EVALUATION)).distinct()
    ends = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("id"))
    per = ends.groupBy("id").count()
    return per.join(info, "id").groupBy("split", "source").agg(F.count("*").alias("evaluation_docs"), F.sum("count").alias("pairs"))
