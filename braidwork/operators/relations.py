"""Relations of documents in long form, and their evaluation against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.filters import well_formed

#: Labels that count as causal in the binary strategy.
CAUSAL = ("PRECONDITION", "CAUSE", "RESULT", "ENABLE", "FALLING_ACTION", "CAUSAL_RELATION")
CREDITS = {"exact": 1.0, "undirected": 0.75, "one_end": 0.5}


def triples(documents: DataFrame, column: str = "relations", key: str = "document_id") -> DataFrame:
    """(key, rel, pos, head, tail) of a map from relation to pairs; pairs that aren't two strings go (FLT4), repeated ones stay."""
    pairs = documents.select(key, F.explode(column).alias("rel", "pairs")).select(key, "rel", F.posexplode("pairs").alias("pos", "pair"))
    return pairs.where(well_formed(F.col("pair"))).select(key, "rel", "pos", F.col("pair")[0].alias("head"), F.col("pair")[1].alias("tail"))


def as_maps(long: DataFrame, key: str = "document_id", column: str = "relations") -> DataFrame:
    """The map form of triples() again, pairs in their order."""
    pairs = long.groupBy(key, "rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "head", "tail"))), lambda x: F.array(x["head"], x["tail"])).alias("pairs"))
    return pairs.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "pairs")))).alias(column))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def scores(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn."""
    df = df.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def label(column: str, strategy: str = "strict") -> Column:
    """SCA12: labels in upper case; 'binary' folds the causal ones; 'ignore' drops them."""
    up = F.upper(F.coalesce(F.col(column), F.lit("")))
    if strategy == "ignore":
        return F.lit("")
    return F.when(up.isin(*CAUSAL), "CAUSAL").otherwise(up) if strategy == "binary" else up


def matched(gold: DataFrame, pred: DataFrame, by: tuple[str, ...] = ("document_id", "rel", "head", "tail")) -> DataFrame:
    """JN2, SET1: each distinct triple of either side with the flags in_gold and in_pred; one shuffle for union, distinct and match."""
    side = lambda df, g: df.select(*by, F.lit(g).alias("g"), F.lit(not g).alias("p"))
    return side(gold, True).unionAll(side(pred, False)).groupBy(*by).agg(F.max("g").alias("in_gold"), F.max("p").alias("in_pred"))


def _counts() -> list[Column]:
    both, g, p = F.col("in_gold") & F.col("in_pred"), F.col("in_gold"), F.col("in_pred")
    return [F.count_if(both).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(g).alias("support_gold"), F.count_if(p).alias("support_pred")]


def micro(pairs: DataFrame) -> DataFrame:
    """AGG1: one row of counts and P/R/F1 over all triples of matched()."""
    return scores(pairs.agg(*_counts()))


def per_relation(pairs: DataFrame) -> DataFrame:
    """AGG2."""
    return scores(pairs.groupBy("rel").agg(*_counts()))


def rollup(pairs: DataFrame) -> DataFrame:
    """AGG1 and AGG2 of one scan: micro is the row with total = true."""
    return scores(pairs.rollup("rel").agg(F.grouping("rel").cast("boolean").alias("total"), *_counts()))


def per_document(pairs: DataFrame, key: str = "document_id") -> DataFrame:
    """AGG4: one row per document."""
    return scores(pairs.groupBy(key).agg(*_counts()))


def macro(pairs: DataFrame, key: str = "document_id") -> DataFrame:
    """AGG5: macro averages over documents beside the micro scores."""
    docs = per_document(pairs, key)
    out = docs.agg(F.count("*").alias("documents"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return scores(out).withColumnsRenamed({c: f"micro_{c}" for c in ("precision", "recall", "f1")})


def evaluated_documents(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """JN1: predictions (document_id, relations, pred_relations) with their gold: the inline relations if there are any, even an empty
    map, else those of gold (document_id, relations); has_gold tells if either was there."""
    other = gold.select("document_id", F.col("relations").alias("_gold"))
    own = F.col("relations") if "relations" in pred.columns else F.lit(None).cast(gold.schema["relations"].dataType)
    out = pred.withColumn("relations", own).join(other, "document_id", "left").withColumn("relations", F.coalesce("relations", "_gold")).drop("_gold")
    return out.withColumn("has_gold", F.col("relations").isNotNull())


def coverage(evaluated: DataFrame) -> DataFrame:
    """AGG3: documents seen, evaluated and without gold."""
    return evaluated.agg(F.count("*").alias("num_docs_seen"), F.count_if("has_gold").alias("num_docs_eval"), F.count_if(~F.col("has_gold")).alias("num_docs_missing_gold"))


def soft_credit(gold: DataFrame, pred: DataFrame, strategy: str = "strict", credits: dict[str, float] | None = None) -> DataFrame:
    """AGG6: each distinct predicted edge (document_id, head, tail, lab) with match_kind and credit: exact, undirected (the pair in
    either direction, labels aside), one_end (its head heads or its tail ends a gold edge of the document) or wrong."""
    c = CREDITS | (credits or {})
    use = strategy == "strict"
    lab = label("rel", strategy) if use else F.lit("")
    g = gold.select("document_id", "head", "tail", lab.alias("lab")).distinct()
    p = pred.select("document_id", "head", "tail", lab.alias("lab")).distinct()
    exact = g.withColumn("exact", F.lit(True))
    low, high = F.least("head", "tail").alias("low"), F.greatest("head", "tail").alias("high")
    undir = g.select("document_id", low, high).distinct().withColumn("undirected", F.lit(True))
    ends = [g.select("document_id", F.col(x)).distinct().withColumn(f"{x}_ok", F.lit(True)) for x in ("head", "tail")]
    out = p.join(exact, ["document_id", "head", "tail", "lab"], "left").withColumns({"low": F.least("head", "tail"), "high": F.greatest("head", "tail")}).join(undir, ["document_id", "low", "high"], "left")
    for e, x in zip(ends, ("head", "tail"), strict=True):
        out = out.join(e, ["document_id", x], "left")
    kind = F.when(F.col("exact"), "exact").when(F.col("undirected"), "undirected").when(F.col("head_ok") | F.col("tail_ok"), "one_end").otherwise("wrong")
    out = out.withColumn("match_kind", kind)
    credit = F.when(F.col("match_kind") == "exact", c["exact"]).when(F.col("match_kind") == "undirected", c["undirected"]).when(F.col("match_kind") == "one_end", c["one_end"]).otherwise(0.0)
    return out.select("document_id", "head", "tail", "lab", "match_kind", credit.alias("credit"))


def soft_scores(credited: DataFrame, gold: DataFrame, strategy: str = "strict") -> DataFrame:
    """AGG6: micro scores from credits; soft recall may exceed 1."""
    lab = label("rel", strategy) if strategy == "strict" else F.lit("")
    n = gold.select("document_id", "head", "tail", lab.alias("lab")).distinct().agg(F.count("*").alias("gold_edges"))
    got = credited.agg(F.count("*").alias("pred_edges"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"))
    out = got.join(n).withColumn("soft_precision", share(F.col("credit"), F.col("pred_edges"))).withColumn("soft_recall", share(F.col("credit"), F.col("gold_edges")))
    return out.withColumn("soft_f1", f1(F.col("soft_precision"), F.col("soft_recall")))


def bag_scores(gold: DataFrame, pred: DataFrame, with_label: bool, compatible: bool = False) -> DataFrame:
    """AGG7: P/R/F1 by list membership, repeated pairs counting each time.  compatible: the pair and label metric takes the false
    negatives of pairs alone, as the official scorer does."""
    by = ["document_id", "head", "tail"] + (["rel"] if with_label else [])
    pairs = by[:3]
    tp = pred.join(gold.select(*by).distinct(), by, "left_semi").agg(F.count("*").alias("tp"))
    fp = pred.join(gold.select(*by).distinct(), by, "left_anti").agg(F.count("*").alias("fp"))
    missed = pairs if compatible else by
    fn = gold.join(pred.select(*missed).distinct(), missed, "left_anti").agg(F.count("*").alias("fn"))
    return scores(tp.join(fp).join(fn))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """SET2: the pairs of both predictions (document_id, rel, pos, head, tail), each once, in the order first seen."""
    both = first.select("*", F.lit(0).alias("src")).unionByName(second.select("*", F.lit(1).alias("src")))
    seen = both.groupBy("document_id", "rel", "head", "tail").agg(F.min(F.struct("src", "pos")).alias("at"))
    from braidwork.operators.filters import top

    return top(seen, ["document_id", "rel"], [F.col("at"), F.col("head"), F.col("tail")], None, "pos").select("document_id", "rel", (F.col("pos") - 1).alias("pos"), "head", "tail")


def ordered_distinct(df: DataFrame, group: list[str], value: str, pos: str) -> DataFrame:
    """SET3: distinct values of each group with the place where each was first seen."""
    return df.groupBy(*group, value).agg(F.min(pos).alias(pos))


def overridden(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """JN14: new rows, and old rows whose keys are not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
