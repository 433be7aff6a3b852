"""Model answers: finding JSON in text, reading relations from it, mapping their labels and ends to a document's own."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import mention_key, mention_text

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def _object_at(text: str, start: int) -> str | None:
    """The text from a brace to the brace that closes it, braces in strings counting too."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[start : m.end()]
    return None


def first_json_text(text: str | None) -> str | None:
    """SCA1: the first JSON value in a text: of fenced parts, then of the whole, either all of it or the first balanced object."""
    for part in [*(m[1].strip() for m in _FENCE.finditer(text or "")), (text or "").strip()]:
        for candidate in [part, *(c for m in re.finditer(r"\{", part) if (c := _object_at(part, m.start())))]:
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
    return None


def first_json(x: Column | str) -> Column:
    """SCA1 as a column, by Arrow batches."""

    @F.pandas_udf("string")
    def find(s: pd.Series) -> pd.Series:
        return s.map(first_json_text)

    return find(x)


def is_object(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))


def json_object(x: Column | str) -> Column:
    """SCA2: a JSON object: the text without a leading and a trailing fence if it is one, else the span from the first brace to the last;
    null if neither is."""
    x = F.col(x) if isinstance(x, str) else x
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(is_object(bare), bare).when(is_object(span), span)


_PAIR = r'^\[\s*"(?:[^"\\]|\\.)*"\s*,\s*"(?:[^"\\]|\\.)*"\s*\]$'


def relations(x: Column | str) -> Column:
    """The relations of a JSON object as map<string, array<array<string>>>: values that are lists, of them the pairs of two strings (FLT4:
    judged on the JSON text, so numbers are no strings)."""
    x = F.col(x) if isinstance(x, str) else x
    raw = F.from_json(x, "map<string,string>")
    lists = F.map_filter(raw, lambda k, v: v.isNotNull() & v.startswith("["))
    pairs = lambda v: F.transform(F.filter(F.from_json(v, "array<string>"), lambda p: p.isNotNull() & p.rlike(_PAIR)), lambda p: F.from_json(p, "array<string>"))
    return F.transform_values(lists, lambda k, v: F.coalesce(pairs(v), F.array().cast("array<array<string>>")))


def normalised(relations_: Column | str, types: Column | str) -> Column:
    """SCA3: exactly the types given, in their order: missing ones empty, others dropped."""
    m, t = (F.col(x) if isinstance(x, str) else x for x in (relations_, types))
    empty = F.array().cast("array<array<string>>")
    return F.map_from_arrays(t, F.transform(t, lambda k: F.coalesce(F.try_element_at(m, k), empty)))


def by_alias(relations_: Column | str, types: Column | str) -> Column:
    """SCA4, JN15: as normalised(), keys being matched by full form, code or label of `code : label`, exactly or in lower case; pairs
    of all keys that mean a type are joined in key order.  A key that names several types goes to the last."""
    m, t = (F.col(x) if isinstance(x, str) else x for x in (relations_, types))

    def names(r: Column) -> Column:
        code, label = F.trim(F.split_part(r, F.lit(":"), F.lit(1))), F.trim(F.substring_index(r, ":", -1))
        return F.when(r.contains(":"), F.array(r, code, label, F.lower(label))).otherwise(F.array(r))

    def means(key: Column, r: Column) -> Column:
        return F.array_contains(names(r), F.trim(key)) | F.array_contains(names(r), F.lower(F.trim(key)))

    def owner(key: Column) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(t, lambda r: means(key, r))), -1)

    pairs = lambda r: F.flatten(F.transform(F.filter(F.map_entries(m), lambda e: F.coalesce(owner(e["key"]) == r, F.lit(False))), lambda e: e["value"]))
    return F.map_from_arrays(t, F.transform(t, lambda r: F.coalesce(pairs(r), F.array().cast("array<array<string>>"))))


def mentions(documents: DataFrame) -> DataFrame:
    """(document_id, entity_id, key): trigger words and texts of the entities' mentions, trimmed, in lower case."""
    each = documents.select("document_id", F.explode("entities").alias("entity_id", "e")).select("document_id", "entity_id", F.explode("e.mentions").alias("m"))
    return each.select("document_id", "entity_id", F.explode(F.array(F.col("m.trigger_word"), F.col("m.text"))).alias("t")).select("document_id", "entity_id", mention_key("t").alias("key")).where("key IS NOT NULL").distinct()


def unambiguous(documents: DataFrame) -> DataFrame:
    """AGG12, JN8: (document_id, key, entity_id): mentions that name exactly one entity of their document."""
    return mentions(documents).groupBy("document_id", "key").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def surfaces(documents: DataFrame) -> DataFrame:
    """B8: (document_id, key, entity_id): the first text of each entity's mentions; of entities with the same one the first wins."""
    each = documents.select("document_id", F.posexplode("entities").alias("pos", "entity_id", "e"))
    text = F.get(F.filter(F.transform("e.mentions", mention_text), lambda t: t.isNotNull()), F.lit(0))
    keyed = each.select("document_id", "pos", "entity_id", mention_key(text).alias("key")).where("key IS NOT NULL")
    return keyed.groupBy("document_id", "key").agg(F.min_by("entity_id", "pos").alias("entity_id"))


def ends(pairs: DataFrame, documents: DataFrame, variant: str) -> DataFrame:
    """SCA14, JN9: (document_id, rel, pos, head, tail) with ends mapped to entities.

    both_in_set: both ends are entities.  strict_tail_literal: the head is an entity, the tail one or a mention that names one alone.
    surface_first: both are entities that won their first mention's text, or such texts; loops go.  keep_unresolved: non-blank ends are
    kept as they are, trimmed.
    """
    if variant == "keep_unresolved":
        return pairs.withColumns({c: F.trim(c) for c in ("head", "tail")}).where("head <> '' AND tail <> ''")
    known = documents.select("document_id", F.explode(F.map_keys("entities")).alias("id")).distinct()
    is_in = lambda df, c: df.join(known.withColumnRenamed("id", c), ["document_id", c], "left_semi")
    order = ["document_id", "rel", "pos", "head", "tail"]
    if variant == "both_in_set":
        return is_in(is_in(pairs, "head"), "tail").select(*order)
    if variant == "strict_tail_literal":
        heads = is_in(pairs, "head")
        own = known.select("document_id", F.col("id").alias("tail"), F.col("id").alias("own"))
        named = unambiguous(documents).select("document_id", F.col("key").alias("tail_key"), F.col("entity_id").alias("named"))
        out = heads.withColumn("tail_key", mention_key("tail")).join(own, ["document_id", "tail"], "left").join(named, ["document_id", "tail_key"], "left")
        return out.withColumn("tail", F.coalesce("own", "named")).where("tail IS NOT NULL").select(*order)
    if variant == "surface_first":
        surf = surfaces(documents)
        for c in ("head", "tail"):
            won = surf.select("document_id", F.col("entity_id").alias(f"{c}_t"), F.lit(True).alias("won")).distinct()
            named = surf.select("document_id", F.col("key").alias("k"), F.col("entity_id").alias("named"))
            pairs = pairs.withColumn(f"{c}_t", F.trim(c)).withColumn("k", mention_key(c)).join(won, ["document_id", f"{c}_t"], "left").join(named, ["document_id", "k"], "left")
            pairs = pairs.withColumn(c, F.when(F.col("won"), F.col(f"{c}_t")).otherwise(F.col("named"))).drop("won", "named", "k", f"{c}_t")
        return pairs.where("head IS NOT NULL AND tail IS NOT NULL AND head <> tail").select(*order)
    raise ValueError(f"unknown variant {variant!r}")
