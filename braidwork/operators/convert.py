"""Converters of raw corpora into the one document schema (document_id, title, text, type, sentences, tokens, entities, relations)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.text import document_id
from braidwork.sources.schema import ENTITIES, NORMALISED, RELATIONS

CONVERTERS: dict[str, Callable[..., DataFrame]] = {}
# Endings that the light stemmer takes off.
ENDINGS = ("ing", "ed", "ly", "es", "s")


def converter(name: str):
    """CNV1: register a converter by name."""

    def add(f):
        CONVERTERS[name] = f
        return f

    return add


def convert(name: str, *sources, truncate: int | None = None, **options) -> DataFrame:
    """CNV8: documents of a converter by its name, the first `truncate` by document_id if asked."""
    if name not in CONVERTERS:
        raise ValueError(f"unknown converter {name!r}; there are {', '.join(sorted(CONVERTERS))}")
    out = CONVERTERS[name](*sources, **options)
    return out.orderBy("document_id").limit(truncate) if truncate else out


def split_of(path: Column) -> Column:
    """The split that a file name tells."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return F.when(name.contains("train"), "train").when(name.contains("dev") | name.contains("valid") | name.contains("val"), "validation").when(name.contains("test"), "test").otherwise("unknown")


def _any_pair(relations: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(relations), lambda p: F.size(p) > 0), F.lit(False))


def _mention(**fields: Column) -> Column:
    kinds = {"id": "string", "trigger_word": "string", "text": "string", "name": "string", "sent_id": "int", "sentence_id": "int", "token_id": "int", "offset": "array<int>"}
    return F.struct(*(fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))


def _entity(kind: Column, mentions: Column, lemma: Column | None = None) -> Column:
    return F.struct(kind.cast("string").alias("type"), (F.lit(None) if lemma is None else lemma).cast("string").alias("lemma"), mentions.alias("mentions"))


MAVEN = "id string, title string, tokens array<array<string>>, sentences array<string>, events array<struct<id:string,type:string,mention:array<struct<id:string,trigger_word:string,sent_id:int,offset:array<int>>>>>, causal_relations map<string,array<array<string>>>"


@converter("maven_ere")
def maven(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    """CNV2: raw is MAVEN rows with a column `split`; text from sentences, else tokens, else the title; only causal relations between
    known events; documents without any are dropped unless keep_empty."""
    joined = F.transform("tokens", lambda s: F.array_join(s, " "))
    sentences = F.coalesce("sentences", F.when(F.size("tokens") > 0, joined))
    tokens = F.coalesce(F.col("tokens"), F.transform("sentences", lambda s: F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")))
    text = F.when(F.size("sentences") > 0, F.array_join("sentences", " ")).when(F.size("tokens") > 0, F.array_join(joined, " ")).otherwise(F.coalesce("title", F.lit("")))
    known = F.filter("events", lambda e: F.coalesce(e["id"] != "", F.lit(False)))
    mention = lambda m: _mention(id=m["id"], trigger_word=m["trigger_word"], sent_id=m["sent_id"], offset=m["offset"])
    none = F.array().cast("array<struct<id:string,trigger_word:string,sent_id:int,offset:array<int>>>")
    entities = F.coalesce(F.map_from_entries(F.transform(known, lambda e: F.struct(e["id"], _entity(e["type"], F.transform(F.coalesce(e["mention"], none), mention))))), F.create_map().cast(ENTITIES))
    df = raw.select("split", "title", F.col("causal_relations").alias("raw"), text.alias("text"), sentences.alias("sentences"), tokens.alias("tokens"), entities.alias("entities"))
    ids = F.map_keys("entities")
    pair = lambda p: (F.size(p) == 2) & F.array_contains(ids, F.get(p, F.lit(0))) & F.array_contains(ids, F.get(p, F.lit(1)))
    relations = F.transform_values(F.coalesce("raw", F.create_map().cast(RELATIONS)), lambda k, v: F.filter(v, lambda p: F.coalesce(pair(p), F.lit(False))))
    df = df.withColumn("relations", relations).withColumn("document_id", document_id("MAVEN_ERE", "text")).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "document_id")).withColumn("type", F.col("split"))
    return (df if keep_empty else df.where(_any_pair(F.col("relations")))).select(*NORMALISED)


DOCRED = "title string, sents array<array<string>>, vertexSet array<array<struct<name:string,pos:array<int>,sent_id:int,type:string>>>, labels array<struct<h:int,t:int,r:string,evidence:array<int>>>"


def event_id(document: Column, split: Column, place: Column, surface: Column, prefix: str = "Event_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("||", document, split, place.cast("string"), surface)), 1, 12))


@converter("docred_causal")
def docred(raw: DataFrame, rel_info: DataFrame, keep_empty: bool = True) -> DataFrame:
    """CNV3: raw is DocRED rows with a column `split`, rel_info (r, name); clusters of mentions become entities, labels relations of the
    form `P17 : name`, or the bare code where it has no name; labels that point nowhere go.  rel_info is small and joined once."""
    sentences = F.transform(F.coalesce("sents", F.array().cast("array<array<string>>")), lambda s: F.array_join(s, " "))
    df = raw.withColumn("sentences", sentences).withColumn("text", F.array_join("sentences", " ")).withColumn("document_id", document_id("DocRED", "text"))
    surface = lambda m: F.array_join(F.slice(F.get(F.col("sents"), m["sent_id"]), F.get(m["pos"], F.lit(0)) + 1, F.get(m["pos"], F.lit(1)) - F.get(m["pos"], F.lit(0))), " ")
    mention = lambda i: lambda m, k: _mention(id=F.concat(i.cast("string"), F.lit("_m"), k.cast("string")), trigger_word=surface(m), sent_id=m["sent_id"], offset=m["pos"])
    cluster = lambda c, i: F.struct(F.when(F.size(c) > 0, event_id(F.col("document_id"), F.col("split"), i, surface(F.get(c, F.lit(0))))).alias("id"), _entity(F.coalesce(F.get(c, F.lit(0))["type"], F.lit("UNK")), F.transform(c, mention(i))).alias("e"))
    df = df.withColumn("clusters", F.transform(F.coalesce("vertexSet", F.array().cast("array<array<struct<name:string,pos:array<int>,sent_id:int,type:string>>>")), cluster))
    df = df.withColumn("entities", F.map_from_entries(F.transform(F.filter("clusters", lambda c: c["id"].isNotNull()), lambda c: F.struct(c["id"], c["e"]))))
    labels = df.select("document_id", "split", "clusters", F.posexplode("labels").alias("pos", "l")).join(rel_info.toDF("r", "name"), F.col("l.r") == F.col("r"), "left")
    ends = labels.select("document_id", "split", "pos", F.when(F.col("name") != "", F.concat_ws(" : ", "l.r", "name")).otherwise(F.col("l.r")).alias("rel"), F.get(F.col("clusters"), F.col("l.h"))["id"].alias("head"), F.get(F.col("clusters"), F.col("l.t"))["id"].alias("tail")).where("head IS NOT NULL AND tail IS NOT NULL")
    by = ends.groupBy("document_id", "split", "rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "head", "tail"))), lambda x: F.array(x["head"], x["tail"])).alias("pairs"))
    maps = by.groupBy("document_id", "split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "pairs")))).alias("relations"))
    out = df.join(maps, ["document_id", "split"], "left").withColumn("relations", F.coalesce("relations", F.create_map().cast(RELATIONS)))
    out = out.select("document_id", F.coalesce(F.nullif("title", F.lit("")), "document_id").alias("title"), "text", F.col("split").alias("type"), "sentences", F.col("sents").alias("tokens"), "entities", "relations")
    return out if keep_empty else out.where(_any_pair(F.col("relations")))


def spans(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """CNV4: (file, span, t_ids, sentence, first, last, text) of spans like 183_184 (file, span): only if all their tokens (file, t_id,
    sentence, number, text) are there; over several sentences the first one counts."""
    parts = wanted.select("file", "span").distinct().withColumn("t_ids", F.split("span", "_").cast("array<int>")).where("forall(t_ids, t -> t IS NOT NULL)")
    place = Window.partitionBy("file", "sentence").orderBy("number", "t_id")
    placed = tokens.withColumn("place", F.row_number().over(place) - 1)
    each = parts.select("file", "span", "t_ids", F.posexplode("t_ids").alias("at", "t_id")).join(placed, ["file", "t_id"])
    found = each.groupBy("file", "span", "t_ids").agg(F.count_distinct("at").alias("n"), F.min("sentence").alias("sentence"), F.min("place").alias("first"), (F.max("place") + 1).alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))
    return found.where(F.col("n") == F.size("t_ids")).drop("n")


@converter("eventstoryline")
def eventstoryline(tokens: DataFrame, links: DataFrame, split: str = "unknown") -> DataFrame:
    """CNV4: tokens (file, t_id, sentence, number, text) and links (file, source, target, relation) between spans of the same file; a link
    whose span lacks a token goes, documents without links too."""
    ordered = tokens.groupBy("file", "sentence").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "t_id", "text"))), lambda x: x["text"]).alias("ws"))
    docs = ordered.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "ws"))), lambda x: x["ws"]).alias("tokens"))
    docs = docs.withColumn("sentences", F.transform("tokens", lambda s: F.array_join(s, " "))).withColumn("text", F.array_join("sentences", " ")).withColumn("document_id", document_id("eventstoryline", "text"))
    wanted = links.select("file", F.explode(F.array("source", "target")).alias("span"))
    rank = Window.partitionBy("file").orderBy("sentence")
    index = tokens.select("file", "sentence").distinct().withColumn("sent_id", F.row_number().over(rank) - 1)
    found = spans(tokens, wanted).join(index, ["file", "sentence"]).join(docs.select("file", "document_id"), "file")
    found = found.withColumn("id", F.concat(F.lit("EVENT_"), F.md5(F.concat_ws(":", "document_id", "span"))))
    mention = _mention(id=F.concat("id", F.lit("_m0")), trigger_word=F.col("text"), sent_id=F.col("sent_id"), offset=F.array("first", "last"))
    entities = found.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("id", _entity(F.lit(None), F.array(mention)).alias("e")))).alias("entities"))
    ends = links.distinct().join(found.select("file", F.col("span").alias("source"), F.col("id").alias("head")), ["file", "source"]).join(found.select("file", F.col("span").alias("target"), F.col("id").alias("tail")), ["file", "target"])
    relations = ends.groupBy("file", "relation").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "target", "head", "tail"))), lambda x: F.array(x["head"], x["tail"])).alias("pairs")).groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "pairs")))).alias("relations"))
    out = docs.join(entities, "file").join(relations, "file")
    return out.select("document_id", F.col("file").alias("title"), "text", F.lit(split).alias("type"), "sentences", "tokens", "entities", "relations")


def without_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"</?e[12]>", ""))


def tagged(x: Column, tag: str) -> Column:
    """CNV5: struct(start, end, text) of a tag's span in the text without tags; null if the tag isn't there."""
    lead = F.regexp_extract(x, rf"(?s)^(.*?)<{tag}>", 1)
    inner = F.regexp_replace(F.regexp_extract(x, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"</?e[12]>", "")
    clean = F.regexp_replace(lead, r"</?e[12]>", "")
    start = F.length(clean) - (F.length(F.regexp_replace(x, r"</?e[12]>", "")) - F.length(F.ltrim(F.regexp_replace(x, r"</?e[12]>", ""))))
    return F.when(x.rlike(rf"(?s)<{tag}>.*?</{tag}>"), F.struct(F.greatest(start, F.lit(0)).alias("start"), (F.greatest(start, F.lit(0)) + F.length(inner)).alias("end"), F.trim(inner).alias("text")))


def offset_of(tokens: Column, phrase: Column) -> Column:
    """The first place of a phrase's words in tokens as [start, end); null if it isn't there."""
    p = F.filter(F.split(phrase, r"(?U)\s+"), lambda w: w != "")
    n = F.size(tokens) - F.size(p)
    hit = F.get(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.slice(tokens, i + 1, F.greatest(F.size(p), F.lit(0))) == p), F.lit(0))
    return F.when((F.size(p) > 0) & (n >= 0) & hit.isNotNull(), F.array(hit, hit + F.size(p)).cast("array<int>"))


@converter("fincausal")
def fincausal(rows: DataFrame, split: str = "train") -> DataFrame:
    """CNV5: rows with columns text or sentence and perhaps cause and effect (any case); phrases from the columns, else from the <e1> and
    <e2> tags; one relation CAUSE if both are there; rows without text go."""
    have = {c.lower() for c in rows.columns}
    pick = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    raw = rows.select(pick("sentence", "text").alias("raw"), pick("cause").alias("c"), pick("effect").alias("e")).where("raw IS NOT NULL")
    df = raw.select(without_tags(F.col("raw")).alias("text"), F.coalesce("c", F.nullif(tagged(F.col("raw"), "e1")["text"], F.lit(""))).alias("cause"), F.coalesce("e", F.nullif(tagged(F.col("raw"), "e2")["text"], F.lit(""))).alias("effect"))
    df = df.withColumn("document_id", document_id("fincausal", "text")).withColumn("ws", F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    arg = lambda c, role: F.when(F.col(c).isNotNull(), F.concat(F.lit("ARG_"), F.substring(F.md5(F.concat_ws("||", F.col("document_id"), F.lit(role), F.col(c))), 1, 12)))
    df = df.withColumn("h", arg("cause", "cause")).withColumn("t", arg("effect", "effect"))
    entry = lambda i, c, kind: F.when(F.col(i).isNotNull(), F.struct(F.col(i).alias("k"), _entity(F.lit(kind), F.array(_mention(id=F.concat(F.col(i), F.lit("_m0")), trigger_word=F.col(c), sent_id=F.lit(0), offset=offset_of(F.col("ws"), F.col(c))))).alias("v")))
    entities = F.map_from_entries(F.filter(F.array(entry("h", "cause", "CAUSE"), entry("t", "effect", "EFFECT")), lambda x: x.isNotNull()))
    pairs = F.when(F.col("h").isNotNull() & F.col("t").isNotNull(), F.array(F.array("h", "t"))).otherwise(F.array().cast("array<array<string>>"))
    return df.select("document_id", F.col("document_id").alias("title"), "text", F.lit(split).alias("type"), F.array("text").alias("sentences"), F.array("ws").alias("tokens"), entities.alias("entities"), F.create_map(F.lit("CAUSE"), pairs).alias("relations"))


def stem(x: Column) -> Column:
    """CNV6: lower case, other characters than a-z and 0-9 off both ends, and the first fitting ending off if three letters stay."""
    def cut(t: Column) -> Column:
        off = t
        for e in reversed(ENDINGS):
            off = F.when(t.endswith(e) & (F.length(t) > len(e) + 2), F.substring(t, F.lit(1), F.length(t) - len(e))).otherwise(off)
        return off

    return F.get(F.transform(F.array(F.regexp_replace(F.lower(x), r"^[^a-z0-9]+|[^a-z0-9]+$", "")), cut), F.lit(0))  # the word is cleaned once


def lexicon(lines: DataFrame) -> DataFrame:
    """CNV6: (cause, effect) stems of lines (value) `a->b<TAB>...`, both of them single words."""
    first = F.split_part(F.trim("value"), F.lit("\t"), F.lit(1))
    a, b = F.trim(F.split_part(first, F.lit("->"), F.lit(1))), F.trim(F.regexp_extract(first, "->(.*)$", 1))
    return lines.where(first.contains("->") & ~a.contains(" ") & ~b.contains(" ")).select(stem(a).alias("cause"), stem(b).alias("effect")).where("cause <> '' AND effect <> ''").distinct()


@converter("causalbank")
def causalbank(rows: DataFrame, pairs: DataFrame, start: int = 0, distance: int | None = None, split: str = "train") -> DataFrame:
    """CNV7: rows (file, line, connector, p1, p2) and lexicon pairs; text `p1 connector p2`; entities are the stems of words that the
    lexicon has, relations the ordered pairs of them that it holds; per file the rows start+1 .. start+distance of those with both
    phrases; documents without relation count there but are dropped."""
    ok = rows.where("trim(p1) <> '' AND trim(p2) <> '' AND trim(connector) <> ''").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)
    ok = ok.where((F.col("n") >= start) & (F.lit(True) if distance is None else F.col("n") < start + distance))
    text = F.concat_ws(" ", F.trim("p1"), F.trim("connector"), F.trim("p2"))
    docs = ok.select("file", "line", text.alias("text"), document_id("causalbank", text).alias("document_id"), F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "").alias("ws"))
    stems = pairs.select(F.explode(F.array("cause", "effect")).alias("stem")).distinct()
    each = docs.select("file", "line", "document_id", F.posexplode("ws").alias("at", "w")).withColumn("stem", stem(F.col("w"))).join(stems, "stem")
    key = F.concat(F.lit("T_"), F.substring(F.md5(F.concat_ws("||", "document_id", "stem")), 1, 12))
    per = each.groupBy("file", "line", "document_id", "stem").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("ms")).withColumn("id", key)
    mention = lambda m: _mention(text=m["w"], sentence_id=F.lit(0), token_id=m["at"])
    entities = per.groupBy("file", "line").agg(F.map_from_entries(F.collect_list(F.struct("id", _entity(F.lit(None), F.transform("ms", mention), F.col("stem")).alias("e")))).alias("entities"))
    a = per.select("file", "line", F.col("stem").alias("cause"), F.col("id").alias("head"))
    b = per.select("file", "line", F.col("stem").alias("effect"), F.col("id").alias("tail"))
    held = a.join(b, ["file", "line"]).where("cause <> effect").join(pairs.distinct(), ["cause", "effect"])
    relations = held.groupBy("file", "line").agg(F.create_map(F.lit("causal_relation"), F.transform(F.array_sort(F.collect_list(F.struct("cause", "effect", "head", "tail"))), lambda x: F.array(x["head"], x["tail"]))).alias("relations"))
    out = docs.join(entities, ["file", "line"]).join(relations, ["file", "line"])
    return out.select("document_id", F.col("document_id").alias("title"), "text", F.lit(split).alias("type"), F.array("text").alias("sentences"), F.array("ws").alias("tokens"), "entities", "relations")


def merged_gold(links: DataFrame, chains: DataFrame) -> DataFrame:
    """CNV9: (file, source, target, relation) of links (file, source, target, relation) between spans like 12_13, spread over the
    coreference chains (file, span, member) of both ends, turned so that the earlier span comes first, PRECONDITION and FALLING_ACTION
    changing places; ends that begin with the same token go; of one pair the last link wins."""
    s = chains.toDF("file", "source", "s2")
    t = chains.toDF("file", "target", "t2")
    wide = links.withColumn("at", F.struct("source", "target")).join(s, ["file", "source"], "left").join(t, ["file", "target"], "left").select("file", F.coalesce("s2", "source").alias("a"), F.coalesce("t2", "target").alias("b"), "relation", "at")
    first = lambda c: F.split_part(c, F.lit("_"), F.lit(1)).try_cast("int")
    turned = F.when(F.col("relation") == "PRECONDITION", "FALLING_ACTION").when(F.col("relation") == "FALLING_ACTION", "PRECONDITION").otherwise(F.col("relation"))
    ahead = first(F.col("a")) < first(F.col("b"))
    out = wide.where(first(F.col("a")) != first(F.col("b"))).select("file", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("target"), F.when(ahead, F.col("relation")).otherwise(turned).alias("relation"), "at")
    return out.groupBy("file", "source", "target").agg(F.max_by("relation", F.struct("at", "relation")).alias("relation"))


def aligned(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """CNV10: (doc_id, line, side, event_id): for each side of a line (doc_id, line, side, t_ids) the event (doc_id, event_id, pos, t_ids)
    that shares most tokens with it, ties to the first; null if none shares any."""
    want = lines.select("doc_id", "line", "side", F.explode(F.array_distinct("t_ids")).alias("t"))
    have = anchors.select("doc_id", "event_id", "pos", F.explode(F.array_distinct("t_ids")).alias("t"))
    hits = want.join(have, ["doc_id", "t"]).groupBy("doc_id", "line", "side", "event_id", "pos").agg(F.count("*").alias("n"))
    best = hits.groupBy("doc_id", "line", "side").agg(F.min_by("event_id", F.struct(-F.col("n"), F.col("pos"))).alias("event_id"))
    return lines.select("doc_id", "line", "side").distinct().join(best, ["doc_id", "line", "side"], "left")


def gold_union(first: DataFrame, second: DataFrame, distinct: bool = True) -> DataFrame:
    """SET5, CNV10: edges of both, each (doc_id, source, target, relation) once; SET7: without `distinct` all of them, as one official script
    does whose removal of repeated links never removes any."""
    keys = ["doc_id", "source", "target", "relation"]
    both = first.select(*keys).unionByName(second.select(*keys))
    return both.dropDuplicates(keys) if distinct else both


def schema_of(documents: DataFrame, rel_info: DataFrame) -> DataFrame:
    """SET6: (document_id, types): all `code : name` of rel_info (r, name) and the document's own types mapped to them, sorted."""
    full = rel_info.select(F.concat_ws(" : ", "r", "name").alias("f"), "r")
    known = full.agg(F.collect_set("f").alias("known"), F.map_from_entries(F.collect_set(F.struct("r", "f"))).alias("m"))
    own = F.transform(F.coalesce(F.map_keys("relations"), F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at("m", F.trim(F.split_part(t, F.lit(":"), F.lit(1)))), t))
    return documents.join(F.broadcast(known)).select("document_id", F.array_sort(F.array_union("known", own)).alias("types"))


