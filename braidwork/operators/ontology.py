"""Ontology retrieval and linking: concept search, links, sub-ontologies, line context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions import text as txt
from braidwork.operators import retrieve
from braidwork.operators.filters import top
from braidwork.session import stage
from braidwork.sources.turtle import OWL, RDF, RDFS, SKOS

CANDIDATE = "struct<target_kind:string,concept_uri:string,label:string,score:double,source:string,evidence:map<string,string>>"
NOT_DONE = "not_implemented"
NO_LINKS, NO_LINES = "(no ontology links available for this document)", "(ontology links found, but no TTL lines matched the linked URIs)"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    at: dict[str, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of letters that two strings have in common in order, 0..100."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer one of at most its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    return both, f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()


def token_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    best = max(ratio(_sorted(a), _sorted(b)), ratio(left, right))
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    return 100.0 if both else max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    """RET10: the best of plain, partial and word-wise ratios, the latter weighed down as strings differ in length."""
    if not a or not b:
        return 0.0
    by = max(len(a), len(b)) / min(len(a), len(b))
    if by < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if by <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def search(queries: DataFrame, concepts: DataFrame, k: int = 5, held: int = 20_000) -> DataFrame:
    """RET10, AGG13, WIN4: (query_id, uri, label, score, rank): concepts (uri, label, description, aliases) by the best weighted ratio
    of a label or alias, or .6 of the partial ratio of the description; ties by label, then uri.  Tasks hold `held` concepts at a time; with more,
    the k best of each pass are ranked together.  A concept is scored only if its letters could make it one of the k best."""
    spark = queries.sparkSession
    passes = max(1, -(-concepts.count() // held))
    kind = queries.schema["query_id"].dataType.simpleString()
    n = max(spark.sparkContext.defaultParallelism, 1)  # few rows, each of them work for every concept
    asked = queries.select("query_id", "query").repartition(n)
    out = None
    for p in range(passes):
        part = concepts.select("uri", "label", "description", "aliases")
        rows = (part.where(F.pmod(F.xxhash64("uri"), F.lit(passes)) == p) if passes > 1 else part).collect()  # about `held`
        shared = spark.sparkContext.broadcast([(r.uri, r.label, [x for x in [r.label, *(r.aliases or [])] if x], r.description) for r in rows])
        one = asked.mapInPandas(_searcher(shared, k), f"query_id {kind}, uri string, label string, score double, rank int")
        out = one if out is None else out.unionAll(one)
    return out if passes == 1 else top(out.drop("rank"), ["query_id"], [F.desc("score"), F.coalesce("label", F.lit("")), F.col("uri")], k)


def _bag(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in text:
        out[c] = out.get(c, 0) + 1
    return out


def _most(query: str, bag: dict[str, int], words: set[str], name: str, own: dict[str, int], own_words: set[str]) -> float:
    """A bound on weighted_ratio(): strings that share a word may reach 100; others share at most the c letters that both have, the shorter of
    what is compared has at least the n letters of its distinct words, and the part it is compared with at least those it shares."""
    if words & own_words:
        return 100.0
    shared = sum(min(v, own.get(c, 0)) for c, v in bag.items()) + min(query.count(" "), name.count(" "))
    least = min(sum(map(len, words)), sum(map(len, own_words)))
    return 200.0 * min(shared, least) / (least + min(shared, least)) if least else 100.0


def _searcher(shared, k: int):
    def search_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(uri, label, [(n, _bag(n), set(n.split())) for n in names], text) for uri, label, names, text in shared.value]
        for b in batches:
            out = []
            for q, text in zip(b["query_id"], b["query"], strict=True):
                if not text or not text.strip():
                    continue
                bag, words = _bag(text), set(text.split())
                bound = [max(max((_most(text, bag, words, *n) for n in names), default=0.0), 60.0 if described else 0.0) for _, _, names, described in rows]
                got: list[tuple] = []
                for j in sorted(range(len(rows)), key=lambda j: -bound[j]):
                    if len(got) >= k and round(bound[j] / 100, 9) < -got[k - 1][0]:
                        break
                    uri, label, names, described = rows[j]
                    name = max((weighted_ratio(text, n) for n, *_ in names), default=0.0)
                    got.append((-round(max(name, 0.6 * partial_ratio(text, described) if described else 0.0) / 100, 9), label or "", uri, label))
                    got.sort(key=lambda g: g[:3])
                out += [(q, uri, label, -s, i + 1) for i, (s, _, uri, label) in enumerate(got[:k])]
            yield pd.DataFrame(out, columns=["query_id", "uri", "label", "score", "rank"])

    return search_


def evidence(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """RET8: concepts found as evidence: document_id is the uri, text `label: description` without a trailing colon."""
    text = F.regexp_replace(F.concat_ws("", F.coalesce(concepts["label"], F.lit("")), F.lit(": "), F.coalesce("description", F.lit(""))), r":\s*$", "")
    return found.drop("label").join(concepts, "uri").select("query_id", "rank", F.col("uri").alias("document_id"), text.alias("text"), "score")


def entity_texts(documents: DataFrame) -> DataFrame:
    """IDX12: (document_id, entity_id, pos, text): trigger, type and the sentence of the first mention."""
    each = documents.select("document_id", "sentences", F.posexplode("entities").alias("pos", "entity_id", "e"))
    m = F.get(F.col("e.mentions"), F.lit(0))
    sentence = F.get(F.col("sentences"), F.coalesce(m["sent_id"], m["sentence_id"]))
    part = lambda name, x: F.when(x.isNotNull() & (F.trim(x) != ""), F.concat(F.lit(f"{name}: "), x))
    return each.select("document_id", "entity_id", "pos", F.concat_ws(" ; ", part("event trigger", txt.mention_text(m)), part("event type", F.col("e.type")), part("context", sentence)).alias("text"))


def concept_text() -> Column:
    return F.concat_ws(" ", "label", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "description")


def link(entities: DataFrame, concepts: DataFrame, k: int = 3, least: float = 0.3, dim: int = 256, digits: int = 9, held: int = 200_000) -> DataFrame:
    """IDX13, JN5, WIN5: (document_id, entity_id, rank, concept_uri, label, score): the k concepts of best cosine for each entity's text, at
    least `least`, ties in the order of uri.  Concepts are held by the tasks, `held` at a time; entities are any number and never shuffled."""
    named = concepts.select(F.col("uri").alias("concept_uri"), "label", concept_text().alias("concept"))
    best = retrieve.nearest_held(entities, named, ["document_id", "entity_id"], "text", "concept_uri", "concept", k, least, dim, digits, held)
    labels = named.select("concept_uri", "label")
    return best.join(labels, "concept_uri").select("document_id", "entity_id", "rank", "concept_uri", "label", "score")


def links_v1(linked: DataFrame, method: str = "embedding", ontology_key: str = "ontology", params: dict[str, str] | None = None, kind: str = "class") -> DataFrame:
    """IDX11: (document_id, ontology_links) in the nested form from linked rows; candidates by score, then rank."""
    candidate = lambda c: F.struct(F.lit(kind).alias("target_kind"), c["concept_uri"].alias("concept_uri"), c["label"].alias("label"), c["score"].alias("score"), F.lit(method).alias("source"), F.lit(None).cast("map<string,string>").alias("evidence"))
    by = linked.groupBy("document_id", "entity_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "rank", F.struct("concept_uri", "label", "score").alias("c")))).alias("cs"))
    entry = lambda cs: F.struct(F.transform(cs, lambda x: candidate(x["c"])).alias("candidates"), F.lit(None).cast(CANDIDATE).alias("selected"))
    meta = F.struct(F.lit("1.0").alias("schema_version"), F.lit(method).alias("method"), F.lit(ontology_key).alias("ontology_key"), F.create_map(*(F.lit(x) for kv in (params or {"top_k": "3"}).items() for x in kv)).alias("params"), txt.iso_utc(F.current_timestamp()).alias("created_at"))
    return by.groupBy("document_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "cs"))), lambda x: F.struct(x["entity_id"], entry(x["cs"])))).alias("by_entity")).select("document_id", F.struct(meta.alias("_meta"), "by_entity").alias("ontology_links"))


def empty_links(documents: DataFrame) -> DataFrame:
    """IDX13, B15: the placeholder linker: no candidate for any entity, with the note that says so."""
    return documents.select("document_id", F.explode(F.map_keys("entities")).alias("entity_id"), F.array().cast(f"array<{CANDIDATE}>").alias("candidates"), F.lit(NOT_DONE).alias("note"))


def upgrade(legacy: DataFrame, method: str = "legacy", ontology_key: str = "ontology") -> DataFrame:
    """IDX11: legacy links (document_id, links map<entity, array<struct<uri, label, score>>>) in the nested form."""
    rows = legacy.select("document_id", F.explode("links").alias("entity_id", "xs")).select("document_id", "entity_id", F.posexplode("xs").alias("p", "x"))
    return links_v1(rows.select("document_id", "entity_id", (F.col("p") + 1).alias("rank"), F.col("x.uri").alias("concept_uri"), F.col("x.label").alias("label"), F.col("x.score").alias("score")), method, ontology_key)


def downgrade(linked: DataFrame) -> DataFrame:
    """IDX11: the nested form as (document_id, links map<entity, array<struct<uri, label, score>>>)."""
    short = lambda v: F.transform(v["candidates"], lambda c: F.struct(c["concept_uri"].alias("uri"), c["label"].alias("label"), c["score"].alias("score")))
    return linked.select("document_id", F.transform_values("ontology_links.by_entity", lambda k, v: short(v)).alias("links"))


def targets(documents: DataFrame, pick: str = "candidates") -> DataFrame:
    """RET15: (document_id, kind, uri): classes and datatypes that a document's links name; links to properties don't count."""
    if pick not in ("candidates", "selected"):
        raise ValueError(f"unknown pick {pick!r}")
    each = documents.select("document_id", F.explode("ontology_links.by_entity").alias("entity", "v"))
    item = each.select("document_id", F.explode("v.candidates").alias("c")) if pick == "candidates" else each.select("document_id", F.col("v.selected").alias("c"))
    kind = F.lower(F.coalesce(F.nullif(F.col("c.target_kind"), F.lit("")), F.lit("class")))
    return item.where("c IS NOT NULL AND c.concept_uri <> ''").select("document_id", kind.alias("kind"), F.col("c.concept_uri").alias("uri")).where("kind <> 'property'").select("document_id", F.when(F.col("kind") == "datatype", "datatype").otherwise("class").alias("kind"), "uri").distinct()


def properties(rdf: DataFrame, wanted: DataFrame, unrestricted: bool = False, most: int | None = None) -> DataFrame:
    """RET15, JN10, WIN11: (document_id, uri, label, domains, ranges, kept_because): properties with a domain among the document's classes
    and a range among its classes or datatypes, a side without any being open; domains and ranges that match; by uri, the first
    `most`.  unrestricted adds rdf:Property without domain and range to every document."""
    side = lambda p, kinds: (
        rdf.where((F.col("p") == f"{RDFS}{p}") & F.col("o_is_iri")).select(F.col("s").alias("uri"), F.col("o").alias("target")).distinct().join(wanted.where(F.col("kind").isin(*kinds)).select("document_id", F.col("uri").alias("target")).distinct(), "target").groupBy("document_id", "uri").agg(F.array_sort(F.collect_set("target")).alias(p))
    )
    domain, rng = side("domain", ("class",)), side("range", ("class", "datatype"))
    has = rdf.where(F.col("p").isin(f"{RDFS}domain", f"{RDFS}range") & F.col("o_is_iri")).groupBy(F.col("s").alias("uri")).agg(F.bool_or(F.col("p") == f"{RDFS}domain").alias("has_domain"), F.bool_or(F.col("p") == f"{RDFS}range").alias("has_range"))
    both = domain.join(rng, ["document_id", "uri"], "full").join(has, "uri")
    kept = both.where("(NOT has_domain OR domain IS NOT NULL) AND (NOT has_range OR range IS NOT NULL)")
    none = F.array().cast("array<string>")
    if unrestricted:
        free = rdf.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{RDF}Property")).select(F.col("s").alias("uri")).distinct().join(has, "uri", "left_anti")
        every = wanted.select("document_id").distinct().join(free).select("uri", "document_id", none.alias("domain"), none.alias("range"), F.lit(False).alias("has_domain"), F.lit(False).alias("has_range"))
        kept = kept.unionByName(every)
    why = F.when(F.col("has_domain") & F.col("has_range"), "domain_and_range_match").when(F.col("has_domain"), "domain_match_range_open").when(F.col("has_range"), "range_match_domain_open").otherwise(F.lit("no_constraints"))
    names = rdf.where(~F.col("o_is_iri")).groupBy(F.col("s").alias("uri")).agg(F.coalesce(F.min(F.when(F.col("p") == f"{RDFS}label", F.col("o"))), F.min(F.when(F.col("p") == f"{SKOS}prefLabel", F.col("o")))).alias("label"))
    out = kept.join(names, "uri", "left").select("document_id", "uri", "label", F.coalesce("domain", none).alias("domains"), F.coalesce("range", none).alias("ranges"), why.alias("kept_because"))
    return top(out, ["document_id"], [F.col("uri")], most).drop("rank")


def fragment(props: DataFrame, wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """RET16: the distinct triples (document_id, s, p, o) of each document's fragment: types and labels of its classes, types, labels,
    domains and ranges of its properties; labels is (uri, label)."""
    named = wanted.where("kind = 'class'").join(labels, "uri", "left")
    rows = [
        named.select("document_id", F.col("uri").alias("s"), F.lit(f"{RDF}type").alias("p"), F.lit(f"{OWL}Class").alias("o")),
        named.select("document_id", F.col("uri"), F.lit(f"{RDFS}label"), F.col("label")),
        props.select("document_id", "uri", F.lit(f"{RDF}type"), F.lit(f"{RDF}Property")),
        props.select("document_id", "uri", F.lit(f"{RDFS}label"), F.col("label")),
        props.select("document_id", "uri", F.lit(f"{RDFS}domain"), F.explode("domains")),
        props.select("document_id", "uri", F.lit(f"{RDFS}range"), F.explode("ranges")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out.where("o IS NOT NULL").distinct()


def turtle(triples: DataFrame) -> DataFrame:
    """SNK6: (document_id, ttl): a fragment's triples as lines of Turtle, sorted."""
    text = F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"')
    o = F.when(F.col("p") == f"{RDFS}label", F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    line = F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(" ."))
    return triples.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("ttl"))


def line_context(documents: DataFrame, lines: DataFrame, index: DataFrame, per_entity: int = 6, around: int = 2, most: int = 200) -> DataFrame:
    """RET17, JN11, SET3: (document_id, context): the lines (line, text) around each <IRI> (uri, line) that the document's links name, in
    the order of entity ids and candidates, each line once, `most` of them; only lines with a label, comment or type if there are any."""
    each = documents.select("document_id", F.explode("ontology_links.by_entity").alias("entity", "v")).select("document_id", "entity", F.posexplode(F.slice("v.candidates", 1, per_entity)).alias("p", "c"))
    uris = each.where("c.concept_uri <> ''").groupBy("document_id", F.col("c.concept_uri").alias("uri")).agg(F.min(F.struct("entity", "p")).alias("at"))
    # what a document shows follows from the order of its IRIs: of each at most its first `most` lines, and nothing after one that has as many
    near = index.select("uri", F.col("line").alias("hit"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("line") - around), F.col("line") + around)).alias("line"))
    near = near.groupBy("uri", "line").agg(F.min("hit").alias("hit")).join(lines.select("line"), "line", "left_semi")
    first = top(near, ["uri"], [F.col("hit"), F.col("line")], most).groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("ls"))
    first = stage(first.select("uri", F.transform("ls", lambda x: x["line"]).alias("ls")))
    counted = uris.join(first.select("uri", F.size("ls").alias("n")), "uri", "left").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("at", "uri", "n"))).alias("xs"))
    counted = counted.select("document_id", F.filter("xs", lambda x: x["n"].isNotNull()).alias("xs"))
    full = F.array_position(F.transform("xs", lambda x: x["n"] >= most), True).cast("int")
    asked = F.when(full > 0, F.slice("xs", 1, full)).otherwise(F.col("xs"))
    chosen = stage(counted.select("document_id", F.transform(asked, lambda x: x["uri"]).alias("asked")))
    # each order of IRIs once, however many documents have it
    own = chosen.select("asked").distinct().select("asked", F.posexplode("asked").alias("p", "uri")).join(first, "uri").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("p", "ls"))).alias("ls"))
    picked = own.select("asked", F.posexplode(F.slice(F.array_distinct(F.flatten(F.transform("ls", lambda x: x["ls"]))), 1, most)).alias("rank", "line"))
    low = F.lower("text")
    good = low.contains("label") | low.contains("comment") | low.contains("definition") | low.contains(" rdf:type ") | low.contains(" a ")
    told = picked.join(lines.select("line", "text"), "line").distinct()
    listed = told.groupBy("asked").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "text", good.alias("good")))), 1, most).alias("ls"))
    shown = F.when(F.exists("ls", lambda x: x["good"]), F.filter("ls", lambda x: x["good"])).otherwise(F.col("ls"))
    out = listed.select("asked", F.array_join(F.transform(shown, lambda x: x["text"]), "\n").alias("found"))
    return documents.select("document_id").join(chosen, "document_id", "left").join(out, "asked", "left").select("document_id", F.coalesce("found", F.when(F.col("asked").isNotNull(), NO_LINES).otherwise(NO_LINKS)).alias("context"))


