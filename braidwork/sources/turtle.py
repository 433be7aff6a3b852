"""Turtle: triples of a document, OWL classes, and lines with an index of their IRIs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.session import file_state, stage

# Names of the RDF, RDFS, OWL and SKOS vocabularies.
RDF, RDFS, OWL, SKOS, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/2001/XMLSchema#"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "xsd": XSD}
TRIPLES = "s string, p string, o string, o_is_iri boolean"

_TOKEN = re.compile(
    r"""\s+ | \#[^\n]* | (?P<iri><[^<>"{}|^`\\\s]*>) | (?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''') | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*) | (?P<type>\^\^) | (?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:])) | (?P<mark>[;,.\[\]()])
    | (?P<name>_:[\w-]+|[\w.-]*:[\w%-]*(?:\.[\w%-]+)*|[A-Za-z]+) | (?P<other>.)""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text)


def parse(text: str, prefixes: dict[str, str] | None = None) -> Iterator[tuple[str, str, str, bool]]:
    """(s, p, o, o_is_iri) of a Turtle text: prefixes, a, lists of predicates and objects, literals of all forms, anonymous nodes.

    A statement that can't be read is left out up to its full stop, so cut-off texts give what is whole in them.  Languages and
    types of literals are not kept.
    """
    known = PREFIXES | (prefixes or {})
    base = ""
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup]
    blank = 0
    i = 0

    def node(kind: str, word: str) -> tuple[str, bool] | None:
        if kind == "iri":
            iri = _plain(word[1:-1])
            return (iri if ":" in iri else base + iri, True)
        if kind == "name":
            if word == "a":
                return (f"{RDF}type", True)
            if word in ("true", "false"):
                return (word, False)
            prefix, colon, local = word.partition(":")
            if prefix == "_" and colon:
                return (word, True)
            return (known[prefix] + local, True) if colon and prefix in known else None
        if kind == "string":
            return (_plain(word[1:-1]), False)
        if kind == "long":
            return (_plain(word[3:-3]), False)
        return (word, False) if kind == "number" else None

    while i < len(tokens):
        kind, word = tokens[i]
        if word.lower() in ("@prefix", "prefix", "@base", "base"):
            if "base" in word.lower() and i + 1 < len(tokens) and tokens[i + 1][0] == "iri":
                base = tokens[i + 1][1][1:-1]
                i += 2
            elif i + 2 < len(tokens) and tokens[i + 2][0] == "iri":
                known[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1][1:-1]
                i += 3
            else:
                i += 1
            if i < len(tokens) and tokens[i][1] == ".":
                i += 1
            continue
        out: list[tuple[str, str, str, bool]] = []
        stack: list[tuple[str, str | None]] = []
        subject = predicate = None
        good = True
        while i < len(tokens):
            kind, word = tokens[i]
            i += 1
            if kind == "mark":
                if word == "." and not stack:
                    break
                if word == ";":
                    predicate = None
                elif word == "[":
                    blank += 1
                    own = f"_:anon{blank}"
                    if subject is not None and predicate is not None:
                        out.append((subject, predicate, own, True))
                    stack.append((subject or own, predicate))
                    subject, predicate = own, None
                elif word == "]" and stack:
                    subject, predicate = stack.pop()
                elif word == ",":
                    pass
                else:
                    good = False
                continue
            if kind == "lang":
                continue
            if kind == "type":
                i += 1
                continue
            got = node(kind, word)
            if got is None:
                good = False
            elif subject is None:
                subject = got[0]
            elif predicate is None:
                predicate = got[0]
            else:
                out.append((subject, predicate, *got))
        if good:
            yield from out


def triples(texts: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """SRC8: (key, s, p, o, o_is_iri) of a column of Turtle texts, each parsed by its own; distributed over texts."""
    schema = (f"{key} {texts.schema[key].dataType.simpleString()}, " if key else "") + TRIPLES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist() if key else [None] * b.num_rows
            rows = [(k, *t) for k, x in zip(keys, b.column(b.num_columns - 1).to_pylist(), strict=True) if x for t in parse(x)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            data = [pa.array(c, t) for c, t in zip(cols[1:], (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)]
            if key:
                data.insert(0, pa.array(cols[0], b.schema.types[0]))
            yield pa.RecordBatch.from_arrays(data, names=([key] if key else []) + ["s", "p", "o", "o_is_iri"])

    return texts.select(*([key] if key else []), text).mapInArrow(read, schema)


def load(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: triples of Turtle files."""
    return triples(spark.read.text(path, wholetext=True), "value")


def concepts(rdf: DataFrame) -> DataFrame:
    """SRC8: (uri, label, description, aliases) of the OWL classes: the smallest rdfs:label, else skos:prefLabel, else the end of the
    IRI; all skos:altLabel; the smallest rdfs:comment."""
    classes = rdf.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{OWL}Class") & ~F.col("s").startswith("_:")).select("s").distinct()
    said = rdf.where(~F.col("o_is_iri")).join(classes, "s", "right")
    pick = lambda name: F.min(F.when(F.col("p") == name, F.col("o")))
    end = F.regexp_extract("s", r"([^/#]*)$", 1)
    out = said.groupBy("s").agg(pick(f"{RDFS}label").alias("a"), pick(f"{SKOS}prefLabel").alias("b"), pick(f"{RDFS}comment").alias("description"), F.array_sort(F.collect_set(F.when(F.col("p") == f"{SKOS}altLabel", F.col("o")))).alias("aliases"))
    return out.select(F.col("s").alias("uri"), F.coalesce("a", "b", end).alias("label"), "description", "aliases")


_KEPT: dict[str, tuple[tuple[int, int], DataFrame]] = {}


def cached(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: the triples of a file or folder, parsed once into the shared folder until its size or time of change is another."""
    now = file_state(spark, path)
    if path not in _KEPT or _KEPT[path][0] != now or _KEPT[path][1].sparkSession is not spark:
        _KEPT[path] = now, stage(load(spark, path), keep=True)
    return _KEPT[path][1]


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """SRC10: (key, line, text) of the lines of texts, counted from 0."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text"))


def line_index(lines_: DataFrame, key: str) -> DataFrame:
    """SRC10: (key, uri, line): where each <IRI> stands."""
    return lines_.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"<([^>\s]+)>"), 1)).alias("uri"), "line").distinct()
