"""Mapping freely typed values to the entries of a reference list.

Distinct values are normalised (character form, case, accents, punctuation, lead-in, small words); their character n-grams look candidates up
in the inverted index of the reference names, rare n-grams first and only as many of them as a name of the least cosine must share one of, and
candidates are scored by the idf-weighted cosine.  A value is mapped to the best entry if its cosine reaches the threshold `accept`, exceeds
that of every other entry by the margin `clear`, and all of the value's words that the list knows are words of the entry.  What lies below, within the
margin, or holds a word of other names is decided by an exact count of the slips that separate value and name: they must stay within what the name's
length allows, and no other entry may come as near; else the value is reported as unmatched.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.session import stage

# Words that never decide what a value names.
SMALL = frozenset("a an the this that these those another some any its their our his her it of in on at by to as is was be been being there here today now yesterday then just also very please reported report alleged so called and or for with from".split())
_LEAD = re.compile(r"\b(\w+):(?=\W*\w)")
LEADS = ("relation", "event", "type", "label", "answer", "span", "source", "target", "output")
#: Words that turn a name into another one; they are never small.
NEGATIONS = frozenset("no not non none never without".split())
_GENITIVE = re.compile(r"(?<=\w)['’`´]s\b")
_WORD = re.compile(r"[^\W_]+")


def normalise(value: str) -> list[str]:
    """The words of a value in one character form: compatibility forms, case, accents, punctuation, genitive s and a lead-in gone."""
    text = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value).casefold()) if not unicodedata.combining(c))
    text = _GENITIVE.sub("", text)
    return _WORD.findall(_LEAD.sub(lambda m: "" if m[1] in LEADS or any(len(x) > 4 and slips(m[1], x, 2) <= 2 for x in LEADS) else m[0], text))


def stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] != "s" else word


def core(ws: list[str], strict: bool = False) -> list[str]:
    """Words without the small ones and the plural s; all of them if nothing else is left.  strict: small words with a slip go too."""
    return [stem(w) for w in ws if not (_filler(w) if strict else w in SMALL)] or [stem(w) for w in ws]


def grams(ws: list[str]) -> list[str]:
    """Distinct character 2- and 3-grams of the core words, with marks at word borders, and the words themselves."""
    out = {f"={w}" for w in core(ws)}  # whole words too
    for w in core(ws):
        w = f"^{w}$"
        out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
    return sorted(out)


def slips(a: str, b: str, most: int) -> int:
    """Letters inserted, deleted, replaced or swapped with their neighbour between a and b; most + 1 if more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    if most < 1:
        return 1
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a:
        return len(b)
    # distances down the columns of the table as bits of their differences, one column for each letter of b
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    last = 1 << len(a) >> 1
    up, down, level, before, d = full, 0, 0, 0, len(a)
    for j, y in enumerate(b, 1):
        here = at.get(y, 0)
        swapped = ((~level & here) << 1) & before
        level = (((here & up) + up) ^ up) | here | down | swapped
        more, less = down | ~(level | up) & full, level & up
        d += (more & last > 0) - (less & last > 0)
        if d - (len(b) - j) > most:
            return most + 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down, before = less | ~(level | more) & full, more & level, here
    return min(d, most + 1)


def allowed(name: str) -> int:
    """Slips that a name of this length may suffer."""
    return max(1, min(5, round(len(name) * 0.3)))


def _filler(word: str) -> bool:
    """A small word, or one with a slip in it."""
    return word in SMALL or word not in NEGATIONS and any(slips(word, s, 1) < 2 for s in SMALL if len(s) > 1)


def _run_together(text: str, name: list[str]) -> set[tuple[str, str]]:
    """For a value without spaces: the name's turns, also around "of", and the value without a small word at either end."""
    ends = {text} | {text[len(s) :] for s in SMALL if text.startswith(s)} | {text[: -len(s)] for s in SMALL if text.endswith(s)}
    turns = {"".join(name)} | {"".join(name[k:]) + glue + "".join(name[:k]) for k in range(1, len(name)) for glue in ("", "of", "ofthe")}
    return {(e, t) for e in ends for t in turns}


def apart(value: list[str], name: list[str]) -> int | None:
    """Slips between a value and a name, over turns of the word order and with or without small words; None: not the same."""
    v, n = core(value), core(name)
    if len(v) > len(n):
        v = core(value, strict=True)
    forms = [({("".join(v[k:] + v[:k]), "".join(n)) for k in range(len(v))}, len(v) <= len(n)), ({("".join(value), "".join(name))}, len(value) <= len(name))]
    if len(value) == 1 < len(n):
        forms.append((_run_together(value[0], n) | _run_together(value[0], name), True))
    best = None
    for pairs, free in forms:
        for a, b in pairs:
            most = allowed(b) if free else 1
            d = slips(a, b, most if best is None else min(most, best))
            if d <= most and (best is None or d < best):
                best = d
            if best == 0:
                return 0
    return best


def _other_word(value: list[str], name: list[str], rest: set[str]) -> bool:
    """Whether a word of the value is a word of other names, or three slips or more from this one's and closer to one of those."""
    v, n = core(value), core(name)
    if len(v) > len(n):
        v = core(value, strict=True)
    if len(v) < len(n):
        return False  # words run together have no borders
    for w in v:
        own = min(slips(w, x, len(w)) for x in n)
        near = 0 if 0 < own < 3 else own - 1
        if own and any(slips(w, x, near) <= near for x in rest - set(n)):
            return True
    return False


def decide(value: list[str], candidates: list[tuple[int, list[str], float]], margin: float, known: frozenset[str] = frozenset()) -> int | None:
    """The entry that candidates (entry, name, cosine) give for a value; known: words of the value that the reference list has, which
    are no slips."""
    words = sorted(core(value))
    exact = {entry for entry, name, _ in candidates if sorted(core(name)) == words}
    if len(exact) == 1:
        return exact.pop()
    near: dict[int, tuple[int, float]] = {}
    own: dict[int, set[str]] = {}
    for entry, name, _ in candidates:
        own.setdefault(entry, set()).update(core(name))
    rest = set().union(*own.values()) | known
    for entry, name, cosine in candidates:
        d = apart(value, name)
        if d is not None and not (d and _other_word(value, name, rest - own[entry])):
            near[entry] = min(near.get(entry, (99, 0.0)), (d, -cosine))
    if not near:
        return None
    order = sorted((v, k) for k, v in near.items())
    if len(order) > 1 and order[0][0][0] == order[1][0][0] and order[1][0][1] - order[0][0][1] < margin:
        return None
    return order[0][1]


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([" ".join(normalise(v)) for v in b.column(b.num_columns - 1).to_pylist()], pa.string())], names=[*b.schema.names, "norm"])


def _grammer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([grams(n.split()) for n in b.column("norm").to_pylist()], pa.list_(pa.string()))], names=[*b.schema.names, "grams"])


class Index:
    """The inverted index of some names of one kind, as arrays: for each n-gram the names that have it and their share of unit length."""

    def __init__(self, names: list[tuple[int, str]], grams_: list[str], idf: np.ndarray, begin: np.ndarray, name: np.ndarray, weight: np.ndarray):
        self.names, self.idf, self.begin, self.name, self.weight = names, idf, begin, name, weight
        self.at = {g: k for k, g in enumerate(grams_)}

    @staticmethod
    def plain(rows: pa.Table) -> tuple:
        """The arguments of an index from postings (entry_id, name, gram, idf, weight)."""
        names = sorted(set(zip(rows.column("entry_id").to_pylist(), rows.column("name").to_pylist(), strict=True)))
        number = {n: k for k, n in enumerate(names)}
        own = np.array([number[n] for n in zip(rows.column("entry_id").to_pylist(), rows.column("name").to_pylist(), strict=True)], np.int64)
        code = rows.column("gram").combine_chunks().dictionary_encode()
        if isinstance(code, pa.ChunkedArray):
            code = code.combine_chunks()
        gram = code.indices.to_numpy().astype(np.int64)
        order = np.lexsort((own, gram))
        begin = np.searchsorted(gram[order], np.arange(len(code.dictionary) + 1))
        return names, code.dictionary.to_pylist(), rows.column("idf").to_numpy()[order][begin[:-1]], begin, own[order], rows.column("weight").to_numpy()[order]

    def candidates(self, words: list[str], least: float, unknown: float) -> tuple[list[tuple[int, list[str], float]], set[str]]:
        """(entry, words of the name, cosine) of all names from the cosine `least` on, and the value's words that the names have."""
        given = grams(words)
        ids = np.array(sorted(k for g in given if (k := self.at.get(g)) is not None), np.int64)
        known = {g[1:] for g in given if g[0] == "=" and g in self.at}
        if not len(ids):
            return [], known
        ids = ids[np.argsort(-self.idf[ids], kind="stable")]
        w = self.idf[ids]
        own = math.sqrt(float((w * w).sum()) + unknown * unknown * (len(given) - len(ids)))
        rest = np.cumsum((w * w)[::-1])[::-1]  # what the n-grams from here on can add at most, squared
        first = int((rest >= (least * own) ** 2 * (1 - 1e-9)).sum())  # a name that shares none of these is below `least`
        begin, size = self.begin[ids[:first]], self.begin[ids[:first] + 1] - self.begin[ids[:first]]
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        dots = np.bincount(self.name[at], weights=self.weight[at] * np.repeat(w[:first], size), minlength=len(self.names)).astype(np.float64)
        found = np.flatnonzero(dots)
        for k in range(first, len(ids)):
            a, b = self.begin[ids[k]], self.begin[ids[k] + 1]
            at = np.minimum(np.searchsorted(self.name[a:b], found), b - a - 1)
            there = self.name[a:b][at] == found
            dots[found[there]] += w[k] * self.weight[a:b][at[there]]
        cosine = dots[found] / own
        return [(self.names[k][0], self.names[k][1].split(), c) for k, c in zip(found[cosine >= least].tolist(), cosine[cosine >= least].tolist(), strict=True)], known


def scored(candidates: list[tuple[int, list[str], float]], known: set[str], accept: float, clear: float) -> int | None:
    """The entry that the cosines alone decide for: at least `accept`, by `clear` ahead of every other entry, with all known words."""
    best: dict[int, float] = {}
    for entry, _, cosine in candidates:
        best[entry] = max(best.get(entry, 0.0), cosine)
    order = sorted(((c, e) for e, c in best.items()), reverse=True)[:2]
    if not order or order[0][0] < accept or len(order) > 1 and order[0][0] - order[1][0] < clear:
        return None
    own = {w for entry, name, _ in candidates if entry == order[0][1] for w in core(name)}
    return order[0][1] if known <= own else None


def postings(entries: DataFrame) -> DataFrame:
    """(kind, entry_id, name, gram, idf, weight): the n-grams of each distinct normalised name, their idf over the names of a kind, and their
    share of the name's unit length."""
    names = entries.select("kind", F.col("entry_id").cast("bigint").alias("entry_id"), F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.where(F.col("name").rlike(r"(?U)\S")).distinct().mapInArrow(_normaliser, "kind string, entry_id bigint, name string, norm string")
    names = stage(names.select("kind", "entry_id", "norm").where("norm <> ''").distinct().mapInArrow(_grammer, "kind string, entry_id bigint, norm string, grams array<string>"))
    total = names.groupBy("kind").agg(F.countDistinct("norm").alias("names"))
    post = names.select("kind", "entry_id", F.col("norm").alias("name"), F.explode("grams").alias("gram"))
    idf = post.groupBy("kind", "gram").agg(F.countDistinct("name").alias("df")).join(F.broadcast(total), "kind").select("kind", "gram", F.log1p(F.col("names") / F.col("df")).alias("idf"))
    post = stage(post.join(idf, ["kind", "gram"]))
    length = post.groupBy("kind", "entry_id", "name").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("length"))
    return post.join(length, ["kind", "entry_id", "name"]).select("kind", "entry_id", "name", "gram", "idf", (F.col("idf") / F.col("length")).alias("weight"))


_FOUND = "kind string, value string, norm string, found array<struct<entry_id:bigint,name:string,cosine:double>>, known array<string>"


def map_values(values: DataFrame, entries: DataFrame, least: float = 0.2, accept: float = 0.7, clear: float = 0.1, margin: float = 0.02, unknown: float = 2.0, held: int = 4_000_000) -> DataFrame:
    """(kind, value, entry_id, cosine) for each distinct non-blank value of values (kind, value); entry_id -1: it names no entry.

    entries is (entry_id, kind, label, aliases).  least: cosine from which a name is a candidate; accept, clear: cosine and margin from which the
    cosines decide; margin: by how much the cosine of the entry of fewest slips must exceed that of another with as few; unknown: weight of an
    n-gram that no name has.  Tasks hold the index of names in blocks of about `held` postings (12 bytes and a share of their n-gram each), so
    what is broadcast at once is bounded; with more than one block candidates come together by value, without a cap.  Null and blank values have
    no row; without entries every value gets -1; entries without label and aliases match nothing; ties between entries are unmatched.
    """
    spark = values.sparkSession
    sc = spark.sparkContext
    index = stage(postings(entries))
    blocks = max(1, -(-index.count() // held))
    distinct = stage(values.select("kind", "value").where(F.col("value").rlike(r"(?U)\S")).distinct())
    # few bytes of values are work for all tasks
    given = distinct.repartition(max(sc.defaultParallelism, distinct.count() // 50_000), "kind", "value")

    def decided(words: list[str], found: list[tuple[int, list[str], float]], known: set[str]) -> tuple[int, float]:
        entry = scored(found, known, accept, clear) if words else None
        if entry is None and words:
            entry = decide(words, found, margin, frozenset(known))
        return -1 if entry is None else entry, max((c for *_, c in found), default=0.0)

    def block(rows: DataFrame):
        plain = rows.toArrow()
        return sc.broadcast({k: Index.plain(plain.filter(pa.compute.equal(plain.column("kind"), k))) for k in pa.compute.unique(plain.column("kind").drop_null()).to_pylist()})

    def searcher(shared, alone: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = {k: Index(*v) for k, v in shared.value.items()}
            memo: dict[tuple[str | None, str], tuple] = {}
            for b in batches:
                out = []
                for kind, value in zip(*(b.column(c).to_pylist() for c in ("kind", "value")), strict=True):
                    words = normalise(value)
                    key = kind, " ".join(words)
                    if key not in memo:
                        if len(memo) > 100_000:
                            memo.clear()
                        found, known = indexes[kind].candidates(words, least, unknown) if kind in indexes and words else ([], set())
                        memo[key] = decided(words, found, known) if alone else (key[1], [{"entry_id": e, "name": " ".join(n), "cosine": c} for e, n, c in found], sorted(known))
                    out.append((kind, value, *memo[key]))
                cols = list(zip(*out, strict=True)) or [()] * (4 if alone else 5)
                types = (pa.string(), pa.string(), pa.int64(), pa.float64()) if alone else (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("entry_id", pa.int64()), ("name", pa.string()), ("cosine", pa.float64())])), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "value", "entry_id", "cosine"] if alone else ["kind", "value", "norm", "found", "known"])

        return search

    out_schema = "kind string, value string, entry_id bigint, cosine double"
    if blocks == 1:
        return given.mapInArrow(searcher(block(index), True), out_schema)
    of = F.pmod(F.xxhash64("name"), F.lit(blocks))
    parts = [given.mapInArrow(searcher(block(index.where(of == k)), False), _FOUND) for k in range(blocks)]
    both = functools.reduce(DataFrame.unionAll, parts).groupBy("kind", "value", "norm").agg(F.flatten(F.collect_list("found")).alias("found"), F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decided(n.split(), [(c["entry_id"], c["name"].split(), c["cosine"]) for c in found], set(known)) for n, found, known in zip(*(b.column(c).to_pylist() for c in ("norm", "found", "known")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["kind", "value", "entry_id", "cosine"])

    return both.mapInArrow(choose, out_schema)


#: The columns of predictions and the kind of entry that each names.
FIELDS = {"pred_relation_type": "relation_type", "pred_source_span": "event_span", "pred_target_span": "event_span"}


def prediction_values(predictions: DataFrame) -> DataFrame:
    """(pred_id, field, kind, value), one row for each non-blank value of the three typed columns."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).alias("value")) for f, k in FIELDS.items()))
    return predictions.select("pred_id", F.explode(each).alias("x")).select("pred_id", "x.*").where(F.col("value").rlike(r"(?U)\S"))


def canonical(predictions: DataFrame, entries: DataFrame) -> DataFrame:
    """(pred_id, field, entry_id) for each non-blank typed value of predictions; -1: it names no entry."""
    rows = prediction_values(predictions)
    return rows.join(map_values(rows, entries), ["kind", "value"]).select("pred_id", "field", "entry_id")
