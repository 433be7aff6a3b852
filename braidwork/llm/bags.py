"""Exact candidates for near-same texts: a prefix-filter join on the words of each text as a bag.

Near-same texts of x and y words differ, in either direction, in at most one in `one_in` of the larger one's words, so with L = max(x, y)
their bags (a word's k-th occurrence is an element of its own) share at least L - L // one_in elements, whatever the order of the words.
With the elements in one global order from rare to frequent, the first x // one_in + 1 elements of each text then share one: only these
are joined, and no near-same pair is missed.  A hit counts only if the lengths fit (length filter), both places lie in the prefixes that
a pair of these lengths needs (position filter), and the parities of the elements in 256 buckets, 512 for long texts, differ in no more
buckets than the bags may differ in elements (parity filter).  Each filter is a bound that holds for all near-same pairs.  All are applied
within the join, before anything is shuffled by pair.

Order: element counts over all texts, in a count-min sketch of fixed size (2 x 65536 counters); any order is correct, a good one makes hits
few.  Equal hashes of different elements only add hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm import sketch
from braidwork.llm.texts import fingerprint
from braidwork.llm.words import many, mix, words

#: Slots of each of the sketch's two rows; texts that are handled at once.
_SLOTS, _TEXTS = 1 << 16, 1000
#: Longs of a signature (one bit a bucket): the first half is the signature folded once; the second is filled from so many words on.
_LONGS, WIDE = 8, 250
#: Number of words and place are packed into one long.
_PLACE = 31


def bags(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the elements of the bags of many(), and the text of each; the k-th occurrence of a word is an element of its own."""
    text = np.repeat(np.arange(len(size)), size)
    h = h[np.lexsort((h, text))]
    place = np.arange(len(h))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    occurrence = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix(mix(h + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), text


def signatures(g: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(texts, _LONGS) parities of each text's elements by bucket: folded to half of the buckets, then the upper half, 0 for texts below
    WIDE words."""
    n, buckets = len(size), 64 * _LONGS
    odd = np.bincount(text * buckets + (g & np.uint64(buckets - 1)).astype(np.int64), minlength=n * buckets) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(n, _LONGS)
    low, high = bits[:, : _LONGS // 2], bits[:, _LONGS // 2 :]
    return np.concatenate([low ^ high, np.where((size >= WIDE)[:, None], high, np.uint64(0))], 1)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(48)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(_SLOTS - 1)).astype(np.int64)


def ranks(rare: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How frequent each element is over all texts, on the scale of rarity()."""
    one, two = _slots(g)
    return np.minimum(rare[0][one], rare[1][two]).astype(np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], names: list[str], least: int) -> Iterator[tuple[list, ...]]:
    """The named columns and the words of the texts that are long enough, some at once."""
    for whole in batches:
        for b in (whole.slice(k, _TEXTS) for k in range(0, whole.num_rows, _TEXTS)):
            rows = [(*own, ws) for *own, text in zip(*(b.column(n).to_pylist() for n in (*names, "text")), strict=True) if len(ws := words(text)) >= least]
            if rows:
                yield tuple(map(list, zip(*rows, strict=True)))


def measured(docs: DataFrame, least: int) -> DataFrame:
    """(id, ..., hi, lo, block, salt, counts): the fingerprints of the texts (id, ..., text) of at least `least` words, with the columns
    beside, and in other rows (those with a block) the tasks' counts of elements."""
    own = [c for c in docs.columns if c != "text"]
    kinds = [docs.schema[c].dataType for c in own]
    ends = [("hi", "bigint"), ("lo", "bigint"), ("block", "int"), ("salt", "int"), ("counts", "binary")]
    names = [*own, *(n for n, _ in ends)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        typed = [types[k] for k in (*simple, *(k for _, k in ends))]
        counts = np.zeros((2, _SLOTS), np.int64)
        for *cols, texts in _texts(batches, own, least):
            g, _ = bags(*many(texts))
            for row, slots in zip(counts, _slots(g), strict=True):
                row += np.bincount(slots, minlength=_SLOTS)
            full = [*cols, *zip(*map(fingerprint, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(full, typed)] + [pa.nulls(len(texts), t) for t in typed[-3:]], names=names)  # noqa: B905
        rows = sketch.pack(counts.ravel(), TaskContext.get().partitionId())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for t in typed[:-3]] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), typed[-3:], strict=True)], names=names)

    simple = [k.simpleString() for k in kinds]
    return docs.mapInArrow(measure, ", ".join(f"{n} {k}" for n, k in [*zip(own, simple, strict=True), *ends]))


def rarity(kept: DataFrame):
    """The broadcast counts of elements of measured(), on a scale of 8 steps a doubling, in 8 bits."""
    counts = sketch.total(kept.where("block IS NOT NULL").select("block", "salt", "counts"), 2 * _SLOTS)
    return kept.sparkSession.sparkContext.broadcast(np.minimum(255, np.log2(counts.reshape(2, _SLOTS) + 1.0) * 8).astype(np.uint8))


def _prefixes(docs: DataFrame, name: str, least: int, one_in: int, table, index: bool) -> DataFrame:
    """(key, <name>, p<name>, <name>1 ...): a row for each element of the prefixes of docs (id, text); in the index for two classes of length."""
    step = 2.002 * math.log(one_in / (one_in - 1))  # a class is twice as wide as lengths of near-same texts may lie apart, and a little
    names = ["key", name, f"p{name}", *(f"{name}{k}" for k in range(_LONGS))]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = table.value
        seen: set[tuple] = set()
        for ids, texts in _texts(batches, ["id"], least):
            new = []
            for k, ws in enumerate(texts):  # a copy in this task is left out; other tasks' copies fall together by class
                own = fingerprint(ws)
                if own not in seen:
                    new.append(k)
                    if len(seen) < 200_000:
                        seen.add(own)
            if not new:
                continue
            h, size = many([texts[k] for k in new])
            g, t = bags(h, size)
            bits = signatures(g, t, size).view(np.int64)
            rank = ranks(rare, g)
            # text, rarity, hash: sorted, each text's elements stand from rare to frequent
            order = np.sort((t.astype(np.uint64) << np.uint64(50)) | (rank << np.uint64(42)) | (g & np.uint64((1 << 42) - 1)))
            place = np.arange(len(t)) - (np.cumsum(size) - size)[t]
            first = place <= size[t] // one_in
            t, place = t[first], place[first]
            length = np.log(size) / step
            bucket = length.astype(np.int64)
            nearer = np.where(length - bucket < 0.5, -1, 1)  # so partners are in the own class or in the one that is nearer
            base = (order[first] & np.uint64((1 << 42) - 1)) << np.uint64(8)
            row = [np.array([ids[k] for k in new], np.int64)[t], (size[t] << _PLACE) | place, *bits[t].T]
            for own_class in (bucket, bucket + nearer) if index else (bucket,):
                key = base | (own_class[t] & 255).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, map(np.ascontiguousarray, row))], names=names)

    return docs.select("id", "text").mapInArrow(prefixes, ", ".join(f"{n} bigint" for n in names))


def _may(one_in: int) -> Column:
    """Whether a hit of the texts e and t passes the length, position and parity filter."""
    long = "greatest(shiftright(pe, 31), shiftright(pt, 31))"
    need = f"({long} - {long} div {one_in})"
    fits = f"({long} - least(shiftright(pe, 31), shiftright(pt, 31))) * {one_in} <= {long}"
    placed = " AND ".join(f"({p} & {(1 << _PLACE) - 1}) <= shiftright({p}, 31) - {need}" for p in ("pe", "pt"))
    apart = f"shiftright(pe, 31) + shiftright(pt, 31) - 2 * {need}"
    half = _LONGS // 2
    folded = " + ".join(f"bit_count(e{k} ^ t{k})" for k in range(half))
    wide = " + ".join(f"bit_count(e{k + half} ^ t{k + half}) + bit_count(e{k} ^ t{k} ^ e{k + half} ^ t{k + half})" for k in range(half))
    short = f"least(shiftright(pe, 31), shiftright(pt, 31)) < {WIDE}"
    return F.expr(f"{fits} AND {placed} AND {folded} <= {apart} AND ({short} OR {wide} <= {apart})")


def candidates(left: DataFrame, right: DataFrame, table, least: int, one_in: int) -> DataFrame:
    """(e, t), each once: all pairs of ids of left and right (id, text) whose texts may be near-same."""
    index, probe = _prefixes(left, "e", least, one_in, table, True), _prefixes(right, "t", least, one_in, table, False)
    return index.join(probe, "key").where(_may(one_in)).select("e", "t").distinct()
