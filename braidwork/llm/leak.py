"""Evaluation texts leaking into training text, by latent semantic retrieval and alignment of the candidates.

Item and document passages are short windows of words.  A randomised SVD of the TF-IDF matrix of passages (word buckets of fixed number, idf
over all documents) gives a latent space; its range finder runs as Spark jobs over a bounded sample of passages (SAMPLE of the documents' and
SAMPLE of the items', both by hash), and every window of every document is projected.  As word vectors add up, a document's windows are sums of
sums of its steps.  Item windows lie in cells around about twice the square root of their number of centres; a document window is compared with
the centres, and with the members of those cells only that may hold a window within the cosine threshold, an exact bound.  A document and an item
of which two windows reach the threshold are a candidate at the place where the windows meet.  Those that share too few neighbouring words for any
run with the allowed alterations go (an exact bound); of the others the longest common subsequence of the words there must hold a run with the
asked share of the item and few alterations.  An answer, number or name that was changed counts as an alteration like any word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import sketch
from braidwork.llm.words import hashes, many, many_shingles, mix, words
from braidwork.session import stage

#: Word buckets, latent dimensions (and spare ones of the range finder), passages of documents, and of items, that fit the basis at most, and
#: words by which two windows that meet may be shifted.
BUCKETS, DIMS, SPARE, SAMPLE, SLIDE = 1 << 15, 64, 8, 20_000, 16
#: Item windows from which they are put into cells.
CELLS = 8192
#: Texts handled at once, of these whose vectors stay in the cache, and places of the flags of their neighbouring words.
_TEXTS, _CACHED, _FLAGS = 400, 32, 1 << 22
#: Windows whose cosines are made at once.
_ROWS = 128
_KEPT = "block int, salt int, counts binary, rank bigint, words array<int>"


def scales(n: int, share: float = 0.55) -> tuple[int, int]:
    """Words of a window and step between windows of a document for items of n words, so that a run of the asked share of the item
    always holds a whole window."""
    run = int(share * n)
    return (16, 8) if run >= 24 else (10, 5) if run >= 15 else (max(3, run // 2), max(1, run // 2))


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(49)).astype(np.int32)


@dataclass
class Basis:
    """idf-weighted latent vectors of the word buckets."""

    vectors: np.ndarray

    def windows(self, b: np.ndarray, size: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of the windows of texts (buckets b of all, words by text), the text and the first word of each: begun every `step`
        words, from sums of steps; the last window ends with the text, and a shorter text is one window."""
        each = max(k for k in (width, step) if not (width % k or step % k)) if not (width % step and step % width) else 1
        begin = np.cumsum(size) - size
        parts = -(-size // each)
        text = np.repeat(np.arange(len(size)), parts)
        within = np.arange(len(text)) - (np.cumsum(parts) - parts)[text]
        sums = np.add.reduceat(self.vectors[b], begin[text] + within * each, axis=0)
        first = np.flatnonzero((within * each % step == 0) & ((within * each + width <= size[text]) | (within == 0)))
        x, of, at = sums[first].copy(), text[first], within[first] * each
        for k in range(1, width // each):
            more = np.flatnonzero(within[first] + k < parts[of])
            x[more] += sums[first[more] + k]
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
        short = last[(at[last] + width < size[of[last]])]
        tail = self.vectors[b[(begin + size)[of[short]][:, None] - np.arange(width, 0, -1)[None, :]]].sum(1)
        x, of, at = np.concatenate([x, tail]), np.concatenate([of, of[short]]), np.concatenate([at, size[of[short]] - width])
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6), of, at


def _measure(rate: float, step: int = 16):
    """Tasks' counts of the documents that hold each word bucket, and a hash-chosen share of the passages of 16 words, begun every `step`."""
    cut = int(rate * (2**63 - 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            picked = []
            for b in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                h, size = many([words(t) for t in b.column("text").to_pylist()])
                w, text = buckets(h), np.repeat(np.arange(len(size)), size)
                count += np.bincount(np.unique((text << 16) | w) & 0xFFFF, minlength=BUCKETS)
                begin = np.cumsum(size) - size
                place = np.arange(len(w)) - begin[text]
                start = np.flatnonzero((place % step == 0) & ((place + 16 <= size[text]) | (place == 0)))
                rank = (mix(mix((b.column("id").to_numpy()[text[start]] * 1000003 + place[start]).view(np.uint64))) >> np.uint64(1)).astype(np.int64)
                picked += [(int(r), w[k : min(k + 16, begin[text[k]] + size[text[k]])].tolist()) for r, k in zip(rank[rank <= cut], start[rank <= cut], strict=True)]
            if picked:
                m = len(picked)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array([p[0] for p in picked], pa.int64()), pa.array([p[1] for p in picked], pa.list_(pa.int32()))], names=["block", "salt", "counts", "rank", "words"])
        rows = sketch.pack(count, TaskContext.get().partitionId())
        if rows:
            m = len(rows)
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32()))], names=["block", "salt", "counts", "rank", "words"])

    return measure


def _product(idf, basis):
    """Tasks' parts of A'(A Q) for the TF-IDF rows A of the sample (unit length)."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = basis.value, idf.value
        out = np.zeros((BUCKETS, q.shape[1]), np.float32)
        for b in batches:
            lists = b.column(0)
            flat = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            flat, row = flat[: size.sum()], np.repeat(np.arange(len(size)), size)
            # term frequency counts: repeated words stand as often in flat, so entries of one row add up
            w = weight[flat]
            tf = np.zeros(len(size))
            code, inverse = np.unique(row.astype(np.int64) * BUCKETS + flat, return_inverse=True)
            value = np.bincount(inverse, weights=w)
            r, c = code // BUCKETS, code % BUCKETS
            tf = np.sqrt(np.bincount(r, weights=value * value, minlength=len(size)))
            value = (value / np.maximum(tf[r], 1e-9)).astype(np.float32)
            start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            y = np.add.reduceat(value[:, None] * q[c], start, axis=0)
            back = value[:, None] * y[np.searchsorted(r[start], r)]
            order = np.argsort(c, kind="stable")
            at = np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1]))
            out[c[order][at]] += np.add.reduceat(back[order], at, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(out.tobytes(), 1)], pa.large_binary())], names=["part"])

    return product


def fit(sample: DataFrame, idf: np.ndarray, seed: int = 7, rounds: int = 3) -> Basis:
    """The latent space of a sample of passages (words array<int>): randomised range finder with subspace iteration; each product with
    the sample is a Spark job whose tasks return one matrix of fixed size."""
    sc = sample.sparkSession.sparkContext
    weight = sc.broadcast(idf.astype(np.float32))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, DIMS + SPARE)).astype(np.float32))[0]
    for _ in range(rounds):
        z = np.zeros_like(q)
        for r in sample.mapInArrow(_product(weight, sc.broadcast(q)), "part binary").toLocalIterator():
            z += np.frombuffer(zlib.decompress(r.part), np.float32).reshape(z.shape)
        small = q.T @ z
        last, q = q, np.linalg.qr(z)[0]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = last @ vectors[:, np.argsort(-values)[:DIMS]]
    return Basis((top * idf[:, None]).astype(np.float32))


def subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as places (i, j), by rows of bits."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    rows = [row]
    for x in a:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i and not rows[i] >> (j - 1) & 1:
                continue
            j -= 1
            out.append((i, j))
    return out[::-1]


def longest_run(places: list[tuple[int, int]], one_in: int) -> int:
    """Words of the item in the longest run of matched places with at most one word in `one_in` altered between them."""
    best, n = 0, len(places)
    cost = [0] * n
    for k in range(1, n):
        cost[k] = cost[k - 1] + max(places[k][0] - places[k - 1][0], places[k][1] - places[k - 1][1]) - 1
    for s in range(n):
        if places[-1][0] - places[s][0] + 1 <= best:
            break
        for e in range(n - 1, s, -1):
            size = places[e][0] - places[s][0] + 1
            if size <= best:
                break
            if (cost[e] - cost[s]) * one_in <= max(size, places[e][1] - places[s][1] + 1):
                best = size
                break
    return best


@dataclass
class Item:
    """A passage that may leak, with the places of each of its words as bits."""

    key: int
    words: list[str]

    def __post_init__(self):
        self.bits: dict[str, int] = {}
        for j, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << j

    def common(self, part: list[str], least: float = 0) -> int:
        """Length of the longest common subsequence with a part of a text; 0 if fewer than `least` words of the part are words of the item."""
        full = (1 << len(self.words)) - 1
        row = full
        met = [at for at in map(self.bits.get, part) if at]
        if len(met) < least:
            return 0
        for at in met:
            u = row & at
            row = ((row + u) | (row - u)) & full
        return len(self.words) - row.bit_count()

    def aligned(self, part: list[str], share: float, one_in: int) -> int:
        """Words of the item in its longest run within a part of a text; 0 if it is below `share` of the item."""
        least = share * len(self.words)
        match = least * (1 - 1 / one_in)  # a run of that share with that many alterations matches at least so many words
        if self.common(part, match) < match:
            return 0
        got = longest_run(subsequence(self.words, part), one_in)
        return got if got >= least else 0


def stretches(diagonals: np.ndarray, slack: int) -> list[tuple[int, int]]:
    """Runs (first, last) of sorted diagonals that lie within slack of one another."""
    cut = np.flatnonzero(diagonals[1:] - diagonals[:-1] > slack).tolist()
    return [(int(diagonals[a]), int(diagonals[b])) for a, b in zip([0, *(c + 1 for c in cut)], [*cut, len(diagonals) - 1], strict=True)]


@dataclass
class Cells:
    """Item windows in cells around centres: a window can reach the cosine `threshold` with a member only if its angle to the centre is at
    most the threshold's plus the cell's radius, so most cells are passed over without comparing their members, and no pair is lost."""

    centres: np.ndarray  # (cells, DIMS)
    bound: np.ndarray  # cosine with the centre from which a cell must be looked into
    members: list[np.ndarray]  # (DIMS, windows of the cell)
    item: list[np.ndarray]
    start: list[np.ndarray]
    room: tuple[np.ndarray, np.ndarray] | None = None  # for the cosines of some rows and what reaches the threshold, so that they stay in the cache

    @classmethod
    def of(cls, x: np.ndarray, item: np.ndarray, start: np.ndarray, threshold: float, rounds: int = 4) -> Cells:
        n = len(x)
        k = int(2 * np.sqrt(n)) if n >= CELLS else 1  # below, one product with all costs less than looking for the near ones
        centres = x[np.linspace(0, n - 1, k).astype(np.int64)].copy()
        for _ in range(rounds):
            own = np.concatenate([(x[c : c + 8192] @ centres.T).argmax(1) for c in range(0, n, 8192)])
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres)
        own = np.concatenate([(x[c : c + 8192] @ centres.T).argmax(1) for c in range(0, n, 8192)])
        order = np.argsort(own, kind="stable")
        used, begin = np.unique(own[order], return_index=True)
        parts = np.split(order, begin[1:])
        reach = np.arccos(threshold)
        bound = [np.cos(min(np.pi, reach + np.arccos(np.clip((x[p] @ centres[c]).min(), -1, 1)) + 1e-3)) for c, p in zip(used, parts, strict=True)]
        return cls(np.ascontiguousarray(centres[used].T), np.array(bound, np.float32), [np.ascontiguousarray(x[p].T) for p in parts], [item[p] for p in parts], [start[p] for p in parts])

    def plain(self) -> tuple:
        return self.centres, self.bound, self.members, self.item, self.start

    def near(self, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of x, items, starts of their windows) of the windows that reach the threshold, cell by cell."""
        if len(self.members) == 1:
            members = [(0, np.arange(len(x)))]
        else:
            cell, row = np.nonzero(np.ascontiguousarray((x @ self.centres >= self.bound).T))
            cut = np.searchsorted(cell, np.arange(len(self.members) + 1))
            members = [(c, row[cut[c] : cut[c + 1]]) for c in np.flatnonzero(cut[1:] > cut[:-1]).tolist()]
        largest = _ROWS * max(m.shape[1] for m in self.members)
        if self.room is None:
            self.room = np.empty(largest, np.float32), np.empty(largest + 8, bool)
        room, over = self.room
        for c, every in members:
            n = self.members[c].shape[1]
            for rows in (every[k : k + _ROWS] for k in range(0, len(every), _ROWS)):
                size = len(rows) * n
                np.matmul(x[rows], self.members[c], out=room[:size].reshape(len(rows), n))
                np.greater_equal(room[:size], threshold, out=over[:size])
                over[size : size + 8] = False
                eight = np.flatnonzero(over[: -(-size // 8) * 8].view(np.uint64))  # most have none
                if len(eight):
                    at = (eight[:, None] * 8 + np.arange(8)).ravel()
                    at = at[over[at]]
                    yield rows[at // n], self.item[c][at % n], self.start[c][at % n]


@dataclass
class Neighbours:
    """Hashes of the items' neighbouring words, item after item."""

    pairs: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, texts: list[list[str]]) -> Neighbours:
        h, size = many(texts)
        g, text = many_shingles(h, size, 2)
        count = np.bincount(text, minlength=len(size))
        return cls(g, np.cumsum(count) - count, count)


def least_neighbours(n, share: float, one_in: int):
    """Neighbouring words of an item of n words that are neighbours in every text with a run of it: of the run's r words at most r / (one_in - 1) are
    altered, each of which parts two neighbours, so r - 1 - 2 r / (one_in - 1) are left."""
    run = np.ceil(share * n - 1e-9)
    return run - 1 - 2 * run / (one_in - 1)


def _may_hold(g: np.ndarray, text: np.ndarray, doc: np.ndarray, item: np.ndarray, items: Neighbours, share: float, one_in: int) -> np.ndarray:
    """Which pairs of text and item can hold a run, by the hashes of neighbouring words (g, of texts) and least_neighbours()."""
    there = np.zeros(_FLAGS, bool)  # by hash: two pairs of neighbours in one place only let more texts pass
    there[(mix(g ^ mix(text.astype(np.uint64))) & np.uint64(_FLAGS - 1)).astype(np.int64)] = True
    out = np.zeros(len(doc), bool)
    for c in range(0, len(doc), 1 << 14):  # bounded memory
        d, own = doc[c : c + (1 << 14)], item[c : c + (1 << 14)]
        n = items.size[own]
        row = np.repeat(np.arange(len(n)), n)
        asked = mix(items.pairs[np.arange(len(row)) + (items.begin[own] - (np.cumsum(n) - n))[row]] ^ mix(d.astype(np.uint64))[row])
        met = np.bincount(row, weights=there[(asked & np.uint64(_FLAGS - 1)).astype(np.int64)], minlength=len(n))
        out[c : c + (1 << 14)] = met >= least_neighbours(n + 1, share, one_in)
    return out


def _search(basis, shared, threshold: float, share: float, one_in: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, (items, packed) = Basis(basis.value), shared.value
        items, groups = [Item(*x) for x in items], {k: Cells(*v) for k, v in packed.items()}
        neighbours = Neighbours.of([x.words for x in items])
        own = [(neighbours.pairs[b : b + n].tolist(), float(least_neighbours(n + 1, share, one_in))) for b, n in zip(neighbours.begin.tolist(), neighbours.size.tolist(), strict=True)]
        for whole in batches:
            out = []
            for b in (whole.slice(k, _TEXTS) for k in range(0, whole.num_rows, _TEXTS)):
                texts = [(i, ws) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) if (ws := words(t))]
                if not texts:
                    continue
                h, size = many([ws for _, ws in texts])
                w, ends = buckets(h), np.cumsum([0, *size])
                hits: list[tuple] = []
                met = np.zeros(len(texts) * len(items), bool)
                for (width, step), cells in groups.items():
                    for t in range(0, len(texts), _CACHED):
                        x, of, place = space.windows(w[ends[t] : ends[min(t + _CACHED, len(texts))]], size[t : t + _CACHED], width, step)
                        of = (of + t) * len(items)
                        for c in range(0, len(x), 2048):
                            for rows, which, start in cells.near(x[c : c + 2048], threshold):
                                pair = of[c + rows] + which
                                met[pair] = True
                                hits.append((pair, c + rows, place, start))
                pairs = np.flatnonzero(met)
                g, text = many_shingles(h, size, 2)
                met[pairs] = _may_hold(g, text, pairs // len(items), pairs % len(items), neighbours, share, one_in)
                kept = [np.stack([pair[k] // len(items), pair[k] % len(items), place[rows[k]] - start[k]]) for pair, rows, place, start in hits if len(k := np.flatnonzero(met[pair]))]
                if not kept:
                    continue
                found = np.unique(np.concatenate(kept, 1).T, axis=0)
                first = np.searchsorted(text, np.arange(len(texts))).tolist()
                cut = [0, *(np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(1)) + 1).tolist(), len(found)]
                for one in (found[a:b] for a, b in zip(cut, cut[1:])):  # noqa: B905
                    (i, ws), item, (wanted, few) = texts[one[0, 0]], items[one[0, 1]], own[one[0, 1]]
                    begin = first[one[0, 0]]
                    n, best = len(item.words), 0
                    slack = n // one_in + 2 + SLIDE
                    for lo, hi in stretches(one[:, 2], 2 * slack):
                        room = n + 2 * slack  # a run lies wholly within one of the parts of twice that size
                        for at in range(lo - slack, max(hi - slack, lo - slack + 1), room):
                            start, end = max(0, at), max(0, min(at + 2 * room, hi + n + slack, len(ws)))
                            there = set(g[begin + start : begin + max(start, end - 1)].tolist())  # neighbours within the part
                            if sum(map(there.__contains__, wanted)) >= few:
                                best = max(best, item.aligned(ws[start:end], share, one_in))
                    if best:
                        out.append((i, item.key, best / n))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc_id", "item_id", "share"])

    return search


def _passes(items: DataFrame, words_of_pass: int) -> int:
    """Passes over the documents, so that the items of each have about `words_of_pass` words at most."""
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    return max(1, -(-total // words_of_pass))


def leaks(documents: DataFrame, passages: DataFrame, threshold: float = 0.82, least: int = 15, share: float = 0.55, one_in: int = 10, words_of_pass: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, share): documents (doc_id, text) that hold a run with at least `share` of the words of a passage (item_id,
    text) of at least `least` words, at most one word in `one_in` of the run altered; share is that of the longest run.

    Passages are held by the tasks in passes of about `words_of_pass` words (each word has at most two window vectors of DIMS floats, so
    what is broadcast is bounded); one latent basis serves all passes.  The search has no shuffle.  Null ids and texts, texts and
    passages without words, and an empty table on either side give no rows; repeated rows are found as often as they stand there (of
    repeated passage ids one is kept); other columns are not read.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    docs = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    items = passages.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    total = docs.count()
    kept = stage(docs.mapInArrow(_measure(min(1.0, SAMPLE / max(1, 2 * total))), _KEPT))
    idf = np.log1p(total / (1.0 + sketch.total(kept.where("block IS NOT NULL").select("block", "salt", "counts"), BUCKETS)))
    asked = items.select(F.col("item_id").alias("id"), "text").mapInArrow(_measure(1.0, 8), _KEPT).where("rank IS NOT NULL").select("rank", "words")
    sample = kept.where("rank IS NOT NULL").select("rank", "words").orderBy("rank").limit(SAMPLE).unionAll(asked.orderBy("rank").limit(SAMPLE))
    basis = fit(stage(sample.select("words").repartition(4)), idf)
    passes = _passes(items, words_of_pass)
    found = None
    for k in range(passes):
        chosen: list[tuple] = []  # plain values only: tasks need not import this module to read them
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id").collect():  # about words_of_pass words
            ws = words(r.text)
            if len(ws) >= least:
                groups.setdefault(scales(len(ws), share), []).append((len(chosen), buckets(hashes(ws))))
                chosen.append((r.item_id, ws))
        if not chosen:
            continue
        packed = {}
        for (width, step), members in groups.items():
            x, of, at = basis.windows(np.concatenate([w for _, w in members]), np.array([len(w) for _, w in members]), width, max(1, width // 4))
            packed[width, step] = Cells.of(x, np.array([j for j, _ in members])[of], at, threshold).plain()
        one = docs.mapInArrow(_search(sc.broadcast(basis.vectors), sc.broadcast((chosen, packed)), threshold, share, one_in), "doc_id bigint, item_id bigint, share double")
        found = one if found is None else found.unionAll(one)
    return found if found is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint, share double")
