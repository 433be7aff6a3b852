"""Bounds of the leak search: what is passed over without an alignment, and products in blocks."""

import random

import numpy as np
import pyarrow as pa

from braidwork.llm import leak
from braidwork.llm.words import hashes

rng = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]


class Held:
    def __init__(self, value):
        self.value = value


def test_products_in_blocks():
    r = np.random.default_rng(2)
    for n in (5, 203, 9000):
        x, y = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (r.standard_normal((k, 8)).astype(np.float32) for k in (n, 701)))
        cells = leak.Cells.of(x, np.arange(n), np.arange(n) % 7, 0.9)
        got = sorted((int(a), int(b), int(s)) for rows, item, start in cells.near(y, 0.9) for a, b, s in zip(rows, item, start, strict=True))
        cosine = y.astype(np.float64) @ x.astype(np.float64).T
        edge = np.abs(cosine - 0.9) < 1e-5
        assert {(a, b) for a, b, _ in got if not edge[a, b]} == set(map(tuple, np.argwhere((cosine >= 0.9) & ~edge).tolist()))
        assert len(got) == len(set(got)) and all(s == b % 7 for _, b, s in got)


def test_parts_without_neighbours_are_not_aligned(monkeypatch):
    """Runs with one word in ten altered are found; a document that holds the item's neighbours far apart costs no subsequence."""
    items = [[rng.choice(VOCAB) for _ in range(50)] for _ in range(6)]
    basis = np.random.default_rng(1).standard_normal((leak.BUCKETS, leak.DIMS)).astype(np.float32)
    space, packed, texts = leak.Basis(basis), {}, []
    for j, ws in enumerate(items):
        run = list(ws[5:45])
        for k in rng.sample(range(40), 3):
            run[k] = "altered"
        texts.append([rng.choice(VOCAB) for _ in range(70)] + run + [rng.choice(VOCAB) for _ in range(30)])
        far = [w for k in range(0, 50, 5) for w in [*ws[k : k + 6], *(rng.choice(VOCAB) for _ in range(40))]]
        texts.append(far + ws[20:36] + [rng.choice(VOCAB) for _ in range(200)])  # all neighbours, one window
    x, of, at = space.windows(np.concatenate([leak.buckets(hashes(w)) for w in items]), np.array([50] * 6), 16, 4)
    packed[16, 8] = leak.Cells.of(x, of, at, 0.82).plain()
    calls = []
    common = leak.Item.common
    monkeypatch.setattr(leak.Item, "common", lambda self, *a: calls.append(self.key) or common(self, *a))
    search = leak._search(Held(basis), Held(([(j, w) for j, w in enumerate(items)], packed)), 0.82, 0.55, 10)
    b = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([" ".join(t) for t in texts])], names=["id", "text"])
    got = {(i, j) for r in search(iter([b])) for i, j in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)}
    assert {(2 * j, j) for j in range(6)} == got
    assert len(calls) == 6
