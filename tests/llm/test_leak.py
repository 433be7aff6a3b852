"""Leaked passages: planted runs of all shares and alterations against a quadratic search, edge cases; the alignment itself."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import leak
from braidwork.llm.leak import Basis, Cells, leaks, longest_run, scales, subsequence

rng = random.Random(3)
VOCAB = [f"{a}{b}{c}" for a in "bcdfgk" for b in ("ato", "ine", "ora", "ulk") for c in ("", "s", "ra")]


def text(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_subsequence(a, b):
    got = subsequence(a, b)
    assert len(got) == plain(a, b) and all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_runs():
    whole = [(k, k + 5) for k in range(40)]
    assert longest_run(whole, 10) == 40
    assert longest_run([p for p in whole if p[0] % 12], 10) == 39
    assert longest_run(whole[:15] + whole[25:], 10) == 15
    assert longest_run([], 10) == 0
    for n in range(15, 200):
        width, step = scales(n)
        assert width + step - 1 <= 0.55 * n


def test_planted(spark):
    items, docs, want = [], [], set()
    for k in range(30):
        n = rng.randrange(15, 90)
        items.append((k, text(n)))
    for i in range(150):
        k, ws = rng.choice(items)
        share = rng.choice([0.2, 0.35, 0.7, 0.85, 1.0])
        size = int(share * len(ws))
        at = rng.randrange(len(ws) - size + 1)
        run = ws[at : at + size]
        for j in range(5, len(run) - 3, 25):
            run[j] = "altered"
        docs.append((i, " ".join(text(rng.randrange(0, 120)) + [w.upper() + "." for w in run] + text(rng.randrange(0, 60))), "x"))
        if share > 0.55:
            want.add((i, k))
    docs += [(900, None, "x"), (901, "", "x"), (902, "one two", "x"), (None, docs[0][1], "x"), (903, " ".join(text(20_000) + items[0][1]), "x"), docs[0]]
    want.add((903, 0))
    for j, (at, end) in enumerate([(0, 9), (9, 0), (0, 0)]):  # at either end of a document, or all of it
        k, ws = items[j + 3]
        docs.append((950 + j, " ".join(text(at) + ws + text(end)), "x"))
        want.add((950 + j, k))
    rows = [(k, " ".join(ws), "b") for k, ws in items] + [(100, "just a stock phrase", "b"), (101, None, "b"), (102, "", "b"), (0, " ".join(items[0][1]), "b")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(2)
    p = spark.createDataFrame(rows, "item_id bigint, text string, doc_id string")
    got = [(r.doc_id, r.item_id) for r in leaks(d, p).collect()]
    assert set(got) == want
    assert len(got) == len(want) + ((docs[0][0], [k for i, k in want if i == 0]) != (0, []))
    assert leaks(d.limit(0), p).count() == 0 and leaks(d, p.limit(0)).count() == 0


def test_repeated_phrases_and_passes(spark):
    items, docs, want = [], [], set()
    for k in range(20):
        phrase = text(15)
        items.append((k, " ".join(phrase * 4)))
        docs.append((k, " ".join(text(60) + phrase * 4 + text(40))))
        want.add((k, k))
    words_ = text(60)
    items.append((50, " ".join(words_)))
    docs += [(100, " ".join(words_[:20] + text(70) + words_ + text(5))), (101, " ".join((words_[:10] + text(3)) * 40 + words_))]  # beginnings of it before it
    want |= {(100, 50), (101, 50)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    p = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(d, p).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks(d, p, words_of_pass=200).collect()} == want


def test_cells_lose_nothing(monkeypatch):
    monkeypatch.setattr(leak, "CELLS", 100)
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 64)).astype(np.float32)
    x = np.concatenate([x, x + 0.5 * r.standard_normal(x.shape).astype(np.float32)])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    q = x + 0.6 * r.standard_normal(x.shape).astype(np.float32) / 8
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    cells = Cells.of(x, np.arange(len(x)), np.zeros(len(x), np.int64), 0.82)
    got = {(a, b) for rows, own, _ in cells.near(q, 0.82) for a, b in zip(rows.tolist(), own.tolist(), strict=True)}
    assert len(cells.members) > 10 and got == set(zip(*(v.tolist() for v in np.nonzero(q @ x.T >= 0.82)), strict=True)) and len(got) > 300


def test_windows():
    r = np.random.default_rng(2)
    basis = Basis(r.standard_normal((50, 4)).astype(np.float32))
    sizes = np.array([1, 3, 15, 16, 17, 24, 31, 40, 100])
    b = r.integers(0, 50, sizes.sum())
    for width, step in ((16, 8), (16, 4), (10, 5), (3, 3), (10, 2), (4, 1)):
        x, of, at = basis.windows(b, sizes, width, step)
        begin = np.cumsum(sizes) - sizes
        want = {(t, p) for t, n in enumerate(sizes.tolist()) for p in [*range(0, max(1, n - width + 1), step), max(0, n - width)]}
        assert set(zip(of.tolist(), at.tolist(), strict=True)) == want and len(of) == len(want)
        for v, t, p in zip(x, of, at, strict=True):
            own = basis.vectors[b[begin[t] + p : begin[t] + min(p + width, sizes[t])]].sum(0)
            assert np.allclose(v, own / np.linalg.norm(own), atol=1e-4)
