"""Near-same records: across splits and in groups, against comparing all with all, with copies, edits, reordering and edge cases."""

import random

import numpy as np

from braidwork.llm.crosssplit import overlaps, report
from braidwork.llm.nearsame import Plan, fit, near_groups, near_pairs, plain_plan, step, taken
from braidwork.llm.texts import components, same
from braidwork.llm.words import hashes, many, many_shingles, mix, shingles, words

rng = random.Random(5)
VOCAB = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ato", "ine", "ora", "ulk", "esh", "ipo")]


def text(n):
    return [rng.choice(VOCAB) + (str(rng.randrange(999)) if rng.random() < 0.2 else "") for _ in range(n)]


def edited(ws, share):
    out = list(ws)
    for _ in range(int(share * len(ws))):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[k : k + 1] = [] if kind == 0 else [rng.choice(VOCAB)] if kind == 1 else [out[k], rng.choice(VOCAB)]
    return out


def turned(ws):
    cut = len(ws) // 2
    return ws[cut:] + ws[:cut]


def corpus(bases=25, least=25):
    out = []
    for _ in range(bases):
        b = text(rng.randrange(least, 160))
        out += [b, edited(b, 0.05), turned(edited(b, 0.04)), [w.upper() + "," for w in b], text(rng.randrange(least, 160))]
    return [" ".join(ws) if k % 2 else "  ".join(ws) for k, ws in enumerate(out)]


def test_cross_split(spark):
    rows = [(i, t, rng.choice(["train", "test", "dev", "valid", "val", "unknown", None, "train"]), rng.choice(["a", None]), "k", 1) for i, t in enumerate(corpus())]
    rows += [(1000, "short text", "train", "a", "k", 1), (1001, "short text", "test", "a", "k", 1), (1002, None, "test", "a", "k", 1), (1003, "", "train", "a", "k", 1), (None, rows[0][1], "train", "a", "k", 1), rows[3], rows[4]]
    big = " ".join(text(20_000))
    rows += [(1010, big, "train", "a", "k", 1), (1011, big.upper(), "test", "a", "k", 1)]
    rows += [(2000 + i, "Boiler plate " * 15, "train" if i % 3 else "test", "a", "k", 1) for i in range(12)]
    rows += [(3000 + i, "alpha beta gamma " * 12 + x, "train" if i % 2 else "test", "a", "k", 1) for i, x in enumerate(["", "delta", "alpha", "beta beta"])]  # few distinct shingles
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, split string, source string, key string, id int").repartition(3)
    found = overlaps(docs)
    got = sorted(map(tuple, found.collect()))
    long = {r[0]: (words(r[1]), r[2]) for r in rows if r[0] is not None and len(words(r[1])) >= 20}
    side = {i: 0 if s == "train" else 1 if s in ("test", "dev", "valid", "val") else None for i, (_, s) in long.items()}
    want = sorted((a, b) for a in long for b in long if a < b and None not in (side[a], side[b]) and side[a] != side[b] and same(long[a][0], long[b][0], 6))
    assert got == want and len(want) > 40
    counts = report(docs, found).collect()
    assert sum(r.pairs for r in counts) == len(want)
    assert overlaps(docs.limit(0)).count() == 0


def test_groups(spark):
    texts = corpus(12, 45)
    rows = [(i, f"d{i % 50}", t, None, "k") for i, t in enumerate(texts)]
    rows += [(100, "s1", " ", texts[0].split("  "), "k"), (101, "s2", None, [texts[0], None, ""], "k"), (102, "s3", None, None, "k"), (103, None, texts[0], None, "k"), (104, "s4", "too short", None, "k"), rows[0]]
    docs = spark.createDataFrame(rows, "row_id bigint, document_id string, text string, sentences array<string>, cls string")
    full = [(d, words(t if t and t.strip() else " ".join(x for x in s or [] if x))) for _, d, t, s, _ in rows if d]
    full = [(d, w) for d, w in full if len(w) >= 40]
    want = {(a, b) for a, x in full for b, y in full if a < b and same(x, y, 6)}
    assert sorted(map(tuple, near_pairs(docs).collect())) == sorted(want) and len(want) > 30
    groups = near_groups(docs).collect()
    of = {}
    for r in groups:
        of.setdefault(r.document_id, set()).add(r.group_id)
    assert all(of[a] & of[b] for a, b in want)
    assert near_pairs(docs.limit(0)).count() == 0


def units_share_a_key(plan, a, b, one_in):
    """Whether two sets of bits meet in a key."""
    got = []
    for bits in (a, b):
        g = np.array(sorted(bits), np.uint64)
        got.append(set(taken(plan, np.zeros(len(g), np.int64), g, mix(g), np.array([len(g) // one_in + 1]))[0].tolist()))
    return got[0] & got[1]


def test_pigeonhole_is_exact():
    """Any two sets that are near-same meet, whatever the parts, their order and the shared bits asked for."""
    r = np.random.default_rng(1)
    pool = np.unique(r.integers(0, 2**50, 3000, dtype=np.uint64))
    samples = [(np.sort(x), mix(np.sort(x))) for x in (r.choice(pool, 60, replace=False) for _ in range(40))]
    k = int(np.log(60) / step(6))
    made = [fit(k, 6, samples, 1e6, pool), fit(k, 6, samples, 10, pool), plain_plan(k, 6, pool), plain_plan(k, 6, pool[:0])]
    assert (made[0].shared != made[1].shared).any() or (made[0].place != made[1].place).any()  # the estimates decide
    for plan in [*made, Plan(made[2].ends, 3, made[2].place[::-1].copy(), made[2].shared)]:
        for _ in range(60):
            n = int(r.integers(52, 66))
            a = set(r.choice(pool, n, replace=False).tolist())
            lost = int(r.integers(0, n // 6 + 1))
            b = set(list(a)[lost:]) | set(r.choice(pool, int(r.integers(0, lost + 1)), replace=False).tolist())
            if (max(len(a), len(b)) - len(a & b)) * 6 <= max(len(a), len(b)):
                assert units_share_a_key(plan, a, b, 6)


def test_short_texts_and_shingles():
    for k in range(0, 12):
        plan = plain_plan(k, 6, np.zeros(0, np.uint64))
        for n in range(max(1, int(np.exp(k * step(6)) * 5 / 6)), int(np.exp((k + 1) * step(6)) * 6 / 5) + 2):
            g = mix(np.arange(n, dtype=np.uint64))
            keys, _ = taken(plan, np.zeros(n, np.int64), g, g, np.array([n // 6 + 1]))
            assert len(keys)  # equal texts meet, so every text has a key
    a, b = text(80), text(80)
    h, size = many([a, [], b, ["x"]])
    g, t = many_shingles(h, size, 3)
    assert len(g) == 156 and set(t.tolist()) == {0, 2}
    assert len(shingles(hashes(a), 3)) == 78 and words("Don't STOP – x_y…") == ["dont", "stop", "xy"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
