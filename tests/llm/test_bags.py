"""Near-same records at the stated limit of one changed word in six."""

import random

from braidwork.llm.crosssplit import overlaps
from braidwork.llm.nearsame import near_groups, near_pairs
from braidwork.llm.texts import same
from braidwork.llm.words import words

rng = random.Random(11)
VOCAB = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in ("ato", "ine", "ora", "ulk") for c in ("", "s", "ed", "ing")]


def spread(ws, one_in, at=0):
    """Every one_in-th word replaced: no longer run is kept, and the limit is reached."""
    return [rng.choice(VOCAB) + "x" if k % one_in == at else w for k, w in enumerate(ws[: len(ws) // one_in * one_in])] + ws[len(ws) // one_in * one_in :]


def pairs(lengths, change):
    out = []
    for n in lengths:
        base = [rng.choice(VOCAB) for _ in range(n)]
        out += [base, change(base), [rng.choice(VOCAB) for _ in range(n)]]
    return out


LENGTHS = (20, 23, 41, 49, 50, 60, 61, 96, 150, 249, 251, 260, 299, 400, 900)


def splits(spark, texts):
    rows = [(i, " ".join(t), "train" if i % 3 == 0 else "test") for i, t in enumerate(texts)]
    got = sorted(map(tuple, overlaps(spark.createDataFrame(rows, "doc_id bigint, text string, split string").repartition(3)).collect()))
    side = lambda i: i % 3 == 0
    full = [words(" ".join(t)) for t in texts]
    want = sorted((i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if side(i) != side(j) and min(len(full[i]), len(full[j])) >= 20 and same(full[i], full[j], 6))
    return got, want


def test_splits_at_the_limit(spark):
    texts = pairs(LENGTHS, lambda ws: spread(ws, 6, 5)) + pairs(LENGTHS, lambda ws: spread(ws, 8, 3)) + pairs(LENGTHS, lambda ws: [w for k, w in enumerate(ws) if k % 6 != 5]) + pairs(LENGTHS, lambda ws: [x for k, w in enumerate(ws) for x in ([w, "added"] if k % 6 == 5 else [w])])
    got, want = splits(spark, texts)
    assert got == want and len(want) >= 4 * len(LENGTHS) - 1  # a text of 20 words is too short once words are deleted


def shuffled(ws, longest):
    """The words as sentences of up to `longest` words that stand in another order."""
    parts, k = [], 0
    while k < len(ws):
        n = rng.randrange(2, longest + 1)
        parts.append(ws[k : k + n])
        k += n
    rng.shuffle(parts)
    return [w for p in parts for w in p]


def test_splits_sentences_in_another_order(spark):
    texts = pairs(LENGTHS, lambda ws: shuffled(ws, 4)) + pairs(LENGTHS, lambda ws: shuffled(ws, 9)) + pairs(LENGTHS, lambda ws: shuffled(spread(ws, 8, 3), 6))
    got, want = splits(spark, texts)
    assert got == want and len(want) >= 3 * len(LENGTHS)


def test_groups_at_the_limit(spark):
    lengths = [n for n in LENGTHS if n > 48]
    texts = pairs(lengths, lambda ws: spread(ws, 6, 5)) + pairs(lengths, lambda ws: shuffled(spread(ws, 7, 3), 6)) + pairs(lengths, lambda ws: [w for k, w in enumerate(ws) if k % 6 != 5])
    docs = spark.createDataFrame([(i, f"d{i:03}", " ".join(t), None) for i, t in enumerate(texts)], "row_id bigint, document_id string, text string, sentences array<string>").repartition(3)
    full = [(f"d{i:03}", words(" ".join(t))) for i, t in enumerate(texts)]
    want = [(a, b) for a, x in full for b, y in full if a < b and min(len(x), len(y)) >= 40 and same(x, y, 6)]
    assert sorted(map(tuple, near_pairs(docs).collect())) == want and len(want) >= 3 * len(lengths)
    group = {r.document_id: r.group_id for r in near_groups(docs).collect()}
    assert all(group[a] == group[b] for a, b in want)
