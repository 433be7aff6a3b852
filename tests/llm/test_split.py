"""Splitting: limits, overlap and lossless joining on random texts; cuts at natural boundaries; edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm.queries import p2_found
from braidwork.llm.split import chunk_items, pieces, sentence_items, split

bits = st.sampled_from(["# Head\n", "- item one\n", "word ", "Longer sentence here. ", "\n\n", "x" * 17, "é", "; then ", " .\n<a> b ", "𝄞"])


@settings(max_examples=300, deadline=None)
@given(st.lists(bits, max_size=60).map("".join), st.integers(4, 60), st.integers(0, 3))
def test_pieces_hold(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(e - s <= limit for s, e in got)
    for (_, e), (s2, e2) in zip(got, got[1:], strict=False):
        assert s2 == max(0, e - overlap) and e2 > e
    assert (len(got) == 1) == (len(text) <= limit)


def test_cuts_at_the_strongest_boundary():
    text = "# One\nalpha beta. gamma delta.\n\nmore text here.\n# Two\nepsilon zeta. eta theta."
    cut = [text[s:e] for s, e in pieces(text, 55, 0)]
    assert cut == ["# One\nalpha beta. gamma delta.\n\nmore text here.\n", "# Two\nepsilon zeta. eta theta."]
    text = "one two. three four. five six."
    assert [text[s:e] for s, e in pieces(text, 21, 0)] == ["one two. three four. ", "five six."]
    assert pieces("a" * 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    with pytest.raises(ValueError, match="overlap"):
        pieces("abc", 2, 2)


def test_split_cases(spark):
    limits = spark.createDataFrame([("sentence", 10, 2), ("chunk", 20, 5), ("chunk", 20, 5), (None, 1, 1)], "item_kind string, max_chars int, overlap_chars int")
    docs = spark.createDataFrame([(1, ["short", None, "x" * 11, ""], 5), (1, ["y" * 1000], 6), (2, None, 7), (3, [], 8)], "row_id bigint, sentences array<string>, item_kind int")
    out = split(sentence_items(docs), limits)
    got = out.groupBy("item_id", "item_pos").count().collect()
    assert sorted(map(tuple, got)) == [(1, 0, 125), (1, 2, 2)]
    chunks = spark.createDataFrame([(7, "𝄞" * 20), (8, "𝄞" * 21), (8, "𝄞" * 21), (9, None), (10, "  ")], "chunk_id bigint, text string")
    assert sorted(r.item_id for r in split(chunk_items(chunks), limits).where("piece = 0").collect()) == [8, 8]
    assert split(chunk_items(chunks), limits.limit(0)).count() == 0
    bad = limits.unionAll(spark.createDataFrame([("chunk", 30, 5)], limits.schema))
    with pytest.raises(ValueError, match="one row per kind"):
        split(chunk_items(chunks), bad)


def test_whole_table(spark):
    assert p2_found(spark, "/root/testdata/sf0.001").count() > 0
