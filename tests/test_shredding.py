"""Shredding: round trips of random nested data, child tables against plain loops, edge cases."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.operators.shredding import child_tables, found_children, rebuild, shred_batch
from braidwork.plans.shredded import p1_found

inner = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=3))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.lists(inner, max_size=3)), max_size=3)), min_size=1, max_size=6))
def test_round_trip(rows):
    kind = pa.list_(pa.list_(pa.list_(pa.int64())))
    leaf = shred_batch(pa.table({"x": pa.array(rows, kind)}), ["x"])["x.element.element.element"]
    assert rebuild(leaf, len(rows)) == rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.dictionaries(st.text("abc", min_size=1, max_size=2), st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=3)), max_size=3)), min_size=1, max_size=5))
def test_round_trip_of_maps(rows):
    t = pa.table({"x": pa.array([None if r is None else list(r.items()) for r in rows], pa.map_(pa.string(), pa.list_(pa.int64())))})
    leaves = shred_batch(t, ["x"])
    assert rebuild(leaves["x.key"], len(rows)) == [None if r is None else list(r) for r in rows]
    assert rebuild(leaves["x.value.element"], len(rows)) == [None if r is None else list(r.values()) for r in rows]


SCHEMA = """row_id bigint, note string, entities map<string, struct<type:string, mentions:array<struct<id:string, offset:array<int>>>>>,
 relations map<string, array<array<string>>>,
 ontology_links struct<by_entity:map<string, struct<candidates:array<struct<label:string>>, selected:struct<label:string>>>>, child_key string"""
ROWS = [
    (1, "n", {"a": ("T", [("m", [1, 2]), None, ("k", None)]), "b": None}, {"R": [["a", "b"], None, ["a", None], ["a", "zz"], ["a"], ["a", "b", "c"]], "S": None}, ({"a": ([None, ("x",)], ("y",)), "q": ([("z",)], None)},), "clash"),
    (2, None, None, None, None, None),
    (3, "", {}, {}, ({},), ""),
    (4, "n", {"a#0": (None, [])}, {"": [["a#0", "a#0"]]}, (None,), None),
    (4, "n", {"a#0": (None, [])}, {"": [["a#0", "a#0"]]}, (None,), None),
]
FOUND = [(1, "candidate", "a#1"), (1, "endpoint", "R#0#h"), (1, "endpoint", "R#0#t"), (1, "endpoint", "R#3#h"), (1, "entity", "a"), (1, "entity", "b"), (1, "mention", "a#0"), (1, "mention", "a#2"), (1, "orphan_candidate", "q#0"), (1, "orphan_endpoint", "R#3#t"), (1, "relation", "R#0"), (1, "relation", "R#3"), (1, "selected", "a")]
FOUR = [(4, "endpoint", "#0#h"), (4, "endpoint", "#0#t"), (4, "entity", "a#0"), (4, "relation", "#0")]


def test_children_of_documents(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    assert sorted(map(tuple, found_children(df).collect())) == sorted(FOUND + FOUR + FOUR)
    assert found_children(df.where("row_id > 9")).count() == 0


def test_child_tables(spark):
    t = child_tables(spark.createDataFrame(ROWS, SCHEMA), "row_id", "entities")
    assert set(t) == {"entities", "entities.value.mentions", "entities.value.mentions.element.offset"}
    m = t["entities.value.mentions"]
    assert m.columns == ["row_id", "pos_1", "pos_2", "key_1", "key_2", "present", "leaf_id"]
    assert sorted(map(tuple, m.collect()), key=str) == [(1, 0, 0, "a", None, True, "m"), (1, 0, 1, "a", None, False, None), (1, 0, 2, "a", None, True, "k")]
    o = t["entities.value.mentions.element.offset"]
    assert sorted(map(tuple, o.select("row_id", "pos_1", "pos_2", "pos_3", "key_1", "leaf_value").collect())) == [(1, 0, 0, 0, "a", 1), (1, 0, 0, 1, "a", 2)]
    assert child_tables(spark.createDataFrame(ROWS, SCHEMA), "row_id", "relations")["relations.value"].count() == 8


def test_whole_table(spark):
    assert p1_found(spark, "/root/testdata/sf0.001").where("child_table = 'entity'").count() > 100
