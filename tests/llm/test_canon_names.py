"""Canonical mapping with many names of one subject."""

from braidwork.llm.canon import map_values


def test_names_behind_many_rivals(spark):
    rivals = [(i, "event_span", "genreatorium shutdwonage", None) for i in range(14)]
    entries = spark.createDataFrame([*rivals, (99, "event_span", "generator shutdown", None)], "entry_id bigint, kind string, label string, aliases array<string>")
    values = spark.createDataFrame([("event_span", "genreator shutdwon"), ("event_span", "something else")], "kind string, value string")
    assert {r.value: r.entry_id for r in map_values(values, entries).collect()} == {"genreator shutdwon": 99, "something else": -1}
