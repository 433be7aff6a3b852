"""Hidden duplicates: against a plain dictionary, with runs over many partitions; line parsing; edge cases."""

import re

from braidwork.llm.facts import copies, facts, line_facts, parse_line

SCHEMA = "id bigint, head string, rel string, tail string, first string, keep int"


def plain(rows):
    groups = {}
    for i, *fields in rows:
        key = tuple(re.sub(r"[^\w]|_", "", (f or "").lower()) for f in fields[:3])
        if all(key):
            groups.setdefault(key, []).append(i)
    return groups


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    groups = plain(rows)
    assert sorted(map(tuple, copies(df).collect())) == sorted((min(g), i) for g in groups.values() for i in sorted(g)[1:])
    assert sorted((r.keep_id, r.head, r.rel, r.tail, r.copies) for r in facts(df).collect()) == sorted((min(g), *k, len(g)) for k, g in groups.items())


def test_hot_key_over_all_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, [(i, "Hot" if i % 3 else f"k{i % 11}", "r", " T.") for i in range(400)])
        check(spark, [(i, "Same", "r", "t") for i in range(50)])
        check(spark, [(i, f"u{i}", "r", "t") for i in range(50)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_forms(spark):
    check(spark, [(5, " pump ", "Leads-To", "«Öl»"), (2, "PUMP", "leads to", "öl"), (3, "pump", "leads to", "ol"), (9, None, "r", "t"), (10, "", "r", "t"), (11, " - ", "r", "t"), (12, "a b", "c", "d"), (13, "a", "bc", "d"), (14, "x" * 5000, "r", "t"), (15, "X" * 5000, "R", "t")])
    empty = spark.createDataFrame([], SCHEMA)
    assert copies(empty).count() == 0 and facts(empty).count() == 0


def test_lines(spark):
    assert parse_line('{"t": "c", "meta": {"h": "no"}, "source": "a", "rel": "b"}') == ("a", "b", "c")
    assert parse_line('r="b ; h=" | meta={"document_id": "x - 1"} | t="c\\n" | h="a"') == ("a", "b ; h=", "c\n")
    assert parse_line('tail="c"\thead="a"\trelation="b"') == ("a", "b", "c")
    for cut in ('{"t": "c", "h": "a"', 'h="a" ; r="b" ; t="c', 'h="a" ; r="b"', '{"h": 1, "r": "b", "t": "c"}', "", None, "  ", "[]", '{"h":"a","head":"b","r":"c","t":"d"}'):
        assert parse_line(cut) is None
    df = spark.createDataFrame([(1, '{"h":"a","r":"b","t":"c"}', "x"), (2, None, "x")], "line_id bigint, line string, head string")
    assert [tuple(r) for r in line_facts(df).collect()] == [(1, "a", "b", "c")]
