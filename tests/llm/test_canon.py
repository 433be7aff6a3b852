"""Canonical mapping: forms of a name, values that name something else, brute force over all names, edge cases."""

from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm.canon import canonical, decide, map_values, normalise, prediction_values, slips
from braidwork.sources.tables import table

ENTRIES = [(1, "relation_type", "FALLING_ACTION", ["aftermath"]), (2, "relation_type", "CORRELATION", None), (3, "event_span", "feed pump shutdown", ["feed pump halt", None, " "]), (4, "event_span", "feed pump recall", []), (5, "event_span", None, None), (6, "event_span", "twin name", None), (7, "event_span", "twin name", None)]
PREDS = "pred_id bigint, pred_source_span string, pred_target_span string, pred_relation_type string, kind string, value int"
SAME = ["feed pump shutdown", "  FEED_PUMP-shutdown!\n", "ｆｅｅｄ ｐｕｍｐ ｓｈｕｔｄｏｗｎ", "féed pump shutdowns", "shutdown of the feed pump", "shutdown, feed pump", "event: “feed upmp shutdwn” (reported)", "feedpumpshutdown", "shutdownofthefeedpump", "feed pump's halt", "another event: feed pump shutdown today"]
OTHER = ["feed pump rupture", "pump", "???", "42", "feed the birds", "twin name", "x" * 3000]


def test_forms(spark):
    rows = [(i, v, None, " ", "x", 1) for i, v in enumerate(SAME + OTHER)] + [(100, None, "", "falling action", "x", 1), (100, None, " ", "NO_RELATION", "x", 1), (101, None, None, "Afetrmath", "x", 1)]
    got = canonical(spark.createDataFrame(rows, PREDS), spark.createDataFrame(ENTRIES, "entry_id bigint, kind string, label string, aliases array<string>")).collect()
    want = [(i, "pred_source_span", 3) for i in range(len(SAME))] + [(i + len(SAME), "pred_source_span", -1) for i in range(len(OTHER))]
    want += [(100, "pred_relation_type", 1), (100, "pred_relation_type", -1), (101, "pred_relation_type", 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty(spark):
    preds, entries = spark.createDataFrame([(1, "a", "b", "c", "x", 1)], PREDS), spark.createDataFrame([], "entry_id bigint, kind string, label string, aliases array<string>")
    assert {r.entry_id for r in canonical(preds, entries).collect()} == {-1}
    assert canonical(preds.limit(0), entries).count() == 0


def test_index_loses_nothing(spark):
    d = "/root/testdata/sf0.001"
    entries = table(spark, d, "canon_entries")
    names = [(r.entry_id, r.kind, normalise(n)) for r in entries.collect() for n in [r.label, *(r.aliases or [])]]
    for held in (4_000_000, 2500):
        got = map_values(prediction_values(table(spark, d, "esl_predictions")), entries, held=held).collect()
        for r in got:
            all_names = [(e, n, 1.0) for e, k, n in names if k == r.kind]
            assert (decide(normalise(r.value), all_names, 0.0) or -1) == r.entry_id, r


def test_slips():
    assert [slips("reuslt", "result", 3), slips("abc", "abc", 0), slips("abcd", "xyzw", 2), slips("", "ab", 3)] == [1, 0, 3, 2]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 9))
def test_slips_against_the_table(a, b, most):
    t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    assert slips(a, b, most) == min(t[-1][-1], most + 1)


def test_known_words_are_no_slips():
    names = [(1, ["retail", "chain", "strike"], 0.9), (1, ["retail", "chain", "walkout"], 0.9), (2, ["power", "grid", "blackout"], 0.5)]
    assert decide(["retail", "chain", "blackout"], names, 0.02) is None
    assert decide(["retail", "chain", "blakcout"], names, 0.02) is None
    assert decide(["retail", "chain", "walkotu"], names, 0.02) == 1
    assert decide(["retail", "chain", "recall"], names[:2], 0.02, frozenset(["recall"])) is None
    assert normalise("evnet: “Relation: x:y” (a)") == ["x", "y", "a"] and normalise("blackout: of gate") == ["blackout", "of", "gate"]
