"""Sections and list items are merged with siblings of one parent only."""

import random

from braidwork.llm.split import pieces, tree


def cut(text, limit):
    return [text[s:e] for s, e in pieces(text, limit, 0)]


def test_sections_by_depth():
    a, b1, b2, c = "# A\none two\n## A1\nthree\n", "# B\nintro\n## B1\nfour five six seven\n", "## B2\neight nine ten eleven\n", "# C\ntwelve"
    assert cut(a + b1 + b2 + c, 50) == [a, b1, b2, c]


def test_lists_by_indent():
    a, b, c = "- one\n  - two\n", "- three\n  - four five\n  - six seven eight\n  - nine ten\n", "- eleven"
    got = cut(a + b + c, 45)
    assert got[0] == a and got[-1] == c and "".join(got[1:-1]) == b


def test_lists_across_blank_lines():
    a, b, c = "- one\n\n  more of it\n\n", "- two\n\n  - two a is long enough\n\n  - two b is long enough\n\n", "- three"
    got = cut("Lead.\n\n" + a + b + c, 45)
    assert got == ["Lead.\n\n" + a, "- two\n\n  - two a is long enough\n\n", "  - two b is long enough\n\n", c]


def test_elements_by_nesting():
    a, b = "<p>alpha beta</p>", "<div><p>gamma delta</p><p>epsilon zeta</p></div>"
    assert cut(a + b, 35) == [a, "<div><p>gamma delta</p>", "<p>epsilon zeta</p></div>"]
    assert cut(a + a + b, 50) == [a + a, b]


def covered(node, text):
    at = node.start
    for k in node.children:
        assert k.start == at and k.end >= k.start
        covered(k, text)
        at = k.end
    assert not node.children or at == node.end


def test_the_tree_covers_the_text_and_nesting_is_bounded():
    rng = random.Random(3)
    parts = ["# A\n", "### B\n", "- x\n", "    * y\n", "  1. z\n", "\n", "plain\n", "  indented\n", " \n", "end"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        covered(tree(text), text)
        assert "".join(cut(text, 12)) == text
    for text in ("<a>" * 3000 + "x" + "</a>" * 3000, "".join(" " * k + "- x\n" for k in range(2000)), "#" * 6 + " a\n" + "<p>" * 500):
        got = pieces(text, 50, 5)
        assert all(e - s <= 50 for s, e in got) and got[-1][1] == len(text)
