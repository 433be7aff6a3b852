"""Splitting oversized items at natural boundaries by packing a structure tree.

A text is parsed into a tree: sections by the depth of their headings, within them paragraphs by blank lines and lists whose items nest by
indent, also across blank lines.  What is larger than the limit and has no such children is parsed further: elements of markup by their nesting,
statements, lines, sentences, clauses, words, characters.  The tree is packed bottom-up: a subtree that fits is one unit, only an oversized node
is descended into, and units are merged with the siblings beside them up to the limit.  What an oversized section, list, item or element is
split into joins neither the sibling before nor the one after; below those, units are merged across sentences and lines, so few scraps are left.
A piece is a unit with the `overlap` characters before it, so new text has limit - overlap characters in all pieces but the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s")
_ITEM = re.compile(r"([ \t]*)(?:[-*•]|\d+[.)])[ \t]")
_INDENT = re.compile(r"[ \t]*")
_TAG = re.compile(r"<(/?)([A-Za-z][\w.-]*)(?:\s[^<>]*)?>")
#: Boundaries below the tree from strong to weak; a cut is at the end of a match, so white space stays with the text before it.
_BORDERS = tuple(
    re.compile(p)
    for p in (
        r"[ \t]\.[ \t]*\n(?=\S)",  # statements of markup
        r"\n+|(?<=>)(?=<)",  # lines, elements
        r"(?<=[.!?…。！？])[\"”’)\]]*\s+|[ \t]\.[ \t]+(?=\S)",  # sentences
        r"(?<=[;:])\s+",  # clauses
        r"(?<=,)\s+|\s+[–—|]\s+",
        r"\s+",  # words
    )
)
#: Nodes that nest deeper than this hang on the last one of that depth.
DEEPEST = 40


@dataclass
class Node:
    """A part of a text; kind: section, list, item, element or text (a paragraph or what lies beside an element)."""

    start: int
    end: int
    kind: str
    depth: int = 0
    children: list[Node] = field(default_factory=list)


def tree(text: str) -> Node:
    """Sections, lists, items and paragraphs of a text; the children of a node cover it."""
    root = Node(0, len(text), "section")
    open_ = [root]  # from the root to the node that takes the next line
    blank = True
    at = 0

    def close(n: int) -> None:
        while len(open_) > n:
            open_.pop().end = at

    def add(kind: str, depth: int) -> None:
        node = Node(at, len(text), kind, depth)
        open_[-1].children.append(node)
        open_.append(node)

    for line in text.splitlines(keepends=True) if "\n" in text else [text]:
        if not line.strip():
            blank = True
            if open_[-1].kind not in ("text", "item"):  # white space before anything else
                add("text", 0)
            at += len(line)
            continue
        heading, item = _HEADING.match(line), _ITEM.match(line)
        indent = len(_INDENT.match(line)[0].expandtabs(4))
        if heading:
            depth = len(heading[1])
            close(next((k for k, n in enumerate(open_) if k and (n.kind != "section" or n.depth >= depth)), len(open_)))
            add("section", depth)
            add("text", 0)
        elif item:
            close(next((k for k, n in enumerate(open_) if n.kind == "text" or n.kind == "item" and n.depth >= indent), len(open_)))
            if open_[-1].kind != "list" and len(open_) < 2 * DEEPEST:
                add("list", indent)
            if open_[-1].kind == "list":
                add("item", indent)
            add("text", 0)
        elif blank:
            close(next((k for k, n in enumerate(open_) if n.kind == "text" or n.kind in ("list", "item") and n.depth >= indent), len(open_)))
            if open_[-1].kind == "list":
                close(len(open_) - 1)
            add("text", 0)
        elif open_[-1].kind != "text":
            add("text", 0)
        blank = False
        at += len(line)
    close(1)
    return root


def elements(text: str, start: int, end: int) -> list[Node]:
    """The outermost elements of a part of a text and what lies beside them; none if it has no element that is closed."""
    open_: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _TAG.finditer(text, start, end):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append((m[2], m.start()))
            continue
        at = next((k for k in range(len(open_) - 1, max(-1, len(open_) - 1 - DEEPEST), -1) if open_[k][0] == m[2]), None)
        if at is not None:
            begin = open_[at][1]
            del open_[at:]
            while found and found[-1][0] >= begin:
                found.pop()
            found.append((begin, m.end()))
    out, at = [], start
    for a, b in found:
        if at < a:
            out.append(Node(at, a, "text"))
        out.append(Node(a, b, "element"))
        at = b
    return out + [Node(at, end, "text")] * (at < end) if out else []


def _inside(text: str, node: Node) -> list[Node]:
    """The children of an element between its tags, which go with the first and the last of them."""
    first, last = _TAG.match(text, node.start), text.rfind("<", node.start, node.end)
    inner = elements(text, first.end(), last)
    if inner:
        inner[0].start, inner[-1].end = node.start, node.end
        if inner[0].kind == "element":  # with its parent's tag before it, it is split as text
            inner[0].kind = "text"
        if inner[-1].kind == "element":
            inner[-1].kind = "text"
    return inner


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text in code points: none above limit, each sharing `overlap` characters with the one before;
    one piece if it fits."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text))]

    def fits(start: int, end: int) -> bool:
        return end - max(0, start - overlap) <= limit

    def merge(kids: list[tuple[list[tuple[int, int]], bool]], led: bool = False) -> list[tuple[int, int]]:
        """Units of siblings, each merged with the one before it if both fit; a sibling marked closed keeps to itself, but for the parent's
        own lead before the first one."""
        out: list[tuple[int, int]] = []
        joins = False
        for i, (own, closed) in enumerate(kids):
            for n, (a, b) in enumerate(own):
                may = joins if not closed else led and i == 1 and n == 0 and len(out) == 1
                if may and fits(out[-1][0], b):
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
                joins = True
            joins = not closed
        return out

    def text_units(start: int, end: int, level: int) -> list[tuple[int, int]]:
        if fits(start, end):
            return [(start, end)]
        while level < len(_BORDERS):
            cuts = [m.end() for m in _BORDERS[level].finditer(text, start, end) if start < m.end() < end]
            level += 1
            if cuts:
                return merge([(text_units(a, b, level), False) for a, b in zip([start, *cuts], [*cuts, end], strict=True)])
        out = []
        while not fits(start, end):
            cut = max(0, start - overlap) + limit
            out.append((start, cut))
            start = cut
        return [*out, (start, end)]

    def units(node: Node, deep: int = 0) -> list[tuple[int, int]]:
        if fits(node.start, node.end):
            return [(node.start, node.end)]
        kids = node.children
        if not kids and deep < 2 * DEEPEST:
            kids = _inside(text, node) if node.kind == "element" else elements(text, node.start, node.end) if text.find("</", node.start, node.end) >= 0 else []
        if not kids:
            return text_units(node.start, node.end, 0)
        return merge([(own := units(k, deep + 1), len(own) > 1 and k.kind != "text") for k in kids], kids[0].kind == "text")

    ends = [b for _, b in units(tree(text))]
    return [(max(0, s - overlap), e) for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def split(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the items (item_kind, item_id, item_pos, text) that are longer than max_chars of their kind in limits: (item_kind,
    item_id, item_pos, piece, start_char, end_char, piece_text).

    limits (item_kind, max_chars, overlap_chars) is read to the driver: a parameter of one row per kind, checked to be at most 1000.
    Items that are null, blank-free short or of a kind without limit have no pieces; every repeated row is split; other columns are
    not read.  Only the oversized items leave the JVM.
    """
    rows = limits.select("item_kind", "max_chars", "overlap_chars").dropna().distinct().limit(1001).collect()
    by = {r.item_kind: (r.max_chars, r.overlap_chars) for r in rows}
    if len(rows) > 1000 or len(by) < len(rows):
        raise ValueError("limits need one row per kind, 1000 at most")
    longest = F.element_at(F.create_map(*(x for k, (m, _) in by.items() for x in (F.lit(k), F.lit(m)))), F.col("item_kind")) if by else F.lit(None).cast("int")
    big = items.select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), F.col("item_pos").cast("int").alias("item_pos"), "text").where(F.length("text") > longest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for kind, i, pos, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(kind, i, pos, n, s, e, text[s:e]) for n, (s, e) in enumerate(pieces(text, *by[kind]))]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["item_kind", "item_id", "item_pos", "piece", "start_char", "end_char", "piece_text"])

    return big.mapInArrow(cut, "item_kind string, item_id bigint, item_pos int, piece int, start_char int, end_char int, piece_text string")


def sentence_items(documents: DataFrame) -> DataFrame:
    """Items of kind 'sentence': each element of sentences with its 0-based place."""
    return documents.select(F.lit("sentence").alias("item_kind"), F.col("row_id").alias("item_id"), F.posexplode("sentences").alias("item_pos", "text"))


def chunk_items(chunks: DataFrame) -> DataFrame:
    """Items of kind 'chunk'."""
    return chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.lit(0).alias("item_pos"), "text")
