"""Columnar shredding of nested records into flat child tables.

Each leaf path becomes a column of (repetition level, definition level, value index).  A repetition level says at which
repeated ancestor the entry starts a new element (0: a new record), a definition level how many optional or repeated nodes of the
path are present.  The table of any repeated ancestor is then rebuilt from the level sequences alone: its elements are the entries
whose repetition level is not above the ancestor's and whose definition level reaches it.

The levels are computed per Arrow batch from the offsets and validity of the nested arrays with numpy: no loop over records, no
shuffle, no state beyond a batch.  Records never span batches, so parent links resolve within the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Leaf:
    """The shredded column of one path: levels, and the place of each value in `values` (-1: absent)."""

    rep: np.ndarray
    dfn: np.ndarray
    at: np.ndarray
    values: pa.Array
    #: (max repetition level, max definition level) at each repeated node of the path, outermost first.
    repeated: tuple[tuple[int, int], ...]
    max_dfn: int

    def take(self, rows: np.ndarray) -> pa.Array:
        at = self.at[rows]
        return self.values.take(pa.array(np.where(at < 0, 0, at), mask=at < 0)) if len(self.values) else pa.nulls(len(at), self.values.type)


def _walk(arr: pa.Array, path: str, rep, dfn, at, repeated, depth, want, out) -> None:
    if want is not None and not any(w == path or w.startswith(path + ".") or path.startswith(w + ".") for w in want):
        return
    valid = at >= 0
    if arr.null_count:
        ok = arr.is_valid().to_numpy(zero_copy_only=False)
        valid = valid & (ok[np.where(valid, at, 0)] if len(ok) else False)
    at, dfn, depth = np.where(valid, at, -1), dfn + valid, depth + 1
    kind = arr.type
    if pa.types.is_struct(kind):
        if want is None or path in want:
            out[path] = Leaf(rep, dfn, at, arr, repeated, depth)
        for i in range(kind.num_fields):
            _walk(arr.field(i), f"{path}.{kind.field(i).name}", rep, dfn, at, repeated, depth, want, out)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_map(kind):
        off = arr.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.zeros(len(at), np.int64)
        if len(arr):
            n[valid] = (off[1:] - off[:-1])[at[valid]]
        each = np.maximum(n, 1)
        start = np.cumsum(each) - each
        row = np.repeat(np.arange(len(at)), each)
        k = np.arange(len(row)) - start[row]
        level = len(repeated) + 1
        there = n[row] > 0
        base = off[np.where(at >= 0, at, 0)] if len(off) else np.zeros(len(at), np.int64)
        child = np.where(there, base[row] + k, -1)
        crep, cdfn = np.where(k == 0, rep[row], level), dfn[row] + there
        more = (*repeated, (level, depth + 1))
        if pa.types.is_map(kind):
            parts = (("key", arr.keys), ("value", arr.items))
        else:
            parts = (("element", arr.values),)
        for name, sub in parts:
            _walk(sub, f"{path}.{name}", crep, cdfn, child, more, depth + 1, want, out)
    else:
        out[path] = Leaf(rep, dfn, at, arr, repeated, depth)


def shred_batch(batch: pa.RecordBatch | pa.Table, columns: list[str], want: list[str] | None = None) -> dict[str, Leaf]:
    """Shred columns of a batch into leaves by path; map entries are `.key` and `.value`, list elements `.element`.

    want limits the work to the paths named (structs named there come as leaves too) and what lies on the way to them.
    """
    out: dict[str, Leaf] = {}
    for name in columns:
        arr = batch.column(name)
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        n = len(arr)
        _walk(arr, name, np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), (), 0, want, out)
    return out


def _last(mark: np.ndarray, values: np.ndarray) -> np.ndarray:
    """At each place the value at the last mark up to it."""
    idx = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), 0))
    return values[idx] if len(values) else values


def elements(leaf: Leaf, level: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the repeated ancestor at `level` (1: outermost): for each element its record, its 0-based positions at each level from
    the outermost down, and its entry in the level sequence."""
    record = np.cumsum(leaf.rep == 0) - 1
    positions = []
    for up in range(1, level + 1):
        starts = leaf.rep < up  # a new parent begins: count again from 0
        count = np.cumsum(leaf.rep == up)
        positions.append(count - _last(starts, count))
    dfn = leaf.repeated[level - 1][1]
    rows = np.flatnonzero((leaf.rep <= level) & (leaf.dfn >= dfn))
    return record[rows], [p[rows] for p in positions], rows


def rebuild(leaf: Leaf, records: int) -> list:
    """The nested lists of a leaf again, from its levels only (record assembly); an absent value above the first list is None."""
    out: list = [None] * records
    values = leaf.take(np.arange(len(leaf.rep))).to_pylist()
    stack: list = []
    r = -1
    for rep, dfn, value in zip(leaf.rep.tolist(), leaf.dfn.tolist(), values, strict=True):
        if rep == 0:
            r += 1
            stack = []
            if not leaf.repeated:
                out[r] = value
                continue
            if dfn < leaf.repeated[0][1] - 1:
                continue
            out[r] = []
            stack = [out[r]]
        del stack[max(rep, 1) :]
        for level in range(max(rep, 1), len(leaf.repeated) + 1):
            if dfn < leaf.repeated[level - 1][1]:
                break
            if level == len(leaf.repeated):
                stack[-1].append(value)
            elif dfn < leaf.repeated[level][1] - 1:
                stack[-1].append(None)
                break
            else:
                stack[-1].append([])
                stack.append(stack[-1][-1])
    return out


def _paths(kind: T.DataType, path: str, depth: int) -> Iterator[tuple[str, T.DataType, int]]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _paths(f.dataType, f"{path}.{f.name}", depth)
    elif isinstance(kind, T.ArrayType):
        yield from _paths(kind.elementType, f"{path}.element", depth + 1)
    elif isinstance(kind, T.MapType):
        yield from _paths(kind.keyType, f"{path}.key", depth + 1)
        yield from _paths(kind.valueType, f"{path}.value", depth + 1)
    else:
        yield path, kind, depth


def child_tables(df: DataFrame, record_id: str, column: str) -> dict[str, DataFrame]:
    """One flat table per repeated ancestor of a nested column.

    A table has the record's id, `pos_1 .. pos_k` (0-based places at each repeated level; the first k-1 are the key of its parent
    row), the keys of the maps on the way (`key_1` ..., null at list levels) and the leaves that hang on it without a further
    repetition, named by their path below it (`value` where that is empty).  Null elements are rows with
    null leaves and `present` false; null or empty lists have no rows.  Names are built from paths, so columns of the input cannot clash.
    """
    found: dict[str, tuple[list[tuple[str, T.DataType]], str, int]] = {}
    for path, kind, _ in _paths(df.schema[column].dataType, column, 0):
        parts = path.split(".")
        marks = [i for i, p in enumerate(parts) if i and p in ("element", "key", "value")]
        if not marks:
            continue
        for depth, i in enumerate(marks, 1):  # each repeated node, named by its list or map
            node = found.setdefault(".".join(parts[:i]), ([], path, depth))
        node[0].append((path, kind))
    idk = df.schema[record_id].dataType
    out = {}
    for top, (leaves, probe, k) in found.items():
        names = [("key" if p == f"{top}.key" else p[len(top) + 1 :].partition(".")[2].replace(".", "_") or "value") for p, _ in leaves]
        keys, at = [], ""
        for part in top.split(".") + ["*"]:
            if part in ("element", "value", "*") and at:
                keys.append(f"{at}.key")
            at = f"{at}.{part}" if at else part
        schema = T.StructType([T.StructField(record_id, idk)] + [T.StructField(f"pos_{i + 1}", T.IntegerType()) for i in range(k)] + [T.StructField(f"key_{i + 1}", T.StringType()) for i in range(k)] + [T.StructField("present", T.BooleanType())] + [T.StructField(f"leaf_{n}", t) for n, (_, t) in zip(names, leaves, strict=True)])
        out[top] = df.select(record_id, column).mapInArrow(_table_maker(record_id, column, [p for p, _ in leaves], probe, keys[:k], k, schema.fieldNames()), schema)
    return out


def _table_maker(record_id, column, paths, probe, key_paths, k, names):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shred_batch(batch, [column], [probe, *paths, *key_paths])
            record, pos, rows = elements(leaves[probe], k)
            cols = [batch.column(record_id).take(pa.array(record)), *(pa.array(p.astype(np.int32)) for p in pos)]
            for level, path in enumerate(key_paths, 1):
                key = leaves.get(path)
                if key is None:
                    cols.append(pa.nulls(len(rows), pa.string()))
                    continue
                r2, p2, e2 = elements(key, level)
                own, wanted = r2, record
                for mine, theirs in zip(p2, pos[:level], strict=True):  # both are in the order of records and positions
                    width = int(max(mine.max(initial=0), theirs.max(initial=0))) + 1
                    own, wanted = own * width + mine, wanted * width + theirs
                cols.append(key.take(e2).cast(pa.string()).take(pa.array(np.searchsorted(own, wanted))) if len(rows) else pa.nulls(0, pa.string()))
            cols.append(pa.array(leaves[probe].dfn[rows] > leaves[probe].repeated[k - 1][1]))
            for path in paths:
                leaf = leaves[path]
                cols.append(leaf.take(elements(leaf, k)[2]))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return make


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*[p if isinstance(p, pa.Array) else pa.array(p) if isinstance(p, np.ndarray) else pa.scalar(p) for p in parts], "#")


def _isin(record: np.ndarray, text: pa.Array, own: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Whether (record, text) is one of (own, keys); by code of the string, so hashing never decides."""
    both = pa.chunked_array([keys.cast(pa.string()), text.cast(pa.string())]).combine_chunks()
    code = both.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    span = int(code.max(initial=0)) + 1
    return np.isin(record * span + code[len(keys) :], own * span + code[: len(keys)])


_PATHS = {
    "entities": ["entities.key", "entities.value.mentions.element"],
    "relations": ["relations.key", "relations.value.element.element"],
    "ontology_links": ["ontology_links.by_entity.key", "ontology_links.by_entity.value.candidates.element", "ontology_links.by_entity.value.selected"],
}


def document_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of relation-extraction documents (row_id, entities, relations, ontology_links): one row (row_id, child_table, child_key) per
    child, the endpoints and candidates told apart by whether they lead to an entity of their record."""
    for batch in batches:
        ids = batch.column("row_id")
        leaves = {}
        for column, want in _PATHS.items():
            leaves |= shred_batch(batch, [column], want)
        tables: list[tuple[np.ndarray, object, pa.Array]] = []

        ekey = leaves["entities.key"]
        erec, _, erow = elements(ekey, 1)
        enames = ekey.take(erow)
        tables.append((erec, "entity", enames))

        def name_of(leaf: Leaf, names: Leaf, depth: int, keep=None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
            """Of the elements at `depth`: record, key of their map entry, position, entry."""
            rec, pos, row = elements(leaf, depth)
            krec, kpos, krow = elements(names, 1)
            width = int(max(pos[0].max(initial=0), kpos[0].max(initial=0))) + 1
            place = np.searchsorted(krec * width + kpos[0], rec * width + pos[0])
            return rec, names.take(krow).take(pa.array(place)), pos[depth - 1], row

        text = lambda pos: pa.array(pos).cast(pa.string())

        mention = leaves["entities.value.mentions.element"]
        rec, name, pos, row = name_of(mention, ekey, 2)
        ok = np.flatnonzero(mention.at[row] >= 0)
        tables.append((rec[ok], "mention", _joined(name.take(pa.array(ok)), text(pos[ok]))))

        word, rkey = leaves["relations.value.element.element"], leaves["relations.key"]
        rec, name, pos, row = name_of(word, rkey, 2)
        wrec, wpos, wrow = elements(word, 3)
        width = int(wpos[0].max(initial=0)) + 1, int(wpos[1].max(initial=0)) + 1
        code = lambda r, p: (r * width[0] + p[0]) * width[1] + p[1]
        _, ppos, _ = elements(word, 2)
        pair, of_word = code(rec, ppos) if len(rec) else rec, code(wrec, wpos) if len(wrec) else wrec
        owner = np.searchsorted(pair, of_word)
        good = word.at[wrow] >= 0
        size, strings = np.bincount(owner, minlength=len(pair)), np.bincount(owner, weights=good, minlength=len(pair))
        fine = (size == 2) & (strings == 2)
        ok = np.flatnonzero(fine)
        keys = _joined(name.take(pa.array(ok)), text(pos[ok])) if len(ok) else pa.array([], pa.string())
        tables.append((rec[ok], "relation", keys))
        ends = np.flatnonzero(fine[owner]) if len(owner) else owner
        if len(ends):
            back = np.searchsorted(ok, owner[ends])
            side = pa.array(np.where(wpos[2][ends] == 0, "h", "t"))
            known = _isin(wrec[ends], word.take(wrow[ends]), erec, enames)
            tables.append((wrec[ends], np.where(known, "endpoint", "orphan_endpoint"), _joined(keys.take(pa.array(back)), side)))

        lkey, cand, chosen = leaves["ontology_links.by_entity.key"], leaves["ontology_links.by_entity.value.candidates.element"], leaves["ontology_links.by_entity.value.selected"]
        rec, name, pos, row = name_of(cand, lkey, 2)
        ok = np.flatnonzero(cand.at[row] >= 0)
        if len(ok):
            name = name.take(pa.array(ok))
            known = _isin(rec[ok], name, erec, enames)
            tables.append((rec[ok], np.where(known, "candidate", "orphan_candidate"), _joined(name, text(pos[ok]))))
        srec, _, srow = elements(chosen, 1)
        krec, _, krow = elements(lkey, 1)
        ok = np.flatnonzero(chosen.at[srow] >= 0)
        tables.append((srec[ok], "selected", lkey.take(krow).take(pa.array(ok))))

        for rec, kind, key in tables:
            if len(rec):
                kinds = pa.array(kind) if isinstance(kind, np.ndarray) else pa.array([kind]).take(pa.array(np.zeros(len(rec), np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rec)), kinds, key.cast(pa.string())], names=["row_id", "child_table", "child_key"])


def found_children(df: DataFrame) -> DataFrame:
    """(row_id, child_table, child_key) of all rows of df, by shredding; narrow, one pass over three columns.

    Null or empty maps and lists give no rows, null elements none but keep their place; rows with a null id keep it; repeated rows
    count as often as they stand there; other columns are not read.
    """
    return df.select("row_id", "entities", "relations", F.col("ontology_links")).mapInArrow(document_children, "row_id bigint, child_table string, child_key string")
