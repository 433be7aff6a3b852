"""Duplicates hidden by formatting differences: one record per fact, with its exact number of copies.

Records are reduced to canonical keys (letters and digits of each field, case folded, accents kept), range-partitioned by key and id,
sorted externally (Spark's spilling sort) and scanned: adjacent rows with the same full keys are a run.  As the id is the last range
key, a key that holds a third of all rows spreads over many partitions.  A run that crosses a border is put together from one summary
row per partition (first key, last key, start of the last run), the only thing the driver sees.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.session import stage

# The names a field may have in a line.
FIELDS = {"head": ("head", "h", "source"), "rel": ("rel", "r", "relation"), "tail": ("tail", "t", "target")}
_PART = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|\{.*?\}(?=\t| ; | \| |$))(?:\t| ; | \| |$)', re.S)
_NAMES = {name: field for field, names in FIELDS.items() for name in names}


def parse_line(line: str | None) -> tuple[str, str, str] | None:
    """(head, rel, tail) of a line, a JSON object or key=value pairs in any order; None if it is cut off, a field is missing, twice
    there or no string."""
    if not line or not (text := line.strip()):
        return None
    try:
        if text[0] == "{":
            pairs = list(json.loads(text).items())
        else:
            pairs, at = [], 0
            while at < len(text):
                m = _PART.match(text, at)
                if m is None:
                    return None
                pairs.append((m[1], json.loads(m[2], strict=False)))
                at = m.end()
    except ValueError:
        return None
    got: dict[str, str] = {}
    for name, value in pairs:
        if field := _NAMES.get(name):
            if field in got or not isinstance(value, str):
                return None
            got[field] = value
    return (got["head"], got["rel"], got["tail"]) if len(got) == 3 else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *p) for i, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (p := parse_line(line))]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["id", "head", "rel", "tail"])


def line_facts(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """(id, head, rel, tail) of the lines that are whole."""
    return lines.select(line_id, line).mapInArrow(_parse, "id bigint, head string, rel string, tail string")


def canonical(c: str):
    """Letters and digits of a field, case folded, accents kept; null if none is left."""
    return F.nullif(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{M}\p{N}]", ""), F.lit(""))


#: kind 0: a copy (keep, id); 1: a run (keep, n); 2: the summary of a partition (keep: start of the last run, id: of the first).
_OUT = "kind int, part int, first boolean, keep bigint, id bigint, n bigint, head string, rel string, tail string, head2 string, rel2 string, tail2 string"


def _scan(copies: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        none = np.zeros(0, np.int64)
        last: tuple | None = None  # full key of the run that is open
        start, size, opening, first_key, first_id = 0, 0, True, None, 0

        def rows(kind, first, keep, ids, n, keys):
            m = len(keep)
            texts = [pa.array([k[j] for k in keys], pa.string()) if keys else pa.nulls(m, pa.string()) for j in range(6)] if kind else [pa.nulls(m, pa.string())] * 6
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, part, np.int32)), pa.array(first), pa.array(keep), pa.array(ids), pa.array(n), *texts], names=[x.split()[0] for x in _OUT.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(j) for j in range(3)]
            ids = b.column(3).to_numpy()
            new = np.ones(len(ids), bool)
            same = np.ones(len(ids) - 1, bool)
            for k in keys:
                same &= pa.compute.equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = ~same
            head = tuple(k[0].as_py() for k in keys)
            if last is None:
                first_key, first_id = head, int(ids[0])
            new[0] = last != head
            starts = np.flatnonzero(new)
            run = np.cumsum(new)  # 0: the run that was open before
            keep = np.concatenate([[start], ids[starts]])[run]
            first = (run == 0) & opening if last is not None else (run == 1)
            if copies:
                is_copy = ~new
                if is_copy.any():
                    yield rows(0, first[is_copy], keep[is_copy], ids[is_copy], np.ones(int(is_copy.sum()), np.int64), None)
            else:
                counts = np.bincount(run, minlength=len(starts) + 1)
                ended, done = [], []
                if last is not None and len(starts):
                    ended.append((start, size + int(counts[0]), opening, last))
                texts = [k.take(pa.array(starts[:-1])).to_pylist() for k in keys]
                for j, s in enumerate(starts[:-1].tolist()):
                    ended.append((int(ids[s]), int(counts[j + 1]), last is None and j == 0, tuple(t[j] for t in texts)))
                if ended:
                    done = [(*e[3], None, None, None) for e in ended]
                    yield rows(1, np.array([e[2] for e in ended]), np.array([e[0] for e in ended]), np.array([e[0] for e in ended]), np.array([e[1] for e in ended]), done)
                size = int(counts[-1]) + (size if not len(starts) else 0)
            if len(starts):
                opening = last is None and len(starts) == 1
                start = int(ids[starts[-1]])
            last = tuple(k[-1].as_py() for k in keys)
        if last is not None:
            if not copies:
                yield rows(1, np.array([opening]), np.array([start]), np.array([start]), np.array([size]), [(*last, None, None, None)])
            yield rows(2, np.array([opening]), np.array([start]), np.array([first_id]), none.sum(keepdims=True), [(*first_key, *last)])

    return scan


def _scanned(records: DataFrame, copies: bool) -> tuple[DataFrame, dict[int, int]]:
    """The scan's rows, and for each partition that continues a run of the one before, that run's first id."""
    spark = records.sparkSession
    keys = records.select(*(canonical(c).alias(c) for c in ("head", "rel", "tail")), F.col("id").cast("bigint").alias("id")).dropna()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["head", "rel", "tail", "id"]
    out = stage(keys.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_scan(copies), _OUT))
    carry: dict[int, int] = {}
    before, keep = None, 0
    for r in out.where("kind = 2").orderBy("part").collect():  # one row per partition
        if before == (r.head, r.rel, r.tail):
            carry[r.part] = keep
        if not (r.first and r.part in carry):
            keep = r.keep
        before = (r.head2, r.rel2, r.tail2)
    return out, carry


def copies(records: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of records (id, head, rel, tail; ids unique): the smallest id of each group of equal canonical facts
    with each of its other ids.

    Null and blank fields, or fields without letter or digit, are no facts; an empty table gives no rows; repeated rows are copies
    like others; other columns are not read.
    """
    out, carry = _scanned(records, True)
    spark = records.sparkSession
    moved = spark.createDataFrame(list(carry.items()), "part int, carried bigint")
    rows = out.where("kind = 0").select("part", "first", "keep", F.col("id").alias("copy_id"))
    opened = out.where("kind = 2").select("part", F.lit(True).alias("first"), F.lit(None).cast("bigint").alias("keep"), F.col("id").alias("copy_id"))
    joined = rows.unionAll(opened).join(F.broadcast(moved), "part", "left")
    keep = F.when(F.col("first"), F.coalesce("carried", "keep")).otherwise(F.col("keep"))
    return joined.select(keep.alias("keep_id"), "copy_id").where("keep_id IS NOT NULL AND keep_id <> copy_id")


def facts(records: DataFrame) -> DataFrame:
    """(keep_id, head, rel, tail, copies): one canonical record per fact with its exact number of records; cases as in copies()."""
    out, carry = _scanned(records, False)
    spark = records.sparkSession
    moved = spark.createDataFrame(list(carry.items()), "part int, carried bigint")
    runs = out.where("kind = 1").join(F.broadcast(moved), "part", "left")
    across = list(set(carry.values()))  # starts of the runs that cross a border: fewer than partitions
    keep = F.when(F.col("first"), F.coalesce("carried", "keep")).otherwise(F.col("keep"))
    runs = runs.select(keep.alias("keep_id"), "head", "rel", "tail", F.col("n").alias("copies"))
    whole = runs.where(~F.col("keep_id").isin(across)) if across else runs
    parts = runs.where(F.col("keep_id").isin(across)).groupBy("keep_id", "head", "rel", "tail").agg(F.sum("copies").alias("copies")) if across else None
    return whole.unionAll(parts) if parts is not None else whole
