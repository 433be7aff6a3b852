"""Session helpers: shared folder, lineage cuts, worker imports."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship() -> None:
    """Let workers run this package's functions without importing it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE, last map key wins)."""
    build = SparkSession.builder.master(master).appName("braidwork")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.ui.enabled": "false"}
    for k, v in (base | conf).items():
        build = build.config(k, v)
    ship()
    return build.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where that is unset, a temporary folder of this machine, which only a local
    master can share; with another master that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if at is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="braidwork-")
        sc.setCheckpointDir(at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of change of a file, or of all files of a folder together."""
    p, fs = file_system(spark, path)
    states = fs.listStatus(p)
    return sum(s.getLen() for s in states), max((s.getModificationTime() for s in states), default=0)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text of the driver as one file, on any file system."""
    p, fs = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


_STAGED: list[str] = []


def stage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again. A lost executor costs nothing then.  With keep,
    released() leaves the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    if not keep:
        _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at the end; what is made of them must be written by then."""
    before = len(_STAGED)
    try:
        yield
    finally:
        for path in _STAGED[before:]:
            p, fs = file_system(spark, path)
            fs.delete(p, True)
        del _STAGED[before:]
