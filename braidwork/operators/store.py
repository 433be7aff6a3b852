"""Vector and graph stores kept as tables of the shared file system: upserts by id, exact search, batches for a server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import embed
from braidwork.operators import retrieve
from braidwork.operators.filters import primitive_columns
from braidwork.session import file_system

#: A namespace of our own for ids made from names.
NAMESPACE = "6f0b2a6e-3f0c-4b55-9d0a-52c6b1f3a7e4"


def point_id(x: Column | str, namespace: str = NAMESPACE) -> Column:
    """RET5: the UUID of version 5 of a string in a namespace."""
    x = F.col(x) if isinstance(x, str) else x
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), x.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.conv((F.conv(part(17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


class VectorStore:
    """RET4, RET5, IDX3: chunks (id, document_id, text, ...) with their vectors under a path, each upsert a new version of the table, so a reader
    or a failed write never sees half of one.  Vectors are computed once, when a chunk is stored."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 256):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def _version(self) -> int:
        p, fs = file_system(self.spark, f"{self.path}/v=*/_SUCCESS")
        return max((int(s.getPath().getParent().getName().partition("=")[2]) for s in fs.globStatus(p) or []), default=0)

    def rows(self) -> DataFrame | None:
        """What is stored now; None before the first upsert."""
        v = self._version()
        return self.spark.read.parquet(f"{self.path}/v={v}") if v else None

    def upsert(self, chunks: DataFrame, make=None, keep: int = 2) -> int:
        """Store chunks with their vectors (those given, else hashed, or those of `make`, a model's loader), replacing the ones of the same id;
        of repeated ids in chunks the largest text stays.  The number of the new version; the last `keep` versions stay."""
        columns = [c for c in chunks.columns if c not in ("id", "text")]
        one = chunks.groupBy("id").agg(F.max_by(F.struct("text", *columns), F.struct(F.coalesce("text", F.lit("")))).alias("c")).select("id", "c.*")
        new = one if "vector" in columns else embed.embed(one, "text", "vector", self.dim, make)
        new = new.withColumn("point_id", point_id(F.col("id").cast("string")))
        old, v = self.rows(), self._version()
        both = new if old is None else old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
        both.write.mode("overwrite").parquet(f"{self.path}/v={v + 1}")
        for n in range(1, v + 2 - keep):
            p, fs = file_system(self.spark, f"{self.path}/v={n}")
            fs.delete(p, True)
        return v + 1

    def search(self, queries: DataFrame, k: int = 5, score: str = "cosine", where: Column | str | None = None, make=None) -> DataFrame:
        """(query_id, id, score, rank, document_id, text) of the k best chunks for each query (query_id, text); where filters the chunks first."""
        held = self.rows()
        if held is None:
            raise ValueError("nothing is stored yet")
        held = held if where is None else held.where(where)
        asked = queries if "vector" in queries.columns else embed.embed(queries.select("query_id", "text"), "text", "vector", self.dim, make)
        best = retrieve.nearest(asked.select("query_id", "vector"), held, "query_id", "id", "vector", k, score, None)
        return best.join(held.select("id", "document_id", "text"), "id")


#: Statements for a property-graph server: nodes merged by id, edges of one label by their ends and type.
MERGE_NODES = "UNWIND $rows AS row MERGE (n:Entity {id: row.id}) SET n += row.properties"
MERGE_EDGES = "UNWIND $rows AS row MERGE (a:Entity {id: row.source}) MERGE (b:Entity {id: row.target}) MERGE (a)-[r:REL {type: row.type}]->(b) SET r += row.properties"


def merge_batches(rows: DataFrame, kind: str, size: int = 1000) -> DataFrame:
    """IDX7: (batch, statement, rows): nodes (id, ...) or edges (head, rel, tail, ...) as parameters of at most about `size` rows each, for a client
    that sends them; only plain properties go along (FLT6).  Batches are cut within partitions, so nothing is sorted or collected."""
    if kind not in ("nodes", "edges"):
        raise ValueError(f"unknown kind {kind!r}")
    plain = primitive_columns(rows)
    ends = {"id": "id"} if kind == "nodes" else {"head": "source", "rel": "type", "tail": "target"}
    rest = [c for c in plain.columns if c not in ends]
    one = F.struct(*(F.col(c).alias(n) for c, n in ends.items()), F.struct(*rest).alias("properties") if rest else F.create_map().cast("map<string,string>").alias("properties"))
    parts = max(1, -(-plain.count() // size))
    batch = F.pmod(F.xxhash64(*ends), F.lit(parts))
    listed = plain.select(batch.alias("batch"), one.alias("r")).groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("rows"))
    return listed.select("batch", F.lit(MERGE_NODES if kind == "nodes" else MERGE_EDGES).alias("statement"), "rows")
