"""More relation types and metrics than a thousand."""

from pyspark.sql import functions as F

from braidwork.plans.graphs import kg_bfs
from braidwork.sources.sinks import summary
from braidwork.sources.tables import table


def test_walk_keeps_all_relation_types(spark, tmp_path):
    one = table(spark, "/root/testdata/sf0.001", "re_documents").limit(1)
    kind = one.schema["entities"].dataType.valueType
    docs = one.drop("row_id").crossJoin(spark.range(300).toDF("row_id")).select(
        *(c for c in one.columns if c not in ("document_id", "entities", "relations")),
        F.expr("concat('d', row_id)").alias("document_id"),
        F.create_map(F.expr("concat('n', row_id)"), F.lit(None).cast(kind)).alias("entities"),
        F.expr("map_from_entries(transform(sequence(0, 4), k -> struct(concat('r', row_id, '_', k), array(array(concat('n', row_id), concat('x', k))))))").alias("relations"),
    )
    docs.write.parquet(f"{tmp_path}/re_documents.parquet")
    assert kg_bfs(spark, str(tmp_path)).select("rel").distinct().count() == 1500


def test_summary_keeps_all_metrics(spark):
    results = spark.sql("SELECT 'a' AS task_type, array('e') AS evidence, 'o' AS output, map_from_entries(transform(sequence(1, 1100), k -> struct(concat('m', k), double(k)))) AS metrics")
    assert len(summary(results).columns) == 1103
