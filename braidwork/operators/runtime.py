"""Accounting of runs: time, energy and emissions, counts of eligible documents."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.session import file_state


def eligible(documents: DataFrame, types: list[str] | None = None) -> DataFrame:
    """AGG14: all documents, and those of the types given that have text or sentences."""
    fits = F.col("text").rlike(r"(?U)\S") | (F.size("sentences") > 0)
    fits = F.coalesce(fits, F.lit(False)) & (F.coalesce(F.col("type").isin(types), F.lit(False)) if types else F.lit(True))
    return documents.agg(F.count("*").alias("n_total_documents"), F.count_if(fits).alias("n_eligible_documents"))


def energy(runs: DataFrame, power_kw: float = 0.3, kg_per_kwh: float = 0.045) -> DataFrame:
    """AGG16: runs (status, elapsed_seconds_doc, n_eligible_documents, ...) with energy and emissions of one document and of all eligible
    ones; null where the run did not end well."""
    s, n = F.when(F.col("status") == "OK", F.col("elapsed_seconds_doc")), F.col("n_eligible_documents")
    kwh = s / 3600 * power_kw
    total = s * n
    return runs.withColumns(
        {
            "elapsed_seconds_doc": s, "elapsed_minutes_doc": s / 60, "energy_kwh_doc": kwh, "co2_kg_doc": kwh * kg_per_kwh, "co2_g_doc": kwh * kg_per_kwh * 1000,
            "estimated_total_seconds": total, "estimated_total_minutes": total / 60, "estimated_total_hours": total / 3600, "estimated_total_energy_kwh": kwh * n, "estimated_total_co2_kg": kwh * kg_per_kwh * n, "estimated_total_co2_g": kwh * kg_per_kwh * n * 1000,
        }
    )


def build_hash(spark: SparkSession | None = None, path: str | None = None, **parameters: object) -> str:
    """IDX4: 12 hex digits that tell builds apart by their parameters and, where a path is given, by the place, size and time of change of the
    file they were made from."""
    state = [path, *file_state(spark, path)] if path is not None else []
    return hashlib.sha256(json.dumps([state, parameters], sort_keys=True, default=str).encode()).hexdigest()[:12]
