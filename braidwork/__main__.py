"""python -m braidwork queries | run NAME TABLES OUT | evaluate GOLD PREDICTIONS [--ignore LABEL ...] | convert NAME IN OUT"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="braidwork", description="Queries and evaluations from the command line.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the queries")
    run = sub.add_parser("run", help="write a query's rows as Parquet")
    for a in ("name", "tables", "out"):
        run.add_argument(a)
    ev = sub.add_parser("evaluate", help="scores of predicted relations against gold")
    ev.add_argument("gold")
    ev.add_argument("predictions")
    ev.add_argument("--ignore", action="append", default=[])
    conv = sub.add_parser("convert", help="raw rows (JSON lines of the converter's schema) to documents")
    for a in ("name", "source", "out"):
        conv.add_argument(a)
    got = p.parse_args(args)

    from braidwork.plans.catalogue import QUERIES
    from braidwork.session import session

    if got.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = session()
    if got.command == "run":
        if got.name not in QUERIES:
            p.error(f"there is no query {got.name}")
        QUERIES[got.name](spark, got.tables).write.mode("overwrite").parquet(got.out)
    elif got.command == "evaluate":
        from braidwork.plans.pipeline import evaluate_files

        scores, counts = evaluate_files(spark, got.gold, got.predictions, tuple(got.ignore))
        total = scores.where("total").first()
        print(f"P={total.precision:.4f} R={total.recall:.4f} F1={total.f1:.4f} tp={total.tp} fp={total.fp} fn={total.fn}")
        print("documents seen {}, evaluated {}, without gold {}".format(*counts.first()))
    else:
        from braidwork.operators import convert

        if got.name != "maven_ere":
            p.error("only converters of one source can be run from here; the others take several frames")
        raw = spark.read.schema(convert.MAVEN).json(got.source)
        from pyspark.sql import functions as F

        convert.convert(got.name, raw.withColumn("split", convert.split_of(F.col("_metadata.file_path")))).write.mode("overwrite").json(got.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
