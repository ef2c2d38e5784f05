"""python -m weirlight.cli ROOT OUT: scans a repository and writes facts, graph, metrics and reports."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weirlight.operators import lineage, reports
from weirlight.plans.scan import scan
from weirlight.sources import sinks


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--as-of", help="day for date expressions, YYYY-MM-DD; without it they stay open")
    p.add_argument("--workbook", help="also write the report sheets as one workbook of this name, on the driver")
    p.add_argument("--overwrite", action="store_true", help="replace earlier results")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("weirlight").getOrCreate()
    got = scan(spark, a.root, a.as_of)
    for name, df, by in (("facts", got.facts, ["fact_type"]), ("nodes", got.nodes, []), ("edges", got.edges, []), ("metrics", got.metrics, [])):
        sinks.write_parquet(df, f"{a.out}/{name}", *by, overwrite=a.overwrite)
    sheets = {"summary": reports.summary(got.metrics), "top": reports.top_priorities(got.metrics), "sources": reports.sources(got.edges), "pivot": reports.pivot_ready(got.nodes, got.edges, got.metrics), "datasets": reports.all_datasets(got.nodes, lineage.degrees(got.edges)), "jobs": reports.all_jobs(got.nodes, got.edges), "edges": reports.top_edges(got.edges), "metrics": got.metrics}
    sinks.write_sheets(sheets, f"{a.out}/sheets", a.overwrite)
    if a.workbook:
        sinks.write_workbook(sheets, a.workbook, a.overwrite)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
