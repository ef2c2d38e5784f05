"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from weirlight.plans import registry

DATA = Path("/root/testdata/sf0.001")
NAMES = [n for n in registry.QUERIES if n.startswith(("extract_", "sink_", "detect_"))] + ["crawl_files", "facts_as_json", "rules_match", "rules_from_file", "rules_stats", "settings_discovered", "config_flatten", "urn_lookup", "direct_neighbours", "score_edges", "analytics_low_confidence", "shape_approximate", "shape_anti_join", "shape_stream_static_join", "shape_multiple_insert", "shape_session_windows"]
NAMES += ["facts_stats", "facts_without_repeats", "rules_to_facts", "resolve_paths", "canonical_paths", "edges_produces", "priority_metrics", "report_pivot", "shape_analytic_windows", "shape_stream"]


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    done = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(str(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in done.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()) == want


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_full_outer_join_has_every_row(spark):
    test_matches_sql(spark, "shape_full_outer_join")
    got = registry.QUERIES["shape_full_outer_join"](spark, str(DATA)).toPandas()
    assert got.c_custkey.nunique() == spark.read.parquet(str(DATA / "customer.parquet")).count()
    assert got.o_orderkey.nunique() == spark.read.parquet(str(DATA / "orders.parquet")).count()


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
