"""The whole way from a repository to its metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weirlight.functions.resolve import resolved, symbol_table
from weirlight.operators import facts as fx
from weirlight.operators import lineage, rules, scoring
from weirlight.operators.extract import extract_facts
from weirlight.sources.repository import crawl
from weirlight.sources.storage import stored


@dataclass
class Lineage:
    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame


def scan(spark: SparkSession, root: str, as_of: str | None = None, with_rules: bool = True) -> Lineage:
    """Facts of extractors and rules without repeats, variables resolved, graph and metrics. Facts, nodes and edges are written tables."""
    files = crawl(spark, root)
    found = extract_facts(files, as_of)
    if with_rules:
        typed = files.selectExpr("relative_path as path", "file_type", "content")
        found = fx.union(found.drop("fact_id"), rules.to_facts(rules.matches(typed, rules.default_rules(spark))))
    found = stored(fx.without_repeats(found.drop("fact_id").drop("resolved_path")))
    found = stored(resolved(found, symbol_table(found)))
    nodes = stored(lineage.nodes_of(found.where("fact_type != 'ERROR'")))
    edges = stored(lineage.edges_of(found, nodes))
    return Lineage(found, nodes, edges, stored(scoring.metrics(nodes, edges)))
