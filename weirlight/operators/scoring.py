"""Confidence, priority and migration waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlight.operators import lineage

GENERIC = ("data", "table", "path", "file", "unknown")
TEMPORARY = ("tmp", "temp", "staging", "scratch", "backup", "test_", "_bak")


def _clamped(x: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6)


def fact_score(regex_penalty: float = 0.05) -> Column:
    """Confidence less 0.1 for placeholders (more without), less 0.1 if ambiguous, less the penalty for regular expressions."""
    x = F.col("confidence") + F.when(F.col("has_placeholders"), -0.1).otherwise(0.1) - F.when(F.coalesce("is_ambiguous", F.lit(False)), 0.1).otherwise(0.0)
    return _clamped(x - F.when(F.col("extraction_method") == "REGEX", regex_penalty).otherwise(0.0))


def adjusted_confidence() -> Column:
    return fact_score(0.2)


def edge_score(edges: DataFrame) -> DataFrame:
    """Of each (src, dst, edge_type): the mean of its facts' scores, averaged with its best own confidence."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.round((F.avg("score") + F.max("confidence")) / 2, 6).alias("edge_score"))


def is_eligible(urn: Column, name: Column, wildcards: bool = False) -> Column:
    """A dataset that counts: no wildcard (unless allowed), nothing temporary, no generic or very short name."""
    low = F.lower(urn)
    out = ~F.lower(name).isin(*GENERIC) & (F.length(name) >= 3)
    for t in TEMPORARY:
        out = out & ~low.contains(t)
    return out if wildcards else out & ~urn.contains("*")


def priority(reach: Column, fan_out: Column, writers: Column, shell_only: Column, confidence: Column) -> Column:
    return F.round((reach * 3 + fan_out * 2 + writers - F.when(shell_only, 2).otherwise(0)) * confidence, 6)


def wave(score: Column, confidence: Column, shell_only: Column) -> Column:
    return F.when(shell_only, 3).when((score > 50) & (confidence > 0.7), 1).when((score > 20) | (confidence > 0.6), 2).otherwise(3)


def eligible(nodes: DataFrame) -> DataFrame:
    """urn and name of the datasets that count."""
    return nodes.where("node_type = 'DATASET'").where(is_eligible(F.col("urn"), F.col("name"))).select("urn", "name")


def metrics(nodes: DataFrame, edges: DataFrame, reach: DataFrame | None = None, vacuous_shell: bool = False) -> DataFrame:
    """One row for each eligible dataset. A dataset without writers counts as written by shell jobs alone only if vacuous_shell."""
    sets = eligible(nodes)
    incoming = edges.groupBy(F.col("dst").alias("urn")).agg(F.round(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("avg_confidence"))
    writers = lineage.simple(edges).where(F.col("src").startswith("job://")).groupBy(F.col("dst").alias("urn")).agg(F.count("*").alias("write_job_count"), F.bool_and(F.lower("src").contains("shell")).alias("is_shell_only"))
    out = sets.join(lineage.degrees(edges), "urn", "left").join(lineage.reach(edges) if reach is None else reach, "urn", "left").join(incoming, "urn", "left").join(writers, "urn", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("urn", "name", zero("fan_in"), zero("fan_out"), zero("downstream_reach"), zero("write_job_count"), F.coalesce("avg_confidence", F.lit(0.5)).alias("avg_confidence"), F.coalesce("is_shell_only", F.lit(vacuous_shell)).alias("is_shell_only"))
    out = out.withColumn("priority_score", priority(F.col("downstream_reach"), F.col("fan_out"), F.col("write_job_count"), F.col("is_shell_only"), F.col("avg_confidence")))
    return out.withColumn("migration_wave", wave(F.col("priority_score"), F.col("avg_confidence"), F.col("is_shell_only")))


def top(measured: DataFrame, n: int = 10) -> DataFrame:
    return measured.orderBy(F.desc("priority_score"), "urn").limit(n)


def in_wave(measured: DataFrame, number: int) -> DataFrame:
    return measured.where(F.col("migration_wave") == number)
