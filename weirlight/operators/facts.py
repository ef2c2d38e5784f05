"""The relation of facts: selection, counts, union and removal of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.schema import EXTRACTED, with_fact_id

KEY = ("fact_type", "dataset_urn", "source_file", "line_number", "config_key", "dependency_job")


def select_facts(facts: DataFrame, fact_type: str | None = None, min_confidence: float | None = None, source_file: str | None = None, has_placeholders: bool | None = None) -> DataFrame:
    """Facts that meet all the conditions given; they reach the scan as filters."""
    for column, value in (("fact_type", fact_type), ("source_file", source_file), ("has_placeholders", has_placeholders)):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    return facts if min_confidence is None else facts.where(F.col("confidence") >= min_confidence)


def datasets(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("dataset_urn").isNotNull() & (F.col("dataset_urn") != "")).select("dataset_urn").distinct()


def source_files(facts: DataFrame) -> DataFrame:
    return facts.select("source_file").distinct()


def statistics(facts: DataFrame) -> DataFrame:
    """One row: numbers of facts by kind and by band of confidence."""
    kind = lambda k: F.count_if(F.col("fact_type") == k)
    c = F.col("confidence")
    return facts.agg(
        F.count("*").alias("total"), kind("READ").alias("reads"), kind("WRITE").alias("writes"), kind("CONFIG").alias("configs"), kind("JOB_DEPENDENCY").alias("dependencies"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"), F.countDistinct("source_file").alias("files"), F.countDistinct("dataset_urn").alias("datasets"),
    )


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def without_repeats(facts: DataFrame) -> DataFrame:
    """Of facts with one key the most confident; ties go to the method and evidence that sort first.

    Repeats that differ in confidence alone go first, by numbers that a hash aggregate keeps in place: the least of structs
    sorts all that a task reads, so it is left what else differs.
    """
    rest = [c for c in facts.columns if c not in (*KEY, "confidence")]
    keys = [c for c in KEY if c in facts.columns]
    once = facts.groupBy(*keys, *rest).agg(F.min(-F.col("confidence")).alias("_c"), F.bool_or(F.col("confidence").isNull()).alias("_n"))
    best = F.min(F.struct(F.when(~F.col("_n"), F.col("_c")).alias("_c"), *[F.col(c) for c in ("extraction_method", "evidence") if c in rest], *[F.col(c) for c in rest if c not in ("extraction_method", "evidence")])).alias("_b")
    own = lambda c: F.col(c) if c in keys else (-F.col("_b._c") if c == "confidence" else F.col(f"_b.{c}")).alias(c)
    return once.groupBy(*keys).agg(best).select(*map(own, facts.columns))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Facts written as JSON, with all columns of every kind."""
    return with_fact_id(spark.read.schema(EXTRACTED).json(path))


def save_json(facts: DataFrame, path: str, overwrite: bool = False) -> None:
    facts.write.mode("overwrite" if overwrite else "errorifexists").json(path)
