"""Settings of a scan, and what the session's catalog knows of a table."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.functions.paths import table_name
from weirlight.sources.repository import SKIPPED_GLOBS, SKIPPED_SUFFIXES

PLACES = ("weirlight.yaml", "config/weirlight.yaml", ".weirlight.yaml")


@dataclass(frozen=True)
class Settings:
    ignore_globs: tuple[str, ...] = SKIPPED_GLOBS
    ignore_suffixes: tuple[str, ...] = SKIPPED_SUFFIXES
    min_confidence: float = 0.0
    with_rules: bool = True
    rules: str | None = None
    as_of: str | None = None
    environment: dict[str, Any] = field(default_factory=dict)


def load_settings(path: str | None = None, base: str = ".") -> Settings:
    """Settings of a YAML file, or of the first standard place that exists, else the defaults. An unknown name is an error."""
    import yaml

    own = Path(path) if path else next((p for x in PLACES if (p := Path(base, x)).exists()), None)
    if own is None:
        return Settings()
    given = yaml.safe_load(own.read_text()) or {}
    unknown = set(given) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"{own}: unknown settings {sorted(unknown)}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def known_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    """name and kind of the catalog's tables."""
    rows = [(f"{database}.{t.name}".lower(), t.tableType) for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "name string, kind string")


def with_catalog(datasets: DataFrame, tables: DataFrame) -> DataFrame:
    """datasets (urn, ...) with is_known: whether a hive:// one is a table of the catalog; null for others."""
    hive = F.col("urn").startswith("hive://")
    named = datasets.withColumn("_n", F.when(hive, table_name(F.substring("urn", 8, 10_000))))
    marked = named.join(tables.select(F.col("name").alias("_n"), F.lit(True).alias("_k")).distinct(), "_n", "left")
    return marked.withColumn("is_known", F.when(hive, F.coalesce("_k", F.lit(False)))).drop("_n", "_k")
