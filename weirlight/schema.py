"""Relations of the engine: facts, nodes, edges and metrics, with ids that depend on content alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an extractor emits. params is JSON text; the six last columns belong to single kinds of facts.
EXTRACTED = (
    "fact_type string, source_file string, line_number int, confidence double, dataset_urn string, dataset_type string, "
    "job_name string, module_name string, params string, evidence string, extraction_method string, has_placeholders boolean, "
    "is_ambiguous boolean, resolved_path string, write_mode string, config_key string, config_value string, config_source string, "
    "dependency_job string, dependency_type string"
)
FACT_TYPES = ("READ", "WRITE", "CONFIG", "JOB_DEPENDENCY", "MODULE_REFERENCE", "TABLE_LOCATION", "ERROR")
METHODS = ("AST", "SQL_PARSE", "REGEX", "JSON_PARSE", "HEURISTIC")
FIELDS = [x.strip().split()[0] for x in EXTRACTED.split(",")]


def identity(*columns: str) -> Column:
    """A stable id of a natural key; nulls and empty texts differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def with_fact_id(facts: DataFrame) -> DataFrame:
    return facts.withColumn("fact_id", identity("fact_type", "dataset_urn", "source_file", "line_number", "config_key", "dependency_job"))
