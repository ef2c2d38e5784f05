"""Extraction rules as a relation, and their matches over file contents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = ("READ_HDFS_PATH", "WRITE_HDFS_PATH", "READ_HIVE_TABLE", "WRITE_HIVE_TABLE", "READ_LOCAL_PATH", "WRITE_LOCAL_PATH", "JOB_INVOCATION", "CONFIG_REFERENCE")
SCHEMA = "rule_id string, applies_to array<string>, pattern string, action string, confidence double, case_sensitive boolean, multiline boolean"
_PATH, _TABLE = r"[\"'](?P<place>[^\"']+)[\"']", r"(?P<relation>[\w$`{}.:]+)"


def _rules() -> Iterator[tuple]:
    for name in ("parquet", "csv", "json", "orc"):
        yield f"py_read_{name}", ["pyspark"], rf"\bread(?:Stream)?\b(?:(?!\.\s*write)[^\n])*?\.{name}\(\s*{_PATH}", "READ_HDFS_PATH", 0.75, True, False
    yield "py_read_table", ["pyspark"], rf"\bread(?:Stream)?\s*\.\s*table\(\s*[\"'](?P<relation>[^\"']+)", "READ_HIVE_TABLE", 0.8, True, False
    for name in ("parquet", "csv"):
        yield f"py_write_{name}", ["pyspark"], rf"\bwrite\b[^\n]*?\.{name}\(\s*{_PATH}", "WRITE_HDFS_PATH", 0.75, True, False
    for name in ("saveAsTable", "insertInto"):
        yield f"spark_{name}", ["pyspark", "scala"], rf"\.{name}\(\s*[\"'](?P<relation>[^\"']+)", "WRITE_HIVE_TABLE", 0.8, True, False
    yield "scala_read_parquet", ["scala"], rf"\bread\b[^\n]*?\.parquet\(\s*{_PATH}", "READ_HDFS_PATH", 0.75, True, False
    yield "scala_read_table", ["scala"], r"\.table\(\s*\"(?P<relation>[^\"]+)", "READ_HIVE_TABLE", 0.8, True, False
    for name, pattern, action, confidence in (
        ("overwrite", rf"\binsert\s+overwrite\s+table\s+{_TABLE}", "WRITE_HIVE_TABLE", 0.9), ("into", rf"\binsert\s+into\s+(?:table\s+)?{_TABLE}", "WRITE_HIVE_TABLE", 0.9), ("ctas", rf"\bcreate\s+(?:external\s+)?table\s+(?:if\s+not\s+exists\s+)?{_TABLE}[^;]*?\bas\s+select\b", "WRITE_HIVE_TABLE", 0.9),
        ("from", rf"\bfrom\s+{_TABLE}", "READ_HIVE_TABLE", 0.85), ("join", rf"\bjoin\s+{_TABLE}", "READ_HIVE_TABLE", 0.85), ("load", rf"\bload\s+data\b[^;]*?\binto\s+table\s+{_TABLE}", "WRITE_HIVE_TABLE", 0.9), ("location", rf"\balter\s+table\s+\S+\s+set\s+location\s+{_PATH}", "WRITE_HDFS_PATH", 0.85),
    ):
        yield f"sql_{name}", ["hive"], pattern, action, confidence, False, True
    fs = r"\b(?:hdfs\s+dfs|hadoop\s+fs)\s+-"
    yield "sh_get", ["shell"], fs + r"(?:get|copyToLocal)\s+(?:-\w+\s+)*(?P<place>[^\s-]\S*)", "READ_HDFS_PATH", 0.7, True, False
    for name, verb in (("put", "(?:put|copyFromLocal)"), ("cp", "cp"), ("mv", "mv")):
        yield f"sh_{name}", ["shell"], fs + verb + r"\s+(?:-\w+\s+)*\S+\s+(?P<place>\S+)", "WRITE_HDFS_PATH", 0.7, True, False
    yield "sh_distcp", ["shell"], r"\bdistcp\s+(?:-\w+\s+(?:\d+\s+)?)*\S+\s+(?P<place>\S+)", "WRITE_HDFS_PATH", 0.75, True, False
    yield "sh_submit", ["shell"], r"\bspark-submit\b(?P<job>[^\n]*)", "JOB_INVOCATION", 0.8, True, False
    yield "sh_hive_e", ["shell"], r"\bhive\s+-e\s+[\"'](?P<job>[^\"']*)", "JOB_INVOCATION", 0.75, True, False
    yield "sh_hive_f", ["shell"], r"\bhive\s+-f\s+(?P<job>\S+)", "JOB_INVOCATION", 0.8, True, False
    yield "property", ["pyspark", "scala", "shell"], r"\$\{(?P<name>[A-Za-z][\w.]*)\}", "CONFIG_REFERENCE", 0.6, True, False
    yield "environment", ["shell", "pyspark"], r"\$(?P<name>[A-Z][A-Z0-9_]+)", "CONFIG_REFERENCE", 0.55, True, False


DEFAULT_RULES = list(_rules())


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a YAML file; an unknown action is an error."""
    import yaml

    with open(path) as f:
        rows = [(r["rule_id"], list(r["applies_to"]), r["pattern"], r["action"], float(r.get("confidence", 0.7)), bool(r.get("case_sensitive", True)), bool(r.get("multiline", False))) for r in yaml.safe_load(f)["rules"]]
    for r in rows:
        if r[3] not in ACTIONS:
            raise KeyError(f"rule {r[0]}: unknown action {r[3]}")
    return spark.createDataFrame(rows, SCHEMA)


def compiled(pattern: str, case_sensitive: bool = True, multiline: bool = False) -> re.Pattern:
    return re.compile(pattern, (0 if case_sensitive else re.I) | (re.M | re.S if multiline else 0))


def rules_by_type(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode("applies_to").alias("file_type"), "rule_id").groupBy("file_type").agg(F.count("*").alias("rules"))


MATCH = "path string, file_type string, rule_id string, action string, confidence double, match_text string, start int, end int, line int, groups map<string,string>"


#: Matches that a Python worker holds before it hands them on.
FRAME_ROWS = 4_000


def matches(files: DataFrame, rules: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """All non-overlapping matches of every rule that applies to a file's type, with offsets and named groups.

    Rules are program text, a few dozen rows; they are collected and go with the task rather than through a join.
    Matches are handed on as they are found, in the order of a file's text, so that neither a file nor a batch of files is held with all of its matches.
    """
    own: dict[str, list] = {}
    for r in rules.where(F.col("confidence") >= min_confidence).orderBy("rule_id").collect():
        for kind in r["applies_to"]:
            own.setdefault(kind, []).append((r["rule_id"], r["action"], r["confidence"], r["pattern"], r["case_sensitive"], r["multiline"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {k: [(i, a, c, compiled(p, s, m)) for i, a, c, p, s, m in rs] for k, rs in own.items()}
        frame = lambda rows: pd.DataFrame(rows, columns=[x.split()[0] for x in MATCH.split(", ")])
        hits = lambda k, i, a, c, p, content: ((m.start(), k, i, a, c, m) for m in p.finditer(content))
        for b in batches:
            rows = []
            for path, kind, content in zip(b["path"], b["file_type"], b["content"]):
                if content is None:
                    continue
                found = [hits(k, *rule, content) for k, rule in enumerate(ready.get(kind, ()))]
                line, seen = 1, 0
                for start, _, i, a, c, m in merge(*found, key=lambda x: x[:2]):
                    line, seen = line + content.count("\n", seen, start), start
                    rows.append((path, kind, i, a, c, m[0], start, m.end(), line, {k: v for k, v in m.groupdict().items() if v is not None}))
                    if len(rows) >= FRAME_ROWS:
                        yield frame(rows)
                        rows = []
            if rows:
                yield frame(rows)

    return files.select("path", "file_type", "content").mapInPandas(run, MATCH)


def to_facts(found: DataFrame) -> DataFrame:
    """READ, WRITE and JOB_DEPENDENCY facts of matches; references to configuration are no facts."""
    table, path, job = F.col("groups")["relation"], F.col("groups")["place"], F.col("groups")["job"]
    kind = F.when(F.col("action").startswith("READ"), "READ").when(F.col("action").startswith("WRITE"), "WRITE").when(F.col("action") == "JOB_INVOCATION", "JOB_DEPENDENCY")
    urn = F.when(table.isNotNull(), F.concat(F.lit("hive://"), F.lower(F.regexp_replace(table, "`", "")))).otherwise(path)
    out = found.select(
        kind.alias("fact_type"), F.col("path").alias("source_file"), F.col("line").alias("line_number"), "confidence", urn.alias("dataset_urn"),
        F.when(table.isNotNull(), "hive").when(path.isNotNull(), "hdfs").alias("dataset_type"), F.substring("match_text", 1, 200).alias("evidence"), F.lit("REGEX").alias("extraction_method"), F.coalesce(urn.rlike(r"\$|\{"), F.lit(False)).alias("has_placeholders"), F.lit(False).alias("is_ambiguous"), F.trim(job).alias("dependency_job"),
    )
    return out.where("fact_type is not null")


def as_json(rules: DataFrame) -> str:
    return json.dumps([r.asDict() for r in rules.orderBy("rule_id").collect()])
