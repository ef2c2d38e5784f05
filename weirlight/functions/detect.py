"""File types from suffix, first line and content, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirlight.functions.paths import let

#: Order breaks ties of content scores.
TYPES = ("pyspark", "scala", "hive", "shell", "java", "nifi", "json", "yaml", "xml", "properties", "conf")
SUFFIXES = {"py": "pyspark", "scala": "scala", "hql": "hive", "sql": "hive", "sh": "shell", "bash": "shell", "cron": "shell", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "properties": "properties", "conf": "conf"}
SHEBANGS = (("pyspark", r"^#!.*python"), ("shell", r"^#!.*/(ba|k|z|da)?sh( |$)"), ("shell", r"^#!.*env (ba|k|z)?sh( |$)"), ("scala", r"^#!.*scala"), ("java", r"^#!.*java"))
CONTENT = {
    "pyspark": (r"(?m)^\s*(from|import) pyspark", r"SparkSession\.builder", r"(?m)^def \w+\(", r"spark\.read"),
    "scala": (r"(?m)^\s*object \w+", r"(?m)^import org\.apache\.spark", r"\bval \w+\s*[:=]", r"def main\(args: Array\[String\]\)"),
    "hive": (r"(?i)\binsert\s+(overwrite|into)\b", r"(?i)\bcreate\s+(external\s+)?table\b", r"(?i)\bset\s+hive\.", r"(?i)\bselect\b[^;]*\bfrom\b"),
    "shell": (r"\bspark-submit\b", r"\bhdfs dfs\b|\bhadoop fs\b", r"(?m)^\s*export \w+=", r"(?m)^\s*(if \[|fi$|done$)"),
    "java": (r"(?m)^package [\w.]+;", r"\bpublic (final )?class \w+", r"(?m)^import java\.", r"public static void main"),
    "nifi": (r'"flowContents"', r'"processors"\s*:', r"org\.apache\.nifi", r'"parameterContexts"'),
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def type_by_suffix(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.nullif(suffix(path), F.lit("")))


def type_by_shebang(content: Column) -> Column:
    line = F.substring_index(content, "\n", 1)
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SHEBANGS):
        out = F.when(line.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def content_scores(content: Column) -> dict[str, Column]:
    """How many patterns of each type the first 100 lines hold."""
    head = F.substring_index(content, "\n", 100)
    return {kind: sum((head.rlike(p).cast("int") for p in patterns[1:]), head.rlike(patterns[0]).cast("int")) for kind, patterns in CONTENT.items()}


def type_by_content(content: Column) -> Column:
    """The type with the most patterns, earlier types first; null without any. Scores are worked out once, in an array."""
    kinds = F.array(*map(F.lit, CONTENT))
    return let(F.array(*content_scores(content).values()), lambda s: F.when(F.array_max(s) > 0, F.element_at(kinds, F.array_position(s, F.array_max(s)).cast("int"))))


def file_type(path: Column, content: Column) -> Column:
    """Suffix, where JSON may be a NiFi flow by its content; else first line; else content; else unknown. Contents are looked through only where they decide."""
    own = F.struct(type_by_suffix(path).alias("suffix"), type_by_shebang(content).alias("line"))
    open_ = lambda x: (x["suffix"] == "json") | (x["suffix"].isNull() & x["line"].isNull())
    both = let(own, lambda x: F.struct(x["suffix"].alias("suffix"), x["line"].alias("line"), F.when(open_(x), type_by_content(content)).alias("content")))
    return let(both, lambda x: F.when((x["suffix"] == "json") & (x["content"] == "nifi"), F.lit("nifi")).otherwise(F.coalesce(x["suffix"], x["line"], x["content"], F.lit("unknown"))))
