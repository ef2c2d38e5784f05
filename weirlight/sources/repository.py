"""A source repository as a relation of typed text files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.functions.detect import file_type
from weirlight.sources.storage import stored

SKIPPED_SUFFIXES = ("pyc", "pyo", "class", "jar", "so", "dll", "exe", "zip", "gz", "tar", "png", "jpg", "jpeg", "gif", "pdf", "ico", "parquet", "orc", "avro", "lock", "log")
SKIPPED_GLOBS = tuple(f"**/{folder}/**" for folder in (".git", "__pycache__", "node_modules", "target", ".venv", ".idea"))


def glob_pattern(glob: str) -> str:
    """A regular expression, for Java and Python alike, of a glob over relative paths; ** reaches over folders, also over none."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[":
            end = glob.find("]", i)
            out, i = (out + re.sub(r"^\[!", "[^", glob[i : end + 1]), end + 1) if end > 0 else (out + r"\[", i + 1)
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"




def is_ignored(relative: Column, globs: tuple[str, ...] = SKIPPED_GLOBS, suffixes: tuple[str, ...] = SKIPPED_SUFFIXES) -> Column:
    out = F.lower(F.regexp_extract(relative, r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes)
    for g in globs:
        out = out | relative.rlike(glob_pattern(g))
    return out


def is_binary(content: Column) -> Column:
    """A NUL byte, or bytes that are no UTF-8, among the first 8192; a character cut at that end is forgiven."""
    head = F.substring(content, 1, 8192)
    nul = F.hex(head).rlike("^(..)*00")
    whole = F.call_function("is_valid_utf8", head)
    for cut in (1, 2, 3):
        whole = whole | ((F.length(content) > 8192) & F.call_function("is_valid_utf8", F.substring(content, 1, 8192 - cut)))
    return nul | ~whole


def crawl(spark: SparkSession, root: str, globs: tuple[str, ...] = SKIPPED_GLOBS, suffixes: tuple[str, ...] = SKIPPED_SUFFIXES) -> DataFrame:
    """path, relative_path, file_type, size_bytes, content of every text file of a known type under root. A missing root raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)) + "/", "")
    files = files.withColumn("relative_path", relative).where(~is_ignored(F.col("relative_path"), globs, suffixes)).where(~is_binary(F.col("content")))
    text = files.withColumn("content", F.col("content").cast("string"))
    typed = text.select("path", "relative_path", file_type(F.col("relative_path"), F.col("content")).alias("file_type"), F.col("length").alias("size_bytes"), "content")
    return typed.where(F.col("file_type") != "unknown")


def of_type(files: DataFrame, kind: str) -> DataFrame:
    return files.where(F.col("file_type") == kind)


def by_type(files: DataFrame) -> DataFrame:
    """Number of files, size in MB and least and greatest path of each type; no list of all paths is made."""
    return files.groupBy("file_type").agg(F.count("*").alias("files"), F.round(F.sum("size_bytes") / 1048576, 6).alias("mb"), F.min("relative_path").alias("first_path"), F.max("relative_path").alias("last_path"))


def listed(files: DataFrame) -> DataFrame:
    """The files of each type, as rows in the order of type and path rather than as lists, so that no type is gathered whole.

    The rows are written before they are sorted: a sort reads its input twice, first for a sample, and would look through all contents again.
    """
    return stored(files.select("file_type", "relative_path")).orderBy("file_type", "relative_path")


def statistics(files: DataFrame) -> DataFrame:
    """One row for each type and one, with type null, for all."""
    return files.rollup("file_type").agg(F.count("*").alias("files"), F.round(F.sum("size_bytes") / 1048576, 6).alias("mb"))
