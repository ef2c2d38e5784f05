"""Variables in texts: lookup, substitution to a fixed point, and what stays open."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.sources.storage import stored

PASSES = 10
#: Symbols that may go with the tasks.
SMALL = 10_000
DEFAULTED = re.compile(r"\$\{(\w+):-([^${}]*)\}")
FORMS = (re.compile(r"\$\{(?:hivevar:|hiveconf:|env:|system:)?([\w.]+)\}"), re.compile(r"(?<!\$)\{([A-Za-z_][\w.]*)\}"), re.compile(r"\$([A-Za-z_]\w*)"))
#: The same forms for Spark and SQL; no look-behind.
OPEN = r"\$\{[^}]+\}|\{[A-Za-z_][A-Za-z0-9_.]*\}|\$[A-Za-z_][A-Za-z0-9_]*"


def resolve_text(text: str | None, symbols: dict[str, str]) -> tuple[str | None, bool]:
    """The text after at most PASSES passes, and whether nothing is open. Unknown variables stay as they are; a default is taken only where the variable is unknown."""
    if text is None:
        return None, True
    for _ in range(PASSES):
        before = text
        text = DEFAULTED.sub(lambda m: symbols.get(m[1]) or m[2], text)
        for form in FORMS:
            text = form.sub(lambda m: symbols.get(m[1]) or m[0], text)
        if text == before:
            break
    return text, not is_open(text)


def is_open(text: str) -> bool:
    return any(f.search(text) for f in FORMS) or bool(DEFAULTED.search(text))


def variables(text: Column) -> Column:
    """Distinct names of the variables that are open in a text."""
    found = F.regexp_extract_all(text, F.lit(OPEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\$?\{?", ""), r"(:-.*)?\}?$", "")))


def has_open(text: Column) -> Column:
    return F.coalesce(text.rlike(OPEN), F.lit(False))


def symbol_table(facts: DataFrame) -> DataFrame:
    """name, value, source_file of CONFIG facts; within a file the last line wins."""
    config = facts.where((F.col("fact_type") == "CONFIG") & F.col("config_key").isNotNull())
    return config.groupBy(F.col("config_key").alias("name"), "source_file").agg(F.max_by("config_value", F.struct("line_number", "config_value")).alias("value"))


def global_symbols(symbols: DataFrame) -> DataFrame:
    """One value for each name: that of the last file."""
    return symbols.groupBy("name").agg(F.max_by("value", F.struct("source_file", "value")).alias("value"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, value; the right side wins."""
    both = left.select("name", "value", F.lit(0).alias("side")).unionByName(right.select("name", "value", F.lit(1).alias("side")))
    return both.groupBy("name").agg(F.max_by("value", "side").alias("value"))


def looked_up(names: DataFrame, *layers: DataFrame) -> DataFrame:
    """names with value: that of the first layer (name, value) which has a non-empty one."""
    out, values = names, []
    for i, layer in enumerate(layers):
        out = out.join(layer.select("name", F.col("value").alias(f"_{i}")), "name", "left")
        values.append(F.nullif(F.col(f"_{i}"), F.lit("")))
    return out.select(*names.columns, F.coalesce(*values).alias("value"))


def resolved(facts: DataFrame, symbols: DataFrame, column: str = "dataset_urn") -> DataFrame:
    """facts with resolved_path and is_resolved. A variable is looked up in its own file first, then among all.

    Symbols are joined to the facts that name them, so no table of symbols is shipped whole unless it has SMALL rows at most.
    """
    few = symbols.select("source_file", "name", "value").limit(SMALL + 1).collect()
    if len(few) <= SMALL:
        return _resolved_small(facts, few, column)
    own = facts.withColumn("_row", F.sha2(F.concat_ws("\x1f", F.coalesce(column, F.lit("")), "source_file"), 256))
    open_ = own.where(has_open(F.col(column))).select("_row", "source_file", column).distinct()
    locals_ = symbols.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("own"))
    every = global_symbols(symbols)
    # closure of the names: values may name further variables; a name has the file's own value or, failing that, the global one.
    # A pass of resolve_text goes one level deeper with each of its forms, so names further away are never asked for.
    near = symbols.where(F.coalesce("value", F.lit("")) != "").select("source_file", "name", F.col("value").alias("_near"))
    closed = fresh = stored(open_.select("_row", "source_file", F.explode(variables(F.col(column))).alias("name")).distinct())
    for _ in range(PASSES * (1 + len(FORMS))):
        valued = fresh.join(near, ["source_file", "name"], "left").join(every, "name", "left").select("_row", "source_file", F.coalesce("_near", "value").alias("value"))
        more = valued.where(has_open(F.col("value"))).select("_row", "source_file", F.explode(variables(F.col("value"))).alias("name")).distinct()
        fresh = stored(more.join(closed, ["_row", "source_file", "name"], "left_anti"))
        if fresh.isEmpty():
            break
        closed = closed.unionByName(fresh)
    needed = closed.join(every, "name").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("others"))
    empty = F.create_map().cast("map<string,string>")
    ready = open_.join(locals_, "source_file", "left").join(needed, "_row", "left").select("_row", F.col(column).alias("_text"), F.coalesce("own", empty).alias("own"), F.coalesce("others", empty).alias("others"))

    def run(batches):
        for b in batches:
            got = [resolve_text(t, {**dict(o or ()), **dict(w or ())}) for t, w, o in zip(b["_text"], b["own"], b["others"])]
            yield pd.DataFrame({"_row": b["_row"], "_resolved": [x[0] for x in got]})

    done = ready.mapInPandas(run, "_row string, _resolved string").distinct()
    out = own.join(done, "_row", "left").withColumn("resolved_path", F.coalesce("_resolved", column))
    return out.withColumn("is_resolved", ~has_open(F.col("resolved_path"))).drop("_row", "_resolved")


def _resolved_small(facts: DataFrame, symbols: list, column: str) -> DataFrame:
    """The same for SMALL symbols at most, which go with the tasks."""
    near: dict[str, dict[str, str]] = {}
    every: dict[str, str] = {}
    for r in sorted(symbols, key=lambda r: (r["source_file"] or "", r["value"] or "")):  # of one name the last file's value counts among all
        near.setdefault(r["source_file"], {})[r["name"]] = r["value"]
        every[r["name"]] = r["value"]

    @F.pandas_udf("string")
    def text(urn: pd.Series, file: pd.Series) -> pd.Series:
        return pd.Series([resolve_text(u, every | near.get(f, {}))[0] for u, f in zip(urn, file)])

    out = facts.withColumn("resolved_path", F.when(has_open(F.col(column)), text(column, "source_file")).otherwise(F.col(column)))
    return out.withColumn("is_resolved", ~has_open(F.col("resolved_path")))


def environment(spark: SparkSession, nested: dict) -> DataFrame:
    """name, value of a nested mapping: dotted keys, and for each leaf its bare upper-case key."""

    def walk(prefix: str, x):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(f"{prefix}.{k}" if prefix else str(k), v)
        elif x is not None:
            yield prefix, str(x)
            yield prefix.rsplit(".", 1)[-1].upper(), str(x)

    return spark.createDataFrame(sorted(dict(walk("", nested)).items()), "name string, value string")
