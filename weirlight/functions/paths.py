"""Canonical paths and names of datasets, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HDFS_MARKERS = ("/user/", "/data/", "/warehouse/", "/hive/", "/apps/", "/raw/")
TEMPORARY = ("/tmp/", "/temp/", "/staging/", "_temp", "_tmp", ".tmp", "/scratch/", "_temporary")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once; without it an expression that uses a part often grows with each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _folded(path: Column) -> Column:
    """Path with . and .. worked out; above the root there is nothing."""
    absolute = path.startswith("/")

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when((x == "") | (x == ".") | ((x == "..") & absolute & (F.size(acc) == 0)), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.concat_ws("/", parts))


def canonical_path(urn: Column) -> Column:
    """Slashes collapsed, . and .. worked out, no slash at the end; scheme, authority, query and fragment stay. An absolute path with a marker of the cluster's file system becomes hdfs://. Names of jdbc:, stream: and user@host: kind stay as they are."""
    head = F.regexp_extract(urn, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)

    def with_head(h: Column) -> Column:
        rest = F.substring(urn, F.length(h) + 1, F.length(urn))
        return let(
            F.struct(_folded(F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), "/{2,}", "/")).alias("path"), F.regexp_extract(rest, r"([?#].*)$", 1).alias("tail")),
            lambda p: F.concat(F.when((h == "") & F.concat(p["path"], F.lit("/")).rlike("|".join(HDFS_MARKERS)) & p["path"].startswith("/"), F.lit("hdfs://")).otherwise(h), p["path"], p["tail"]),
        )

    plain = urn.rlike(r"^(jdbc:|stream:|[\w.-]+@)") | (urn.contains(":") & ~urn.rlike(r"^[a-z][a-z0-9+.-]*://"))
    return F.when(plain, urn).otherwise(let(head, with_head))


def under(base: Column, path: Column) -> Column:
    """A relative path below its base folder."""
    return F.when(path.rlike(r"^(/|[a-z][a-z0-9+.-]*:)"), path).otherwise(F.concat_ws("/", F.regexp_replace(base, "/+$", ""), path))


def table_name(name: Column, database: str = "default") -> Column:
    """Without quotes, lower case, with a database."""
    bare = F.lower(F.trim(F.regexp_replace(name, "[`\"']", "")))
    return F.when(bare.contains("."), bare).otherwise(F.concat(F.lit(f"{database}."), bare))


def is_temporary(urn: Column) -> Column:
    low = F.lower(urn)
    out = low.contains(TEMPORARY[0])
    for t in TEMPORARY[1:]:
        out = out | low.contains(t)
    return out


def dataset_name(urn: Column) -> Column:
    """What follows #; else the last part of a path; a table's full name."""
    bare = F.regexp_replace(urn, r"^[a-z][a-z0-9+.-]*:/*", "")
    return (
        F.when(urn.contains("#"), F.element_at(F.split(urn, "#"), -1))
        .when(urn.rlike("^(hive|jdbc|kafka):/*[^/]+$"), bare)
        .otherwise(F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(bare, "/+$", ""), "/"), -1), F.lit("")), bare))
    )


def looks_like_variable(name: Column) -> Column:
    """A bare identifier rather than a path, file or schema.table: camelCase, a suffix of variables, or short without underscore."""
    exempt = name.rlike(r"[/.:#]")
    camel = name.rlike(r"^[a-z]+[A-Z]\w*$")
    ending = name.rlike(r"(?i)(path|dir|file|table|topic|url|df|name)$") & (F.length(name) < 20)
    short = (F.length(name) < 8) & ~name.contains("_")
    return ~exempt & (camel | ending | short)
