"""Cross-site boilerplate lines, by the number of distinct sites that each line spreads over.

A line is what lies between two \\n, trimmed of space, tab and \\r; empty lines are never boilerplate. Each line hash has
a HyperLogLog sketch of its sites, filled on the map side and merged by the aggregation, so a line that a third of all
documents share costs one row per task. A line whose estimate is near the threshold (NEAR standard errors, half a site
at least) gets an exact distinct count; one that is clearly above is boilerplate without it. Every boilerplate line is
cut out, whatever its share of the document; what was nothing but boilerplate is empty then. With spare_whole, as in the
pipeline, such a document stays whole instead: it is a copy, and near dedup, which comes next, keeps one of its group.

Defined cases: a null text has no lines and stays null, an empty one has one empty line; a null site is not counted; a
null doc_id stays null; repeated rows are treated alike; each input row gives a row; an empty table gives none; extra
columns stay, but for n_lines and n_lines_removed, which without_boilerplate gives its own values (cut_texts doesn't).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.llm.common import KEY, row_key, stored, table, tidy

MIN_SITES = 10
LG_K = 12
NEAR = 4
BLANK = " \t\r"


def _lines(keyed: DataFrame) -> DataFrame:
    """owner, text_key, site, place and two hashes of each line that isn't empty."""
    split = keyed.select(*KEY, "site", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    trimmed = F.trim("line", F.lit(BLANK))
    return split.where(trimmed != "").select(*KEY, "site", "place", F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2"))


def boilerplate(keyed: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines that at least min_sites distinct sites have."""
    lines = _lines(keyed)
    sketched = lines.where("site is not null").groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    margin = max(0.5, NEAR * min_sites * 1.04 / 2 ** (LG_K / 2))
    spread = stored(sketched.where(F.col("sites") >= min_sites - margin))
    near = spread.where(F.col("sites") <= min_sites + margin).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(F.col("sites") > min_sites + margin).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def _cut(text: str | None, places: list[int] | None, spare_whole: bool) -> tuple[str | None, int, int]:
    """The text without the lines at these places, the number of its lines and of those cut."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not places:
        return text, len(lines), 0
    gone = set(places)
    if spare_whole and not any(x.strip(BLANK) for i, x in enumerate(lines) if i not in gone):
        return text, len(lines), 0
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines), len(gone)


def cut_texts(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, spare_whole: bool = False) -> DataFrame:
    """_row, a struct of docs' columns but for text; _cut, the text without boilerplate lines; _lines and _gone, the numbers of lines and of those cut."""
    rest = [f for f in docs.schema.fields if f.name != "text"]  # the text goes to Python and back once, not twice
    keyed = docs.select(*row_key(), F.col(f"`{site}`").alias("site"), "text")
    removed = _lines(keyed).join(boilerplate(keyed, min_sites), ["h1", "h2"], "left_semi").groupBy(*KEY).agg(F.collect_set("place").alias("_places"))
    own = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in rest], F.lit(True).alias("_weirlight")).alias("_row"), *row_key(), F.col("text").alias("_text"))
    joined = own.join(removed, KEY, "left").select("_row", "_text", "_places")
    kinds = "_row struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rest) + "," * bool(rest) + "`_weirlight`:boolean>, _cut string, _lines long, _gone long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_cut(t, p, spare_whole) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names=["_row", "_cut", "_lines", "_gone"])

    return joined.mapInArrow(tidy(run), kinds)


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, spare_whole: bool = False) -> DataFrame:
    """docs with text cut, and the columns n_lines and n_lines_removed in place of any that docs has."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    return cut_texts(docs, site, min_sites, spare_whole).select(*[F.col("_cut" if c == "text" else f"_row.`{c}`").alias(c) for c in own], F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_lines_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(docs).select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = rf"""
WITH lines AS (
  SELECT rid, doc_id, source, place, lines[place] AS line, trim(lines[place], chr(32) || chr(9) || chr(13)) AS bare
  FROM (SELECT rid, doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS place
        FROM (SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
spread AS (SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT rid, doc_id, place, line, bare, bare IN (SELECT bare FROM spread) AS hit FROM lines),
docs AS (
  SELECT rid, doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT hit), '') AS kept
  FROM marked GROUP BY rid, doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM docs
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
