"""Report relations over nodes, edges and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlight.operators.scoring import is_eligible


def _mean(c: str = "confidence") -> Column:
    return F.round(F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count("*"), 6)


def language(source: Column) -> Column:
    out = F.lit("Other")
    for suffix, name in (("sh", "Shell"), ("cron", "Shell"), ("hql", "Hive"), ("sql", "Hive"), ("scala", "Scala"), ("java", "Java"), ("json", "NiFi"), ("py", "PySpark")):
        out = F.when(F.lower(source).endswith(f".{suffix}"), F.lit(name)).otherwise(out)
    return out


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "High").when(confidence >= 0.6, "Medium").otherwise("Low")


def summary(measured: DataFrame) -> DataFrame:
    return measured.groupBy("migration_wave").agg(F.count("*").alias("datasets"), F.round(F.sum(F.col("priority_score").cast("decimal(18,6)")).cast("double"), 6).alias("total_score"))


def top_priorities(measured: DataFrame, n: int = 50) -> DataFrame:
    """The n best with their rank. The cut comes first, so that the window sees n rows."""
    best = measured.orderBy(F.desc("priority_score"), "urn").limit(n)
    return best.select(F.row_number().over(Window.orderBy(F.desc("priority_score"), "urn")).alias("rank"), "urn", "priority_score", "migration_wave")


def sources(edges: DataFrame) -> DataFrame:
    """Per job: distinct datasets read and written, mean confidence and its band, language."""
    used = edges.where("edge_type in ('READ', 'WRITE')").select(F.when(F.col("edge_type") == "READ", F.col("dst")).otherwise(F.col("src")).alias("job"), F.when(F.col("edge_type") == "READ", F.col("src")).otherwise(F.col("dst")).alias("dataset"), "edge_type", "confidence")
    out = used.groupBy("job").agg(F.countDistinct(F.when(F.col("edge_type") == "READ", F.col("dataset"))).alias("reads"), F.countDistinct(F.when(F.col("edge_type") == "WRITE", F.col("dataset"))).alias("writes"), _mean().alias("avg_confidence"))
    return out.select("job", "reads", "writes", "avg_confidence", band(F.col("avg_confidence")).alias("confidence_band"), language(F.col("job")).alias("language"))


def pivot_ready(nodes: DataFrame, edges: DataFrame, measured: DataFrame) -> DataFrame:
    """One flat row for each edge but DEPENDS_ON, with the dataset's metrics; datasets that reports leave out are dropped."""
    flow = edges.where("edge_type != 'DEPENDS_ON'")
    src = nodes.select(F.col("urn").alias("src"), F.col("name").alias("source_name"), F.col("node_type").alias("source_type"))
    dst = nodes.select(F.col("urn").alias("dst"), F.col("name").alias("target_name"), F.col("node_type").alias("target_type"))
    about = measured.select(F.col("urn").alias("dataset"), "priority_score", "migration_wave")
    out = flow.join(src, "src", "left").join(dst, "dst", "left").withColumn("dataset", F.when(F.col("edge_type") == "WRITE", F.col("dst")).otherwise(F.col("src")))
    out = out.join(about, "dataset", "left").where(is_eligible(F.col("dataset"), F.coalesce(F.when(F.col("edge_type") == "WRITE", F.col("target_name")).otherwise(F.col("source_name")), F.col("dataset")), wildcards=True))
    return out.select("src", "dst", "edge_type", "confidence", "source_name", "source_type", "target_name", "target_type", "priority_score", "migration_wave", band(F.col("confidence")).alias("confidence_band"))


def all_datasets(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'DATASET'").select("urn", "name", "kind").join(degrees, "urn", "left").select("urn", "name", "kind", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def all_jobs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Jobs with the numbers of their edges in the multigraph."""
    ends = edges.select(F.col("dst").alias("urn"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("urn"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    count = ends.where(F.col("urn").startswith("job://")).groupBy("urn").agg(F.sum("i").alias("edges_in"), F.sum("o").alias("edges_out"))
    return nodes.where("node_type = 'JOB'").select("urn", "name").join(count, "urn", "left").select("urn", "name", F.coalesce("edges_in", F.lit(0)).alias("edges_in"), F.coalesce("edges_out", F.lit(0)).alias("edges_out"))


def top_edges(edges: DataFrame, n: int = 1000) -> DataFrame:
    """The n most confident edges; the evidence is a tie-break too."""
    return edges.select("src", "dst", "edge_type", "confidence", "evidence").orderBy(F.desc("confidence"), "src", "dst", "edge_type", "evidence").limit(n)


def query_table(query: Column) -> Column:
    """The table of a JDBC query: a plain name, what follows FROM, what follows INTO, else the text's first 50 characters."""
    plain = F.when(query.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"), query)
    after = lambda word: F.nullif(F.regexp_extract(query, rf"(?i)\b{word}\s+([A-Za-z_][A-Za-z0-9_.]*)", 1), F.lit(""))
    return F.coalesce(plain, after("from"), after("into"), F.substring(query, 1, 50))


# Analyses over (source, dataset, edge_type, technology, confidence, migration_wave)


def per_source(used: DataFrame, n: int = 10) -> DataFrame:
    return used.groupBy("source").agg(F.count("*").alias("relationships")).orderBy(F.desc("relationships"), "source").limit(n)


def by_technology(used: DataFrame) -> DataFrame:
    return used.groupBy("technology").agg(F.count("*").alias("relationships"), _mean().alias("avg_confidence"), F.countDistinct("source").alias("sources"), F.countDistinct("dataset").alias("datasets"))


def read_write(used: DataFrame) -> DataFrame:
    out = used.groupBy("technology").pivot("edge_type", ["READ", "WRITE"]).agg(F.count(F.lit(1))).na.fill(0)
    return out.select("technology", F.col("READ").alias("reads"), F.col("WRITE").alias("writes"), F.round(F.col("READ") / F.greatest(F.col("WRITE"), F.lit(1)), 6).alias("ratio"))


def confidence_histogram(used: DataFrame) -> DataFrame:
    """Bins that hold their upper end."""
    c = F.col("confidence")
    name = F.when(c <= 0.5, "0-50%").when(c <= 0.7, "50-70%").when(c <= 0.85, "70-85%").otherwise("85-100%")
    return used.groupBy(name.alias("bin")).agg(F.count("*").alias("relationships"))


def most_referenced(used: DataFrame, n: int = 20) -> DataFrame:
    out = used.groupBy("dataset").agg(F.countDistinct("source").alias("sources"), F.count_if(F.col("edge_type") == "READ").alias("reads"), F.count_if(F.col("edge_type") == "WRITE").alias("writes"))
    return out.orderBy(F.desc("sources"), F.desc("reads"), "dataset").limit(n)


def wave_by_technology(used: DataFrame) -> DataFrame:
    out = used.groupBy("migration_wave").pivot("technology", ["Hive", "PySpark", "Scala", "Shell"]).agg(F.count(F.lit(1))).na.fill(0)
    return out.select("migration_wave", *[F.col(t).alias(t.lower()) for t in ("Hive", "PySpark", "Scala", "Shell")])


def low_confidence(used: DataFrame, below: float = 0.7, n: int = 10) -> DataFrame:
    out = used.groupBy("source").agg(_mean().alias("avg_confidence"), F.count("*").alias("relationships"))
    return out.where(F.col("avg_confidence") < below).orderBy("avg_confidence", "source").limit(n)


def executive_summary(used: DataFrame) -> DataFrame:
    share = lambda x: F.round(100 * F.count_if(x) / F.count("*"), 4)
    c = F.col("confidence")
    return used.agg(F.count("*").alias("relationships"), F.countDistinct("source").alias("sources"), F.countDistinct("dataset").alias("datasets"), share(c >= 0.8).alias("high_pct"), share((c >= 0.6) & (c < 0.8)).alias("medium_pct"), share(c < 0.6).alias("low_pct"), share(F.col("edge_type") == "READ").alias("read_pct"))
