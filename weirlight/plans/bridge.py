"""The driver's tables seen as lineage relations, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS = 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of change of the files that facts reads."""
    out = []
    for name in ("nation", "customer", "supplier", "orders", "lineitem"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(out)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item: its order's job reads the supplier's nation and writes the customer's nation.

    Customers and suppliers are joined by key and left to the planner; nations are 25 rows by definition of the table.
    """
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    name = lambda key, alias: nation.select(F.col("n_nationkey").alias(key), F.regexp_replace(F.lower("n_name"), " ", "_").alias(alias))
    buyers = t("customer").select("c_custkey", "c_nationkey").join(name("c_nationkey", "buyer"), "c_nationkey").select("c_custkey", "buyer")
    sellers = t("supplier").select("s_suppkey", "s_nationkey").join(name("s_nationkey", "seller"), "s_nationkey").select("s_suppkey", "seller")
    orders = t("orders").select("o_orderkey", "o_custkey")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    job = F.col("o_orderkey") % JOBS
    folder = F.element_at(F.array(*map(F.lit, ("etl", "shell", "hive", "scala"))), (job % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, ("py", "sh", "hql", "scala"))), (job % 4 + 1).cast("int"))
    source = F.concat(folder, F.lit("/job_"), job.cast("string"), F.lit("."), suffix)
    side = F.explode(F.array(F.struct(F.lit("READ").alias("fact_type"), F.concat(F.lit("hive://raw."), "seller").alias("dataset_urn")), F.struct(F.lit("WRITE").alias("fact_type"), F.concat(F.lit("hive://mart."), "buyer").alias("dataset_urn")))).alias("side")
    confidence = (F.col("l_discount").cast("decimal(9,6)") * F.lit(4).cast("decimal(2,0)") + F.lit("0.45").cast("decimal(9,6)")).cast("double")
    rows = rows.select(source.alias("source_file"), F.col("l_linenumber").cast("int").alias("line_number"), F.round(confidence, 6).alias("confidence"), F.when(F.col("l_returnflag") == "R", "REGEX").otherwise("AST").alias("extraction_method"), (F.col("l_linestatus") == "O").alias("has_placeholders"), side)
    return rows.select("side.fact_type", "source_file", "line_number", "confidence", "side.dataset_urn", F.lit("hive").alias("dataset_type"), "extraction_method", "has_placeholders", F.lit(False).alias("is_ambiguous"), F.lit("").alias("evidence"))


FACTS = f"""
raw_facts AS (
  SELECT ['etl','shell','hive','scala'][job % 4 + 1] || '/job_' || job || '.' || ['py','sh','hql','scala'][job % 4 + 1] AS source_file,
         line_number, confidence, extraction_method, has_placeholders, seller, buyer
  FROM (SELECT o_orderkey % {JOBS} AS job, CAST(l_linenumber AS INTEGER) AS line_number,
               round(CAST(CAST(l_discount AS DECIMAL(9,6)) * 4 + CAST(0.45 AS DECIMAL(9,6)) AS DOUBLE), 6) AS confidence,
               CASE WHEN l_returnflag = 'R' THEN 'REGEX' ELSE 'AST' END AS extraction_method, l_linestatus = 'O' AS has_placeholders,
               replace(lower(sn.n_name), ' ', '_') AS seller, replace(lower(cn.n_name), ' ', '_') AS buyer
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey)),
facts AS (
  SELECT 'READ' AS fact_type, source_file, line_number, confidence, 'hive://raw.' || seller AS dataset_urn, 'hive' AS dataset_type, extraction_method, has_placeholders, false AS is_ambiguous, '' AS evidence FROM raw_facts
  UNION ALL SELECT 'WRITE', source_file, line_number, confidence, 'hive://mart.' || buyer, 'hive', extraction_method, has_placeholders, false, '' FROM raw_facts),
best AS (
  SELECT fact_type, dataset_urn, source_file, line_number, max(confidence) AS confidence FROM facts GROUP BY ALL)"""

GRAPH = (
    FACTS
    + """,
dataset_nodes AS (SELECT 'DATASET' AS node_type, dataset_urn AS urn, replace(dataset_urn, 'hive://', '') AS name, 'hive' AS kind, count(*) AS fact_count FROM best GROUP BY dataset_urn),
job_nodes AS (SELECT 'JOB' AS node_type, 'job://' || source_file AS urn, string_split(source_file, '/')[-1] AS name, 'job' AS kind, count(*) AS fact_count FROM best GROUP BY source_file),
module_nodes AS (SELECT 'MODULE' AS node_type, 'module://' || string_split(source_file, '/')[1] AS urn, string_split(source_file, '/')[1] AS name, 'module' AS kind, count(*) AS fact_count FROM best GROUP BY string_split(source_file, '/')[1]),
nodes AS (SELECT * FROM dataset_nodes UNION ALL SELECT * FROM job_nodes UNION ALL SELECT * FROM module_nodes),
direct AS (
  SELECT CASE WHEN fact_type = 'READ' THEN dataset_urn ELSE 'job://' || source_file END AS src, CASE WHEN fact_type = 'READ' THEN 'job://' || source_file ELSE dataset_urn END AS dst,
         fact_type AS edge_type, confidence, '' AS evidence FROM best),
produced AS (
  SELECT r.src, w.dst, 'PRODUCES' AS edge_type, least(r.c, w.c) AS confidence, 'via ' || r.job AS evidence
  FROM (SELECT dst AS job, src, max(confidence) AS c FROM direct WHERE edge_type = 'READ' GROUP BY ALL) r
  JOIN (SELECT src AS job, dst, max(confidence) AS c FROM direct WHERE edge_type = 'WRITE' GROUP BY ALL) w ON r.job = w.job),
edges AS (SELECT * FROM direct UNION ALL SELECT * FROM produced),
links AS (SELECT DISTINCT src, dst FROM edges)"""
)

#: The bridge's graph leads from raw datasets over jobs to mart datasets, and no further: reach needs two steps at most.
METRICS = (
    GRAPH
    + """,
pairs AS (SELECT src, dst FROM links UNION SELECT a.src, b.dst FROM links a JOIN links b ON a.dst = b.src),
metrics AS (
  SELECT n.urn, n.name, CAST(coalesce(i.k, 0) AS BIGINT) AS fan_in, CAST(coalesce(o.k, 0) AS BIGINT) AS fan_out, CAST(coalesce(r.k, 0) AS BIGINT) AS downstream_reach, CAST(coalesce(w.k, 0) AS BIGINT) AS write_job_count,
         coalesce(c.a, 0.5) AS avg_confidence, coalesce(w.shell, false) AS is_shell_only
  FROM dataset_nodes n
  LEFT JOIN (SELECT dst, count(*) AS k FROM links GROUP BY dst) i ON i.dst = n.urn LEFT JOIN (SELECT src, count(*) AS k FROM links GROUP BY src) o ON o.src = n.urn
  LEFT JOIN (SELECT src, count(*) AS k FROM pairs WHERE src <> dst GROUP BY src) r ON r.src = n.urn
  LEFT JOIN (SELECT dst, count(*) AS k, bool_and(lower(src) LIKE '%shell%') AS shell FROM links WHERE src LIKE 'job://%' GROUP BY dst) w ON w.dst = n.urn
  LEFT JOIN (SELECT dst, round(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS a FROM edges GROUP BY dst) c ON c.dst = n.urn),
scored AS (SELECT *, round((downstream_reach * 3 + fan_out * 2 + write_job_count - CASE WHEN is_shell_only THEN 2 ELSE 0 END) * avg_confidence, 6) AS priority_score FROM metrics),
measured AS (
  SELECT *, CAST(CASE WHEN is_shell_only THEN 3 WHEN priority_score > 50 AND avg_confidence > 0.7 THEN 1 WHEN priority_score > 20 OR avg_confidence > 0.6 THEN 2 ELSE 3 END AS INTEGER) AS migration_wave FROM scored)"""
)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order -> the same customer's next order."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("src"), following.alias("dst")).where(F.col("dst").isNotNull())


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations and documents as the contents of files."""
    talk = table(spark, sf_dir, "conversations").select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".py", ".sh", "", ".hql", ".json", ".bin"))), (F.col("doc_id") % 6 + 1).cast("int"))).alias("path"), F.col("text").alias("content"))
    return talk.unionByName(docs)


SOURCES = """
sources AS (
  SELECT 'talk/' || conv_id || '_' || turn || '.txt' AS path, text AS content FROM conversations
  UNION ALL SELECT 'docs/' || doc_id || ['.py','.sh','','.hql','.json','.bin'][doc_id % 6 + 1], text FROM documents)"""


def used(edges: DataFrame, measured: DataFrame) -> DataFrame:
    """source, dataset, edge_type, technology, confidence, migration_wave of READ and WRITE edges."""
    from weirlight.operators.reports import language

    flat = edges.where("edge_type in ('READ', 'WRITE')")
    read = F.col("edge_type") == "READ"
    flat = flat.select(F.when(read, F.col("dst")).otherwise(F.col("src")).alias("source"), F.when(read, F.col("src")).otherwise(F.col("dst")).alias("dataset"), "edge_type", "confidence")
    return flat.join(measured.select(F.col("urn").alias("dataset"), "migration_wave"), "dataset").withColumn("technology", language(F.col("source")))


USED = (
    METRICS
    + """,
used AS (
  SELECT source, dataset, edge_type, confidence, migration_wave, CASE WHEN source LIKE '%.py' THEN 'PySpark' WHEN source LIKE '%.sh' THEN 'Shell' WHEN source LIKE '%.hql' THEN 'Hive' WHEN source LIKE '%.scala' THEN 'Scala' ELSE 'Other' END AS technology
  FROM (SELECT CASE WHEN edge_type = 'READ' THEN dst ELSE src END AS source, CASE WHEN edge_type = 'READ' THEN src ELSE dst END AS dataset, edge_type, confidence FROM direct) JOIN measured ON urn = dataset)"""
)
