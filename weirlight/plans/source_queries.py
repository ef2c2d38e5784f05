"""Queries of sources, rules, settings and sinks: what is written to the shared folder and read again."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.operators import facts as fx
from weirlight.operators import rules
from weirlight.plans.bridge import table
from weirlight.plans.lineage_queries import _graph, _measured, table_files
from weirlight.plans.registry import query
from weirlight.sources import repository, settings, sinks
from weirlight.sources.storage import shared_dir

GRAPH_SQL = "WITH {0} SELECT urn, name, node_type, fact_count FROM nodes"


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _local(spark: SparkSession, what: str) -> Path:
    """A place of the shared folder as a path, for what the driver writes or reads as one small file. Where the folder isn't mounted there is none."""
    at = _place(spark, what).removeprefix("file://")
    if "://" in at:
        raise ValueError(f"{at} isn't mounted; settings and rules are read from files of the driver")
    Path(at).mkdir(parents=True)
    return Path(at)


@query(
    """SELECT n_nationkey AS nation, CASE n_nationkey % 3 WHEN 0 THEN 'hive' WHEN 1 THEN 'shell' ELSE 'nifi' END AS file_type, octet_length(encode(content || chr(10))) AS size_bytes
FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'INSERT INTO t SELECT * FROM ' || n_name WHEN 1 THEN 'hdfs dfs -ls /' || n_name ELSE '{"flowContents": {"name": "' || n_name || '"}}' END AS content, n_nationkey AS k FROM nation WHERE n_nationkey % 5 <> 4)"""
)
def crawl_files(spark, d):
    """Nations as files of a repository, one for each in a folder of its own; a fifth lie in folders that are skipped, and some hold what is of no known type."""
    k = F.col("n_nationkey") % 3
    content = F.when(k == 0, F.concat(F.lit("INSERT INTO t SELECT * FROM "), "n_name")).when(k == 1, F.concat(F.lit("hdfs dfs -ls /"), "n_name")).otherwise(F.concat(F.lit('{"flowContents": {"name": "'), "n_name", F.lit('"}}')))
    at = _place(spark, "repository")
    rows = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 4, "target").otherwise("src").alias("folder"), content.alias("content"))
    rows.repartition("n_nationkey").write.partitionBy("folder", "n_nationkey").text(at)
    table(spark, d, "region").select("r_name").coalesce(1).write.text(f"{at}/folder=plain")
    found = repository.crawl(spark, at, (*repository.SKIPPED_GLOBS, "**/folder=target/**"))
    return found.select(F.regexp_extract("relative_path", r"n_nationkey=(\d+)/", 1).cast("int").alias("nation"), "file_type", F.col("size_bytes").cast("long").alias("size_bytes"))


@query("SELECT 'CONFIG' AS fact_type, 'f' || c_custkey AS source_file, CAST(c_nationkey AS INTEGER) AS line_number, c_name AS config_key, c_mktsegment AS config_value, c_custkey % 2 = 0 AS has_placeholders FROM customer")
def facts_as_json(spark, d):
    """Facts written as JSON lines and loaded with all columns of their kinds."""
    rows = table(spark, d, "customer").select(F.lit("CONFIG").alias("fact_type"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("source_file"), F.col("c_nationkey").alias("line_number"), F.lit(0.9).alias("confidence"), F.col("c_name").alias("config_key"), F.col("c_mktsegment").alias("config_value"), (F.col("c_custkey") % 2 == 0).alias("has_placeholders"))
    at = _place(spark, "facts")
    fx.save_json(rows, at)
    return fx.load_json(spark, at).select("fact_type", "source_file", "line_number", "config_key", "config_value", "has_placeholders")


def _written(spark: SparkSession, d: str, kind: str) -> DataFrame:
    _, nodes, edges = _graph(spark, d)
    own = (nodes.select("urn", "name", "node_type", "fact_count"), edges.select("src", "dst", "edge_type", "confidence", "evidence"), _measured(spark, d)[2])
    at = _place(spark, kind)
    if kind == "parquet":
        sinks.write_parquet(own[0], at, "node_type")
        return spark.read.parquet(at)
    if kind == "csv":
        sinks.write_csv(*own, at)
        return spark.read.csv(f"{at}/nodes", header=True, schema=own[0].schema, escape='"')
    if kind == "sheets":
        sinks.write_sheets({"nodes": own[0]}, at)
        return spark.read.csv(f"{at}/nodes", header=True, schema=own[0].schema, escape='"')
    sinks.write_json(*own, at)
    return spark.read.schema(own[0].schema).json(f"{at}/nodes")


def _register_sinks() -> None:
    from weirlight.plans import bridge

    for kind in ("parquet", "csv", "json", "sheets"):

        def sink(spark, d, kind=kind):
            return _written(spark, d, kind).select("urn", "name", "node_type", "fact_count")

        sink.__name__ = f"sink_{kind}"
        query(GRAPH_SQL.format(bridge.GRAPH))(sink)


_register_sinks()


@query("SELECT n_name AS cell FROM nation WHERE n_nationkey < 10")
def sink_html(spark, d):
    """Names of the ten best datasets, read from the cells of the page."""
    best = table(spark, d, "nation").select(F.col("n_name").alias("urn"), (-F.col("n_nationkey")).cast("double").alias("priority_score"), F.lit(1).alias("downstream_reach"), F.lit(1).alias("migration_wave"))
    numbers = spark.createDataFrame([("node", None, 3)], "kind string, type string, number long")
    page = spark.createDataFrame([(sinks.html_page(numbers, best),)], "html string")
    return page.select(F.explode(F.regexp_extract_all("html", F.lit("<td>([A-Z_]+[0-9]+)</td>"), F.lit(1))).alias("cell"))


@query("SELECT 'count' AS what, CAST(25 AS BIGINT) AS number UNION ALL SELECT 'sum', CAST(300 AS BIGINT)")
def sink_json_document(spark, d):
    """One document with three relations, read again by the driver."""
    import json

    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    at = _local(spark, "document") / "all.json"
    sinks.write_json_document(rows, rows.limit(0), rows.limit(0), str(at))
    got = json.loads(at.read_text())
    return spark.createDataFrame([("count", got["metadata"]["nodes"]), ("sum", sum(x["k"] for x in got["nodes"]))], "what string, number long")


@query("""SELECT 'page_' || page_id || '.sh' AS path, 'own' AS rule_id, 'READ' AS fact_type, regexp_extract(link, '^[^ ]*') AS dataset_urn FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages)""")
def rules_from_file(spark, d):
    """A rule of a YAML file, compiled without regard to case, matched and made into facts."""
    at = _local(spark, "rules") / "rules.yaml"
    at.write_text("rules:\n  - rule_id: own\n    applies_to: [shell]\n    pattern: 'HDFS DFS -GET (?P<place>[^ \\n]+)'\n    action: READ_HDFS_PATH\n    confidence: 0.9\n    case_sensitive: false\n")
    found = rules.matches(table_files(spark, d), rules.load_rules(spark, str(at)))
    facts = rules.to_facts(found.withColumn("line", F.col("line")))
    return facts.select(F.col("source_file").alias("path"), F.lit("own").alias("rule_id"), "fact_type", "dataset_urn")


@query("SELECT * FROM (VALUES ('as_of', '2026-03-05'), ('min_confidence', '0.5'), ('ignore_suffixes', 'bak,old'), ('environment', 'x=1')) AS v(name, value)")
def settings_discovered(spark, d):
    """The first standard place that holds settings wins over the later ones."""
    at = _local(spark, "settings")
    (at / "config").mkdir()
    (at / ".weirlight.yaml").write_text("min_confidence: 0.9\n")
    (at / "config/weirlight.yaml").write_text("as_of: '2026-03-05'\nmin_confidence: 0.5\nignore_suffixes: [bak, old]\nenvironment: {x: 1}\n")
    got = settings.load_settings(base=str(at))
    return spark.createDataFrame([("as_of", got.as_of), ("min_confidence", str(got.min_confidence)), ("ignore_suffixes", ",".join(got.ignore_suffixes)), ("environment", ",".join(f"{k}={v}" for k, v in got.environment.items()))], "name string, value string")


@query("SELECT 'nodes' AS sheet, CAST(n_nationkey AS VARCHAR) AS first, n_name AS second FROM nation UNION ALL SELECT 'regions & more', r_name, NULL FROM region")
def sink_workbook(spark, d):
    """Cells of a workbook with two sheets, read again by the driver."""
    import zipfile
    from xml.etree import ElementTree

    at = _local(spark, "workbook") / "report.xlsx"
    sinks.write_workbook({"nodes": table(spark, d, "nation").select("n_nationkey", "n_name"), "regions & more": table(spark, d, "region").select("r_name")}, str(at))
    mark, rows = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", []
    with zipfile.ZipFile(at) as book:
        names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{mark}sheet")]
        for i, name in enumerate(names, 1):
            for row in list(ElementTree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{mark}row"))[1:]:
                cells = ["".join(c.itertext()) for c in row] + [None]
                rows.append((name, cells[0], cells[1]))
    return spark.createDataFrame(rows, "sheet string, first string, second string")


@query(
    """SELECT 'case/' || s_suppkey AS source_file, 'etl' || s_suppkey || '.py' AS main, 'com.x.A' || s_nationkey AS class, 'a b' AS first, 'z=1' AS second, 'my job' AS name, 'yarn' AS master, '["--d","2 3","x' || s_suppkey || '"]' AS args FROM supplier"""
)
def submit_parameters(spark, d):
    """Main application, class, configuration, options and arguments of spark-submit."""
    from weirlight.operators.extract import extract_facts

    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    line = F.concat(F.lit('spark-submit --master yarn --name="my job" --conf "spark.x=a b" --conf spark.y=z=1 --py-files lib.py,b.zip \\\n  --class com.x.A'), nation, F.lit(" etl"), key, F.lit('.py --d "2 3" x'), key, F.lit(" | tee log\n"))
    files = table(spark, d, "supplier").select(F.concat(F.lit("case/"), key).alias("relative_path"), F.lit("shell").alias("file_type"), line.alias("content"))
    own = lambda at: F.get_json_object("params", at)
    return extract_facts(files).select("source_file", F.col("dependency_job").alias("main"), own("$.class").alias("class"), own("$.configs['spark.x']").alias("first"), own("$.configs['spark.y']").alias("second"), own("$.options.name").alias("name"), own("$.options.master").alias("master"), own("$.args").alias("args"))


@query(
    """WITH k AS (SELECT n_nationkey AS k, (SELECT count(*) FROM nation) AS n FROM nation),
sets AS (
  SELECT 'hdfs:///data/raw/in_' || k AS urn, 0 AS fan_in, 2 AS fan_out, 2 * (n - k) AS downstream_reach, 0 AS write_job_count, 0.5 AS avg_confidence FROM k
  UNION ALL SELECT 'hdfs:///data/gold/out_' || k, CASE WHEN k = 0 THEN 2 ELSE 3 END, CASE WHEN k = n - 1 THEN 0 ELSE 2 END, 2 * (n - 1 - k), 1, 0.75 FROM k),
scored AS (SELECT *, round(CAST((downstream_reach * 3 + fan_out * 2 + write_job_count) * avg_confidence AS DOUBLE), 6) AS priority_score FROM sets)
SELECT urn, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out, CAST(downstream_reach AS BIGINT) AS downstream_reach, CAST(write_job_count AS BIGINT) AS write_job_count, CAST(avg_confidence AS DOUBLE) AS avg_confidence, priority_score,
       CASE WHEN priority_score > 50 AND avg_confidence > 0.7 THEN 1 WHEN priority_score > 20 OR avg_confidence > 0.6 THEN 2 ELSE 3 END AS migration_wave FROM scored"""
)
def scan_repository(spark, d):
    """The whole way from files to metrics: each nation is a job that reads a file of its own and what the job before it has written."""
    from weirlight.plans.scan import scan

    k = F.col("n_nationkey")
    own = F.concat(F.lit('from pyspark.sql import SparkSession\nBASE = "/data"\nspark.read.parquet(f"{BASE}/raw/in_'), k.cast("string"), F.lit('")'))
    before = F.when(k == 0, "").otherwise(F.concat(F.lit('.union(spark.read.parquet(f"{BASE}/gold/out_'), (k - 1).cast("string"), F.lit('"))')))
    text = F.concat(own, before, F.lit('.write.parquet("/data/gold/out_'), k.cast("string"), F.lit('")'))
    at = _place(spark, "repository")
    table(spark, d, "nation").select(F.concat(F.lit("job_"), k.cast("string")).alias("folder"), text.alias("value")).repartition("folder").write.partitionBy("folder").text(at)
    return scan(spark, at).metrics.drop("name", "is_shell_only")
