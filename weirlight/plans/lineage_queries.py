"""Queries of the lineage operators over the bridge relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.functions import detect, paths, resolve
from weirlight.operators import facts as fx
from weirlight.operators import lineage, reports, rules, scoring
from weirlight.operators.extract import extract_facts
from weirlight.plans import bridge
from weirlight.plans.registry import query
from weirlight.sources import repository, settings
from weirlight.sources.storage import exists, stored


_KEPT: dict[tuple, tuple[DataFrame, ...]] = {}


def _once(spark: SparkSession, d: str, what: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Written tables of the graph over d, made once in a session for as long as the files of its input are the same and their own are there."""
    key = (spark.sparkContext.applicationId, d, what, bridge.stamp(spark, d))
    if key not in _KEPT or not all(exists(spark, f) for df in _KEPT[key] for f in df.inputFiles()[:1]):
        for old in [k for k in _KEPT if k[:3] == key[:3] or k[0] != key[0]]:
            del _KEPT[old]
        _KEPT[key] = make()
    return _KEPT[key]


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        found = stored(fx.without_repeats(bridge.facts(spark, d)))
        nodes = stored(lineage.nodes_of(found))
        return found, nodes, stored(lineage.edges_of(found.withColumn("dependency_job", F.lit(None).cast("string")), nodes))

    return _once(spark, d, "graph", make)


def _measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, nodes, edges = _graph(spark, d)
    return nodes, edges, _once(spark, d, "metrics", lambda: (stored(scoring.metrics(nodes, edges)),))[0]


def _used(spark: SparkSession, d: str, waves: bool = False) -> DataFrame:
    """Only waves need metrics, and with them reach."""
    _, nodes, edges = _graph(spark, d)
    return bridge.used(edges, _measured(spark, d)[2] if waves else scoring.eligible(nodes).withColumn("migration_wave", F.lit(None).cast("int")))


# facts


@query(f"WITH {bridge.FACTS} SELECT source_file, line_number, confidence, dataset_urn FROM facts WHERE fact_type = 'WRITE' AND confidence >= 0.75 AND NOT has_placeholders")
def facts_filter(spark, d):
    return fx.select_facts(bridge.facts(spark, d), "WRITE", 0.75, has_placeholders=False).select("source_file", "line_number", "confidence", "dataset_urn")


@query(f"WITH {bridge.FACTS} SELECT fact_type, line_number, confidence, dataset_urn FROM facts WHERE source_file = 'etl/job_8.py'")
def facts_lookup(spark, d):
    return fx.select_facts(bridge.facts(spark, d), source_file="etl/job_8.py").select("fact_type", "line_number", "confidence", "dataset_urn")


@query(f"WITH {bridge.FACTS} SELECT DISTINCT dataset_urn FROM facts")
def facts_distinct_datasets(spark, d):
    return fx.datasets(bridge.facts(spark, d))


@query(f"WITH {bridge.FACTS} SELECT DISTINCT source_file FROM facts")
def facts_distinct_files(spark, d):
    return fx.source_files(bridge.facts(spark, d))


@query(
    f"""WITH {bridge.FACTS} SELECT count(*) AS total, count(*) FILTER (fact_type = 'READ') AS reads, count(*) FILTER (fact_type = 'WRITE') AS writes, count(*) FILTER (fact_type = 'CONFIG') AS configs, count(*) FILTER (fact_type = 'JOB_DEPENDENCY') AS dependencies,
count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low, count(DISTINCT source_file) AS files, count(DISTINCT dataset_urn) AS datasets FROM facts"""
)
def facts_stats(spark, d):
    return fx.statistics(bridge.facts(spark, d))


@query(f"WITH {bridge.FACTS} SELECT fact_type, count(*) AS n FROM (SELECT * FROM facts UNION ALL SELECT * FROM facts WHERE confidence > 0.8) GROUP BY fact_type")
def facts_union(spark, d):
    all_ = bridge.facts(spark, d)
    return fx.union(all_, all_.where("confidence > 0.8")).groupBy("fact_type").agg(F.count("*").alias("n"))


@query(f"WITH {bridge.FACTS} SELECT fact_type, dataset_urn, source_file, line_number, confidence FROM best")
def facts_without_repeats(spark, d):
    return fx.without_repeats(bridge.facts(spark, d)).select("fact_type", "dataset_urn", "source_file", "line_number", "confidence")


# sources and detection


@query(
    f"""WITH {bridge.SOURCES} SELECT path, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'pyspark' WHEN 'sh' THEN 'shell' WHEN 'hql' THEN 'hive' WHEN 'json' THEN 'json' END AS file_type FROM sources"""
)
def detect_suffix(spark, d):
    return bridge.sources(spark, d).select("path", detect.type_by_suffix(F.col("path")).alias("file_type"))


_SHEBANG_SQL = "CASE WHEN regexp_matches(line, '^#!.*python') THEN 'pyspark' WHEN regexp_matches(line, '^#!.*/(ba|k|z|da)?sh( |$)') OR regexp_matches(line, '^#!.*env (ba|k|z)?sh( |$)') THEN 'shell' WHEN regexp_matches(line, '^#!.*scala') THEN 'scala' WHEN regexp_matches(line, '^#!.*java') THEN 'java' END"
_LINED = "(SELECT path, CASE WHEN length(path) % 3 = 0 THEN '#!/bin/bash' || chr(10) || content WHEN length(path) % 3 = 1 THEN '#!/usr/bin/env python3' || chr(10) || content ELSE content END AS content FROM sources)"


def _lined(spark, d):
    k = F.length("path") % 3
    return bridge.sources(spark, d).select("path", F.when(k == 0, F.concat(F.lit("#!/bin/bash\n"), "content")).when(k == 1, F.concat(F.lit("#!/usr/bin/env python3\n"), "content")).otherwise(F.col("content")).alias("content"))


@query(f"WITH {bridge.SOURCES} SELECT path, {_SHEBANG_SQL} AS file_type FROM (SELECT path, string_split(content, chr(10))[1] AS line FROM {_LINED})")
def detect_shebang(spark, d):
    return _lined(spark, d).select("path", detect.type_by_shebang(F.col("content")).alias("file_type"))


#: Path, content, type by content alone and by all rules, written down by hand.
SNIPPETS = (
    ("a/job", "from pyspark.sql import SparkSession\nspark = SparkSession.builder.getOrCreate()", "pyspark", "pyspark"), ("a/job.scala", "object Job {\n  val x = 1\n}", "scala", "scala"), ("q", "INSERT OVERWRITE TABLE a SELECT * FROM b", "hive", "hive"), ("q.txt", "create external table t (i int)", "hive", "hive"),
    ("run", "#!/bin/bash\nhdfs dfs -ls /", "shell", "shell"), ("run.py", "#!/bin/bash\nexport A=1", "shell", "pyspark"), ("Job", "package a.b;\nimport java.util.List;\npublic class Job { public static void main(String[] a) {} }", "java", "java"), ("flow.json", '{"flowContents": {"processors": []}}', "nifi", "nifi"),
    ("conf.json", '{"a": 1}', None, "json"), ("notes.txt", "nothing to see here", None, "unknown"), ("env", "#!/usr/bin/env python3\nprint(1)", None, "pyspark"), ("x.yml", "a: 1", None, "yaml"), ("mix", "spark-submit a.py\nhadoop fs -ls\nselect 1 from t", "shell", "shell"), ("deep", "\n" * 150 + "INSERT INTO t", None, "unknown"), ("e.conf", "", None, "conf"),
)


def _snippets(spark, d):
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in SNIPPETS]), (F.col("s_suppkey") % len(SNIPPETS) + 1).cast("int"))
    return bridge.table(spark, d, "supplier").select("s_suppkey", pick(0).alias("path"), pick(1).alias("content"))


def _snippet_sql(i: int) -> str:
    return f"SELECT s_suppkey, ([{', '.join('NULL' if x[i] is None else repr(x[i]) for x in SNIPPETS)}])[s_suppkey % {len(SNIPPETS)} + 1] AS file_type FROM supplier"


@query(_snippet_sql(2))
def detect_content(spark, d):
    return _snippets(spark, d).select("s_suppkey", detect.type_by_content(F.col("content")).alias("file_type"))


@query(_snippet_sql(3))
def detect_cascade(spark, d):
    return _snippets(spark, d).select("s_suppkey", detect.file_type(F.col("path"), F.col("content")).alias("file_type"))


def _typed(spark, d):
    rows = bridge.sources(spark, d)
    return rows.select("path", "content", F.col("path").alias("relative_path"), detect.file_type(F.col("path"), F.col("content")).alias("file_type"), F.length(F.encode("content", "UTF-8")).alias("size_bytes"))


_TYPED = f"""{bridge.SOURCES}, typed AS (
  SELECT path, octet_length(encode(content)) AS size_bytes, coalesce(x, {_SHEBANG_SQL}, 'unknown') AS file_type
  FROM (SELECT path, content, string_split(content, chr(10))[1] AS line, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'pyspark' WHEN 'sh' THEN 'shell' WHEN 'hql' THEN 'hive' WHEN 'json' THEN 'json' END AS x FROM sources))"""  # the driver's prose holds no program text


@query(f"WITH {_TYPED} SELECT path, size_bytes FROM typed WHERE file_type = 'shell'")
def crawl_by_type(spark, d):
    return repository.of_type(_typed(spark, d), "shell").select("path", "size_bytes")


@query(f"WITH {_TYPED} SELECT file_type, count(*) AS files, round(sum(size_bytes) / 1048576, 6) AS mb, min(path) AS first_path, max(path) AS last_path FROM typed GROUP BY file_type")
def files_by_type(spark, d):
    return repository.by_type(_typed(spark, d))


@query(f"WITH {_TYPED} SELECT file_type, path AS relative_path FROM typed")
def files_listed(spark, d):
    return repository.listed(_typed(spark, d))


@query(f"WITH {_TYPED} SELECT file_type, count(*) AS files, round(sum(size_bytes) / 1048576, 6) AS mb FROM typed GROUP BY ROLLUP (file_type)")
def crawl_stats(spark, d):
    return repository.statistics(_typed(spark, d))


@query(f"WITH {bridge.SOURCES} SELECT path FROM sources WHERE NOT (regexp_matches(path, '^talk/[^/]*_1\\.txt$') OR regexp_matches(path, '^(.*/)?docs/[^/]*5\\.py$') OR path LIKE '%.bin')")
def ignore_globs(spark, d):
    return bridge.sources(spark, d).where(~repository.is_ignored(F.col("path"), ("talk/*_1.txt", "**/docs/*5.py"), ("bin",))).select("path")


@query(f"WITH {bridge.SOURCES} SELECT path, path LIKE '%7.py' AS binary FROM sources")
def binary_filter(spark, d):
    body = F.encode("content", "UTF-8")
    odd = F.when(F.col("path").endswith("7.py"), F.concat(F.unhex(F.lit("00")), body)).otherwise(body)
    return bridge.sources(spark, d).select("path", repository.is_binary(odd).alias("binary"))


# rules


@query(
    """WITH links AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM pages)),
lines AS (SELECT page_id, 2 * k - 1 AS line, 'hdfs dfs -get ' || link || ' /local' AS body, 'hdfs dfs -get ' || regexp_extract(link, '^[^ ]*') AS own, 'sh_get' AS rule_id, 'READ_HDFS_PATH' AS action FROM links
          UNION ALL SELECT page_id, 2 * k, 'hdfs dfs -put /local /data' || link, 'hdfs dfs -put /local /data' || regexp_extract(link, '^[^ ]*'), 'sh_put', 'WRITE_HDFS_PATH' FROM links),
placed AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY page_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines)
SELECT 'page_' || page_id || '.sh' AS path, rule_id, action, own AS match_text, CAST(pos AS INTEGER) AS "start", CAST(pos + length(own) AS INTEGER) AS "end", CAST(line AS INTEGER) AS line FROM placed"""
)
def rules_match(spark, d):
    files = table_files(spark, d)
    return rules.matches(files, rules.default_rules(spark)).select("path", "rule_id", "action", "match_text", "start", "end", "line")


def table_files(spark, d):
    """Each page's links as a shell script that fetches them."""
    pages = bridge.table(spark, d, "pages")
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    body = F.array_join(F.transform(links, lambda x: F.concat(F.lit("hdfs dfs -get "), x, F.lit(" /local\nhdfs dfs -put /local /data"), x)), "\n")
    return pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".sh")).alias("path"), F.lit("shell").alias("file_type"), body.alias("content"))


_LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS link FROM pages WHERE html IS NOT NULL), plain AS (SELECT page_id, link FROM links WHERE NOT regexp_matches(link, '\\s'))"


@query(f"WITH {_LINKS} SELECT 'READ' AS fact_type, 'page_' || page_id || '.sh' AS source_file, link AS dataset_urn FROM plain UNION ALL SELECT 'WRITE', 'page_' || page_id || '.sh', '/data' || link FROM plain")
def rules_to_facts(spark, d):
    return rules.to_facts(rules.matches(table_files(spark, d), rules.default_rules(spark), 0.7)).select("fact_type", "source_file", "dataset_urn")


@query("SELECT * FROM (VALUES ('pyspark', CAST(11 AS BIGINT)), ('scala', 5), ('hive', 7), ('shell', 10)) AS v(file_type, rules)")
def rules_stats(spark, d):
    return rules.rules_by_type(rules.default_rules(spark))


# symbols and resolution


def _symbols(spark, d):
    nation, region = bridge.table(spark, d, "nation"), bridge.table(spark, d, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("config_key"), F.col("n_name").alias("config_value"), F.concat(F.lit("conf_"), (F.col("n_nationkey") % 2).cast("string")).alias("source_file"), F.col("n_nationkey").alias("line_number"))
    return rows.withColumn("fact_type", F.lit("CONFIG"))


@query("SELECT r_name AS name, 'conf_' || n_nationkey % 2 AS source_file, arg_max(n_name, n_nationkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def symbols_upsert(spark, d):
    return resolve.symbol_table(_symbols(spark, d))


@query("SELECT r_name AS name, arg_max(n_name, (n_nationkey % 2) * 1000 + n_nationkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def symbols_global(spark, d):
    return resolve.global_symbols(resolve.symbol_table(_symbols(spark, d)))


@query("SELECT coalesce(r.r_name, n.n_name) AS name, CASE WHEN r.r_name IS NOT NULL THEN 'region' ELSE 'nation' END AS value FROM nation n FULL JOIN region r ON n.n_name = r.r_name")
def symbols_merge(spark, d):
    left = bridge.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("value"))
    return resolve.merged(left, bridge.table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("value")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_mktsegment END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def symbols_lookup(spark, d):
    names = bridge.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("name"))
    both = bridge.table(spark, d, "customer").join(bridge.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    first = both.select(F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise("").alias("value"))
    return resolve.looked_up(names, first, both.select(F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("value"))).select("id", "value")


def _templates(spark, d):
    return bridge.table(spark, d, "customer").select("c_custkey", F.lit("READ").alias("fact_type"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("source_file"), F.concat(F.lit("/data/${SEGMENT_"), (F.col("c_custkey") % 4).cast("string"), F.lit("}/{part}/${day:-2020}/x")).alias("dataset_urn"))


@query("SELECT c_custkey, '/data/' || CASE WHEN c_custkey % 4 = 3 THEN '${SEGMENT_3}' ELSE 'seg' || c_custkey % 4 END || '/{part}/2020/x' AS resolved_path, false AS is_resolved FROM customer")
def resolve_paths(spark, d):
    symbols = spark.createDataFrame([("SEGMENT_0", "seg0", "conf"), ("SEGMENT_1", "${DEEP}1", "conf"), ("DEEP", "seg", "conf"), ("SEGMENT_2", "seg2", "conf")], "name string, value string, source_file string")
    return resolve.resolved(_templates(spark, d), symbols).select("c_custkey", "resolved_path", "is_resolved")


@query("SELECT c_custkey, 'SEGMENT_' || c_custkey % 4 || ',part,day' AS names FROM customer")
def unresolved_variables(spark, d):
    return _templates(spark, d).select("c_custkey", F.array_join(resolve.variables(F.col("dataset_urn")), ",").alias("names"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://)', 1) || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/up' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?]*)', 1), '/+$', '') || regexp_extract(url, '([?].*)$', 1) AS canonical FROM pages")
def canonical_paths(spark, d):
    odd = F.concat(F.regexp_extract("url", "^([a-z]+://[^/]*)", 1), F.lit("//up/./gone/../"), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*([^?]*)", 1), "^/+", "/"), F.regexp_extract("url", r"([?].*)$", 1))
    return bridge.table(spark, d, "pages").select("page_id", paths.canonical_path(odd).alias("canonical"))


@query("SELECT p_partkey, 'hdfs:///data/' || lower(replace(p_brand, '#', '_')) AS path FROM part")
def canonical_cluster_paths(spark, d):
    return bridge.table(spark, d, "part").select("p_partkey", paths.canonical_path(F.concat(F.lit("/data//x/.././"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("/"))).alias("path"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/abs/' || p_size ELSE '/base/dir/rel/' || p_size END AS path FROM part")
def base_directories(spark, d):
    own = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/abs/").otherwise("rel/"), F.col("p_size").cast("string"))
    return bridge.table(spark, d, "part").select("p_partkey", paths.under(F.lit("/base/dir/"), own).alias("path"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'default.' ELSE 'sales.' END || lower(n_name) AS name FROM nation")
def table_names(spark, d):
    own = F.concat(F.lit("`"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("Sales`.`"), F.col("n_name"), F.lit("`"))
    return bridge.table(spark, d, "nation").select("n_nationkey", paths.table_name(own).alias("name"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS temporary FROM orders")
def temporary_paths(spark, d):
    own = F.concat(F.lit("/data/"), F.when(F.col("o_orderkey") % 3 == 0, "staging/").otherwise("gold/"), F.col("o_orderkey").cast("string"))
    return bridge.table(spark, d, "orders").select("o_orderkey", paths.is_temporary(own).alias("temporary"))


@query("SELECT p_partkey, p_size < 10 OR p_size % 2 = 0 AS variable FROM part")
def looks_like_variable(spark, d):
    size = F.col("p_size")
    own = F.when(size < 10, F.concat(F.lit("in"), size.cast("string"))).when(size % 2 == 0, F.concat(F.lit("inputFrame"), size.cast("string"))).otherwise(F.concat(F.lit("db.table_"), size.cast("string")))
    return bridge.table(spark, d, "part").select("p_partkey", paths.looks_like_variable(own).alias("variable"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'part_' || p_size WHEN 1 THEN 'T' || p_size ELSE 'db.t' || p_size END AS name FROM part")
def dataset_names(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    own = F.when(k == 0, F.concat(F.lit("s3://bucket/a/part_"), size, F.lit("/"))).when(k == 1, F.concat(F.lit("jdbc:oracle:thin@h:1/x#T"), size)).otherwise(F.concat(F.lit("hive://db.t"), size))
    return bridge.table(spark, d, "part").select("p_partkey", paths.dataset_name(own).alias("name"))


@query("SELECT event_id, 'k' AS config_key, json_extract_string(props, '$.k') AS config_value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def config_flatten(spark, d):
    files = bridge.table(spark, d, "events").where(F.col("props").isNotNull()).select(F.col("event_id").cast("string").alias("relative_path"), F.lit("json").alias("file_type"), F.col("props").alias("content"))
    return extract_facts(files).select(F.col("source_file").cast("long").alias("event_id"), "config_key", "config_value")


# graph


@query(f"WITH {bridge.GRAPH} SELECT urn, name, kind, fact_count FROM dataset_nodes")
def nodes_datasets(spark, d):
    return lineage.dataset_nodes(fx.without_repeats(bridge.facts(spark, d))).select("urn", "name", "kind", "fact_count")


@query(f"WITH {bridge.GRAPH} SELECT urn, name, fact_count FROM job_nodes")
def nodes_jobs(spark, d):
    return lineage.job_nodes(fx.without_repeats(bridge.facts(spark, d))).select("urn", "name", "fact_count")


@query(f"WITH {bridge.GRAPH} SELECT urn, name, fact_count FROM module_nodes")
def nodes_modules(spark, d):
    return lineage.module_nodes(fx.without_repeats(bridge.facts(spark, d))).select("urn", "name", "fact_count")


@query(f"WITH {bridge.GRAPH} SELECT src, dst, edge_type, confidence FROM direct")
def edges_read_write(spark, d):
    return _graph(spark, d)[2].where("edge_type in ('READ', 'WRITE')").select("src", "dst", "edge_type", "confidence")


@query(f"WITH {bridge.GRAPH} SELECT src, dst, confidence, evidence FROM produced")
def edges_produces(spark, d):
    return _graph(spark, d)[2].where("edge_type = 'PRODUCES'").select("src", "dst", "confidence", "evidence")


@query("SELECT 'job://order/' || o_orderkey AS src, 'job://order/' || nxt AS dst, 0.8 AS confidence FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL")
def edges_depends_on(spark, d):
    name = lambda c: F.concat(F.lit("order/"), F.col(c).cast("string"))
    calls = bridge.chain(spark, d).select(name("src").alias("source_file"), name("dst").alias("dependency_job"), F.lit("JOB_DEPENDENCY").alias("fact_type"))
    every = bridge.table(spark, d, "orders").select(name("o_orderkey").alias("source_file"), F.lit(None).cast("string").alias("dependency_job"), F.lit("READ").alias("fact_type"))
    all_ = calls.unionByName(every).withColumns({"confidence": F.lit(0.8).cast("double"), "evidence": F.lit("")})
    return lineage.depends_edges(all_).select("src", "dst", "confidence")


@query(f"WITH {bridge.GRAPH} SELECT urn, name, node_type, fact_count FROM nodes WHERE urn = 'hive://mart.nation_3'")
def urn_lookup(spark, d):
    return lineage.by_urn(_graph(spark, d)[1], "hive://mart.nation_3").select("urn", "name", "node_type", "fact_count")


@query(f"WITH {bridge.GRAPH} SELECT 'down' AS way, dst AS urn FROM links WHERE src = 'hive://raw.nation_5' UNION ALL SELECT 'up', src FROM links WHERE dst = 'hive://mart.nation_5'")
def direct_neighbours(spark, d):
    edges = _graph(spark, d)[2]
    return lineage.downstream(edges, "hive://raw.nation_5").select(F.lit("down").alias("way"), "urn").unionByName(lineage.upstream(edges, "hive://mart.nation_5").select(F.lit("up").alias("way"), "urn"))


@query("SELECT o_orderkey AS urn, CAST(n AS BIGINT) AS downstream_reach FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n > 0")
def reach_transitive(spark, d):
    return lineage.reach(bridge.chain(spark, d))


@query("WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders), l AS (SELECT * FROM o WHERE o_custkey = (SELECT max(o_custkey) FROM orders) ORDER BY k DESC LIMIT 1) SELECT o.o_orderkey AS urn FROM o JOIN l ON o.o_custkey = l.o_custkey AND o.k < l.k")
def upstream_transitive(spark, d):
    orders = bridge.table(spark, d, "orders")
    last = orders.where(F.col("o_custkey") == orders.agg(F.max("o_custkey")).first()[0]).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).first()
    return lineage.reachable(bridge.chain(spark, d), last["o_orderkey"] if last else -1, forward=False)


@query(f"WITH {bridge.GRAPH} SELECT urn, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS urn, 0 AS i, 1 AS o FROM links UNION ALL SELECT dst, 1, 0 FROM links) GROUP BY urn")
def fan_degree(spark, d):
    return lineage.degrees(_graph(spark, d)[2])


@query(f"WITH {bridge.GRAPH} SELECT 'node' AS kind, node_type AS type, count(*) AS number FROM nodes GROUP BY ROLLUP (node_type) UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ROLLUP (edge_type)")
def graph_stats(spark, d):
    _, nodes, edges = _graph(spark, d)
    return lineage.statistics(nodes, edges)


# scores


_SCORE = "round(least(1.0, greatest(0.0, confidence + CASE WHEN has_placeholders THEN -0.1 ELSE 0.1 END - CASE WHEN extraction_method = 'REGEX' THEN {} ELSE 0.0 END)), 6)"


@query(f"WITH {bridge.FACTS} SELECT score, count(*) AS n FROM (SELECT CAST({_SCORE.format('0.05')} AS DOUBLE) AS score FROM facts) GROUP BY score")
def score_facts(spark, d):
    return bridge.facts(spark, d).select(scoring.fact_score().alias("score")).groupBy("score").agg(F.count("*").alias("n"))


@query(f"WITH {bridge.FACTS} SELECT score, count(*) AS n FROM (SELECT CAST({_SCORE.format('0.2')} AS DOUBLE) AS score FROM facts) GROUP BY score")
def adjust_confidence(spark, d):
    return bridge.facts(spark, d).select(scoring.adjusted_confidence().alias("score")).groupBy("score").agg(F.count("*").alias("n"))


@query(f"WITH {bridge.GRAPH} SELECT src, dst, edge_type, round((sum(CASE WHEN confidence > 0.7 THEN 0.75 WHEN edge_type = 'READ' THEN 0.25 ELSE 0.5 END) / count(*) + max(confidence)) / 2, 6) AS edge_score FROM edges GROUP BY ALL")
def score_edges(spark, d):
    """Scores are quarters, so that sums are exact in any order."""
    score = F.when(F.col("confidence") > 0.7, 0.75).when(F.col("edge_type") == "READ", 0.25).otherwise(0.5)
    return scoring.edge_score(_graph(spark, d)[2].withColumn("score", score))


@query("SELECT p_partkey, p_size >= 10 AND p_size % 5 <> 0 AS eligible FROM part")
def metric_eligible(spark, d):
    size = F.col("p_size")
    name = F.when(size < 10, F.lit("x")).otherwise(F.concat(F.lit("sales_"), size.cast("string")))
    urn = F.concat(F.lit("/gold/"), F.when(size % 5 == 0, F.lit("*/")).otherwise(""), name)
    return bridge.table(spark, d, "part").select("p_partkey", scoring.is_eligible(urn, name).alias("eligible"))


@query(f"WITH {bridge.METRICS} SELECT urn, name, fan_in, fan_out, downstream_reach, write_job_count, avg_confidence, is_shell_only, priority_score, migration_wave FROM measured")
def priority_metrics(spark, d):
    return _measured(spark, d)[2]


@query(f"WITH {bridge.METRICS} SELECT urn, migration_wave FROM measured")
def migration_waves(spark, d):
    return _measured(spark, d)[2].select("urn", "migration_wave")


@query(f"WITH {bridge.METRICS} SELECT urn, priority_score FROM measured ORDER BY priority_score DESC, urn LIMIT 10")
def top_priority(spark, d):
    return scoring.top(_measured(spark, d)[2]).select("urn", "priority_score")


@query(f"WITH {bridge.METRICS} SELECT urn, priority_score FROM measured WHERE migration_wave = 2")
def nodes_in_wave(spark, d):
    return scoring.in_wave(_measured(spark, d)[2], 2).select("urn", "priority_score")


@query("SELECT p_partkey, p_size >= 10 AS reported FROM part")
def report_exclusion(spark, d):
    size = F.col("p_size")
    name = F.when(size < 10, F.lit("data")).otherwise(F.concat(F.lit("sales_"), size.cast("string")))
    return bridge.table(spark, d, "part").select("p_partkey", scoring.is_eligible(F.concat(F.lit("/gold/*/"), name), name, wildcards=True).alias("reported"))


@query("SELECT n_name AS urn, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 2 = 0 END AS is_known FROM nation")
def catalog_lookup(spark, d):
    nation = bridge.table(spark, d, "nation")
    urns = nation.select("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/data/"), "n_name")).otherwise(F.concat(F.lit("hive://"), "n_name")).alias("urn"))
    tables = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("default."), F.lower("n_name")).alias("name"))
    return settings.with_catalog(urns, tables).select(F.col("n_name").alias("urn"), "is_known")


@query("SELECT * FROM (VALUES ('db.host', 'h'), ('HOST', 'h'), ('db.port', '1'), ('PORT', '1'), ('env', 'prod'), ('ENV', 'prod')) AS v(name, value)")
def environment_symbols(spark, d):
    return resolve.environment(spark, {"db": {"host": "h", "port": 1, "none": None}, "env": "prod"})


# reports


@query(f"WITH {bridge.METRICS} SELECT migration_wave, count(*) AS datasets, round(CAST(sum(CAST(priority_score AS DECIMAL(18,6))) AS DOUBLE), 6) AS total_score FROM measured GROUP BY migration_wave")
def report_summary(spark, d):
    return reports.summary(_measured(spark, d)[2])


@query(f"WITH {bridge.METRICS} SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, urn) AS INTEGER) AS rank, urn, priority_score, migration_wave FROM measured ORDER BY priority_score DESC, urn LIMIT 50")
def report_top(spark, d):
    return reports.top_priorities(_measured(spark, d)[2])


_LANGUAGE = "CASE WHEN {0} LIKE '%.py' THEN 'PySpark' WHEN {0} LIKE '%.sh' THEN 'Shell' WHEN {0} LIKE '%.hql' THEN 'Hive' WHEN {0} LIKE '%.scala' THEN 'Scala' ELSE 'Other' END"
_MEAN = "round(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6)"


@query(
    f"""WITH {bridge.GRAPH}, j AS (SELECT CASE WHEN edge_type = 'READ' THEN dst ELSE src END AS job, CASE WHEN edge_type = 'READ' THEN src ELSE dst END AS dataset, edge_type, confidence FROM direct),
g AS (SELECT job, count(DISTINCT dataset) FILTER (edge_type = 'READ') AS reads, count(DISTINCT dataset) FILTER (edge_type = 'WRITE') AS writes, {_MEAN} AS avg_confidence FROM j GROUP BY job)
SELECT *, CASE WHEN avg_confidence >= 0.8 THEN 'High' WHEN avg_confidence >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence_band, {_LANGUAGE.format('job')} AS language FROM g"""
)
def report_sources(spark, d):
    return reports.sources(_graph(spark, d)[2])


@query(
    f"""WITH {bridge.METRICS} SELECT e.src, e.dst, e.edge_type, e.confidence, s.name AS source_name, s.node_type AS source_type, t.name AS target_name, t.node_type AS target_type, m.priority_score, m.migration_wave,
CASE WHEN e.confidence >= 0.8 THEN 'High' WHEN e.confidence >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence_band
FROM edges e LEFT JOIN nodes s ON e.src = s.urn LEFT JOIN nodes t ON e.dst = t.urn LEFT JOIN measured m ON m.urn = CASE WHEN e.edge_type = 'WRITE' THEN e.dst ELSE e.src END"""
)
def report_pivot(spark, d):
    return reports.pivot_ready(*_measured(spark, d))


@query(f"WITH {bridge.METRICS} SELECT urn, name, 'hive' AS kind, fan_in, fan_out FROM metrics")
def report_datasets(spark, d):
    _, nodes, edges = _graph(spark, d)
    return reports.all_datasets(nodes, lineage.degrees(edges))


@query(f"WITH {bridge.GRAPH} SELECT urn, name, CAST(coalesce(i, 0) AS BIGINT) AS edges_in, CAST(coalesce(o, 0) AS BIGINT) AS edges_out FROM job_nodes LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY dst) ON dst = urn LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY src) ON src = urn")
def report_jobs(spark, d):
    _, nodes, edges = _graph(spark, d)
    return reports.all_jobs(nodes, edges)


@query(f"WITH {bridge.GRAPH} SELECT src, dst, edge_type, confidence, evidence FROM edges ORDER BY confidence DESC, src, dst, edge_type, evidence LIMIT 1000")
def report_edges(spark, d):
    return reports.top_edges(_graph(spark, d)[2])


@query(f"WITH {bridge.METRICS} SELECT name, priority_score, downstream_reach, fan_in, fan_out FROM measured")
def report_metrics(spark, d):
    return _measured(spark, d)[2].select("name", "priority_score", "downstream_reach", "fan_in", "fan_out").orderBy(F.desc("priority_score"), "name")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'db.t' || p_size WHEN 1 THEN 'src.t' || p_size WHEN 2 THEN 'dst.t' || p_size ELSE substr('SELECT ' || p_name, 1, 50) END AS name FROM part")
def jdbc_query_table(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("db.t"), size)).when(k == 1, F.concat(F.lit("(SELECT a, b From src.t"), size, F.lit(" where x=1) q"))).when(k == 2, F.concat(F.lit("insert INTO dst.t"), size, F.lit(" values(1)"))).otherwise(F.concat(F.lit("SELECT "), "p_name"))
    return bridge.table(spark, d, "part").select("p_partkey", reports.query_table(text).alias("name"))


@query(f"WITH {bridge.USED} SELECT source, count(*) AS relationships FROM used GROUP BY source ORDER BY relationships DESC, source LIMIT 10")
def analytics_per_source(spark, d):
    return reports.per_source(_used(spark, d))


@query(f"WITH {bridge.USED} SELECT technology, count(*) AS relationships, {_MEAN} AS avg_confidence, count(DISTINCT source) AS sources, count(DISTINCT dataset) AS datasets FROM used GROUP BY technology")
def analytics_by_technology(spark, d):
    return reports.by_technology(_used(spark, d))


@query(f"WITH {bridge.USED}, g AS (SELECT technology, count(*) FILTER (edge_type = 'READ') AS reads, count(*) FILTER (edge_type = 'WRITE') AS writes FROM used GROUP BY technology) SELECT *, round(reads / greatest(writes, 1), 6) AS ratio FROM g")
def analytics_read_write(spark, d):
    return reports.read_write(_used(spark, d))


@query(f"WITH {bridge.USED} SELECT CASE WHEN confidence <= 0.5 THEN '0-50%' WHEN confidence <= 0.7 THEN '50-70%' WHEN confidence <= 0.85 THEN '70-85%' ELSE '85-100%' END AS bin, count(*) AS relationships FROM used GROUP BY bin")
def analytics_confidence(spark, d):
    return reports.confidence_histogram(_used(spark, d))


@query(f"WITH {bridge.USED} SELECT dataset, count(DISTINCT source) AS sources, count(*) FILTER (edge_type = 'READ') AS reads, count(*) FILTER (edge_type = 'WRITE') AS writes FROM used GROUP BY dataset ORDER BY sources DESC, reads DESC, dataset LIMIT 20")
def analytics_most_referenced(spark, d):
    return reports.most_referenced(_used(spark, d))


@query(f"WITH {bridge.USED} SELECT migration_wave, {', '.join(f'count(*) FILTER (technology = {t!r}) AS {t.lower()}' for t in ('Hive', 'PySpark', 'Scala', 'Shell'))} FROM used GROUP BY migration_wave")
def analytics_wave_technology(spark, d):
    return reports.wave_by_technology(_used(spark, d, waves=True))


@query(f"WITH {bridge.USED}, g AS (SELECT source, {_MEAN} AS avg_confidence, count(*) AS relationships FROM used WHERE confidence < 0.75 GROUP BY source) SELECT * FROM g WHERE avg_confidence < 0.7 ORDER BY avg_confidence, source LIMIT 10")
def analytics_low_confidence(spark, d):
    return reports.low_confidence(_used(spark, d).where("confidence < 0.75"))


@query(
    f"""WITH {bridge.USED} SELECT count(*) AS relationships, count(DISTINCT source) AS sources, count(DISTINCT dataset) AS datasets, round(100 * count(*) FILTER (confidence >= 0.8) / count(*), 4) AS high_pct,
round(100 * count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) / count(*), 4) AS medium_pct, round(100 * count(*) FILTER (confidence < 0.6) / count(*), 4) AS low_pct, round(100 * count(*) FILTER (edge_type = 'READ') / count(*), 4) AS read_pct FROM used"""
)
def analytics_summary(spark, d):
    return reports.executive_summary(_used(spark, d))


@query(f"WITH {bridge.METRICS} SELECT urn, write_job_count FROM measured WHERE is_shell_only OR avg_confidence < 0.6")
def audit_shell_and_confidence(spark, d):
    return _measured(spark, d)[2].where("is_shell_only or avg_confidence < 0.6").select("urn", "write_job_count")
