"""Extractors on texts of each language."""

import json

from weirlight.operators.extract import extract_text


def got(text, kind, *types, as_of=None):
    return sorted((f["fact_type"], f["dataset_urn"] or f.get("config_key") or f.get("dependency_job")) for f in extract_text(text, kind, as_of) if not types or f["fact_type"] in types)


def test_python_reads_writes_and_names():
    text = """
import os
BASE = "/data"
RAW = f"{BASE}/raw/" + "in"
OUT = os.getenv("OUT", "/data/out")
df = spark.read.option("header", True).csv(RAW)
df.write.mode("overwrite").parquet(OUT)
spark.table("Sales.Orders").write.saveAsTable("mart.orders")
"""
    assert got(text, "pyspark", "READ", "WRITE") == [("READ", "/data/raw/in"), ("READ", "hive://sales.orders"), ("WRITE", "/data/out"), ("WRITE", "hive://mart.orders")]
    facts = extract_text(text, "pyspark")
    assert next(f for f in facts if f["fact_type"] == "WRITE" and f["dataset_urn"] == "/data/out")["write_mode"] == "overwrite"
    assert {f["config_key"] for f in facts if f["fact_type"] == "CONFIG"} == {"BASE", "RAW", "OUT"}


def test_python_kafka_jdbc_delta_sql():
    text = """
s = spark.readStream.format("kafka").option("subscribe", "clicks").load()
s.writeStream.format("parquet").option("path", "/out").option("checkpointLocation", "/chk").start()
spark.read.jdbc(url="jdbc:oracle:thin:@h", table="A.B")
spark.read.option("url", "jdbc:mysql://h/d").format("jdbc").option("dbtable", "(select * from t1) q").load()
t = DeltaTable.forPath(spark, "/delta/t")
t.alias("a").merge(s, "x").execute()
spark.sql("WITH c AS (SELECT * FROM db.a) INSERT OVERWRITE TABLE db.o SELECT * FROM c JOIN db.b ON 1=1")
"""
    assert got(text, "pyspark", "READ", "WRITE") == sorted([
        ("READ", "kafka://clicks"), ("WRITE", "/out"), ("WRITE", "/chk"), ("READ", "jdbc:oracle:thin:@h#A.B"), ("READ", "jdbc:mysql://h/d#t1"), ("READ", "/delta/t"), ("WRITE", "/delta/t"),
        ("READ", "hive://db.a"), ("READ", "hive://db.b"), ("WRITE", "hive://db.o"),
    ])


def test_python_helper_calls_count_at_the_call():
    text = """
def load(path, fmt="x"):
    return spark.read.parquet(path)

a = load("/data/one")
"""
    facts = [f for f in extract_text(text, "pyspark") if f["fact_type"] == "READ"]
    assert ("/data/one", 5, 0.75) in [(f["dataset_urn"], f["line_number"], f["confidence"]) for f in facts]


def test_sql_statements():
    text = """-- from commented.out
SET hivevar:env=prod;
INSERT OVERWRITE TABLE mart.${hivevar:env}_x PARTITION (d='1') SELECT a.* FROM raw.a a LEFT JOIN raw.b ON a.i = b.i;
CREATE EXTERNAL TABLE IF NOT EXISTS db.ext (i INT) LOCATION '/data/ext';
LOAD DATA INPATH '/in/f' INTO TABLE db.l;
DELETE FROM db.gone WHERE i = 1;
"""
    assert got(text, "hive") == sorted([
        ("CONFIG", "env"), ("WRITE", "hive://mart.${hivevar:env}_x"), ("READ", "hive://raw.a"), ("READ", "hive://raw.b"), ("WRITE", "hive://db.ext"), ("TABLE_LOCATION", "/data/ext"), ("READ", "/in/f"), ("WRITE", "hive://db.l"), ("WRITE", "hive://db.gone"),
    ])
    assert got("SELECT * FROM db.x a, db.y b, db.z", "hive") == [("READ", "hive://db.x"), ("READ", "hive://db.y"), ("READ", "hive://db.z")]


def test_shell_commands():
    text = """#!/bin/bash
export IN=/data/in   # a comment
DAY=$(date +%Y-%m-%d)
OLD=$(date -d "3 days ago" +%Y%m%d)
hdfs dfs -put local.csv /data/landing/
hadoop fs -cp /a /b
hadoop distcp -m 20 hdfs://x/p hdfs://y/q
scp user@host:/exp/f.csv /tmp/
spark-submit --master yarn --conf spark.a=b --py-files lib.py \\
  jobs/etl.py --in /x
hive -e "INSERT INTO TABLE m.t SELECT * FROM r.s"
sftp u@h.example.com <<EOF
cd /out
mput *.csv
EOF
"""
    assert got(text, "shell", "READ", "WRITE", "JOB_DEPENDENCY", as_of="2026-03-05") == sorted([
        ("WRITE", "/data/landing/"), ("READ", "/a"), ("WRITE", "/b"), ("READ", "hdfs://x/p"), ("WRITE", "hdfs://y/q"), ("READ", "user@host:/exp/f.csv"), ("JOB_DEPENDENCY", "jobs/etl.py"), ("JOB_DEPENDENCY", "hive"),
        ("WRITE", "hive://m.t"), ("READ", "hive://r.s"), ("WRITE", "u@h.example.com:/out/*.csv"),
    ])
    values = {f["config_key"]: f["config_value"] for f in extract_text(text, "shell", "2026-03-05") if f["fact_type"] == "CONFIG"}
    assert values == {"IN": "/data/in", "DAY": "2026-03-05", "OLD": "20260302"}
    assert got("0 5 * * * spark-submit a.py\n# 1 1 * * * x.sh\n@daily /opt/run.sh", "shell") == [("JOB_DEPENDENCY", "/opt/run.sh"), ("JOB_DEPENDENCY", "a.py")]


def test_scala_and_java():
    scala = """
val base = "hdfs://nn/data" // base
val out = s"$base/out"
val df = spark.read.format("delta").load(base)
df.write.mode("append").parquet(out)
df.write.saveAsTable("m.t")
spark.sql("select * from r.q")
def grab(path: String) = spark.read.parquet(path)
grab("/h/1")
"""
    assert {("READ", "hdfs://nn/data"), ("WRITE", "hdfs://nn/data/out"), ("WRITE", "hive://m.t"), ("READ", "hive://r.q"), ("READ", "/h/1")} <= set(got(scala, "scala", "READ", "WRITE"))
    java = """
class A { static final String IN = "/data/in";
  void f() { spark.read().parquet(IN); fs.rename(new Path("/a"), new Path("/b"));
    df.write().jdbc("jdbc:postgresql://h/d", "t", p);
    stmt.execute(String.format("INSERT INTO TABLE %s SELECT * FROM src.x", "dst.y")); } }
"""
    assert set(got(java, "java", "READ", "WRITE")) == {("READ", "/data/in"), ("READ", "/a"), ("WRITE", "/b"), ("WRITE", "jdbc:postgresql://h/d#t"), ("WRITE", "hive://dst.y"), ("READ", "hive://src.x")}


def test_flows_and_configuration():
    unit = lambda i, kind, **p: {"type": f"org.x.{kind}", "name": i, "identifier": i, "config": {"properties": p}}
    inner = {"processors": [unit("2", "PublishKafka_2_6", topic="t")]}
    contexts = [dict(name="c", parameters=[dict(value="v", name="p")])]
    flow = json.dumps({"parameterContexts": contexts, "flowContents": {"processGroups": [inner], "processors": [unit("1", "GetHDFS", Directory="/landing")]}})
    assert got(flow, "nifi") == [("CONFIG", "p"), ("READ", "/landing"), ("WRITE", "kafka://t")]
    assert got('{"a": {"b": [1, {"c": true}], "d": null}}', "json") == [("CONFIG", "a.b[0]"), ("CONFIG", "a.b[1].c")]
    assert got("a:\n  b: x\n", "yaml") == [("CONFIG", "a.b")]
    assert got("# c\nk.x = v=w\n! d\n", "properties") == [("CONFIG", "k.x")]
    assert got("<configuration><property><name>n</name><value>v</value></property><e at='1'/></configuration>", "xml") == [("CONFIG", "e.at"), ("CONFIG", "n")]
