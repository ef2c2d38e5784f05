"""Queries of the extractors: for each operator a program text with the facts it has to give.

A case is a text, in which «k» stands for a supplier's key and «n» for its nation's, and the facts written down by hand
for it. The query makes one file for each supplier, of the whole table, and runs the extractors over them; its SQL puts
the same keys into the facts. So the SQL knows nothing of the extractors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.operators.extract import extract_facts

#: fact_type, line, confidence, name (dataset_urn, config_key or dependency_job), detail (dataset_type, config_value or dependency_type)
Fact = tuple[str, int, float, str, str]
AS_OF = "2026-03-05"


@dataclass(frozen=True)
class Case:
    kind: str
    text: str
    facts: tuple[Fact, ...]
    as_of: str | None = AS_OF

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
        files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
            F.concat(F.lit("case/"), key).alias("relative_path"), F.lit(self.kind).alias("file_type"), F.replace(F.replace(F.lit(self.text), F.lit("«k»"), key), F.lit("«n»"), nation).alias("content")
        )
        return extract_facts(files, self.as_of).select(
            "source_file", "fact_type", "line_number", F.round("confidence", 2).alias("confidence"), F.coalesce("dataset_urn", "config_key", "dependency_job", F.lit("")).alias("name"), F.coalesce("dataset_type", "config_value", "dependency_type", F.lit("")).alias("detail")
        )

    def sql(self) -> str:
        quoted = lambda x: "'" + x.replace("'", "''") + "'"
        put = lambda x: f"replace(replace({quoted(x)}, '«k»', CAST(s_suppkey AS VARCHAR)), '«n»', CAST(s_nationkey AS VARCHAR))"
        return "\nUNION ALL ".join(
            f"SELECT 'case/' || s_suppkey AS source_file, '{kind}' AS fact_type, {line} AS line_number, CAST({confidence} AS DOUBLE) AS confidence, {put(name)} AS name, {put(detail)} AS detail FROM supplier" for kind, line, confidence, name, detail in self.facts
        )


def case(kind: str, text: str, *facts: Fact, as_of: str | None = AS_OF) -> Case:
    return Case(kind, text.strip("\n") + "\n", facts, as_of)


R, W, C, J, L, E = "READ", "WRITE", "CONFIG", "JOB_DEPENDENCY", "TABLE_LOCATION", "ERROR"

PYSPARK = {
    "x01_read_calls": case("pyspark", """
a = spark.read.option("header", True).csv("/raw/«k»/a.csv")
b = spark.read.parquet(path="/raw/«k»/b")
c = spark.read.format("orc").load("/raw/«k»/c")
d = spark.readStream.schema(s).json("/in/«k»")
e = spark.read.format("x").load()
f = sc.textFile("/raw/«k»/f")
""", (R, 1, 0.75, "/raw/«k»/a.csv", "hdfs"), (R, 2, 0.75, "/raw/«k»/b", "hdfs"), (R, 3, 0.75, "/raw/«k»/c", "hdfs"), (R, 4, 0.75, "/in/«k»", "hdfs"), (R, 6, 0.75, "/raw/«k»/f", "hdfs")),
    "x02_kafka_read": case("pyspark", """
a = spark.readStream.format("kafka").option("subscribe", "clicks_«k»").load()
b = spark.readStream.format("kafka").option("topics", "t«k»").load()
c = spark.read.format("kafka").option("topic", "u«k»").load()
d = spark.readStream.format("kafka").option("subscribePattern", "p.*").load()
""", (R, 1, 0.85, "kafka://clicks_«k»", "kafka"), (R, 2, 0.85, "kafka://t«k»", "kafka"), (R, 3, 0.85, "kafka://u«k»", "kafka"), (R, 4, 0.75, "kafka://unknown_topic", "kafka")),
    "x03_write_calls": case("pyspark", """
df.write.mode("append").parquet("/out/«k»/a")
df.write.format("csv").save("/out/«k»/b")
df.writeStream.format("parquet").option("path", "/out/«k»/c").start()
df.rdd.saveAsTextFile("/out/«k»/d")
""", (W, 1, 0.75, "/out/«k»/a", "hdfs"), (W, 2, 0.75, "/out/«k»/b", "hdfs"), (W, 3, 0.75, "/out/«k»/c", "hdfs"), (W, 4, 0.75, "/out/«k»/d", "hdfs")),
    "x04_kafka_write": case("pyspark", """
a.writeStream.format("kafka").option("topic", "o«k»").option("checkpointLocation", "/chk/«k»").start()
b.write.format("kafka").save()
""", (W, 1, 0.85, "kafka://o«k»", "kafka"), (W, 1, 0.85, "/chk/«k»", "hdfs"), (W, 2, 0.75, "kafka://unknown_topic", "kafka")),
    "x05_table_calls": case("pyspark", """
a = spark.table("Db.T«k»")
b = spark.read.table("db.u«k»")
a.write.mode("overwrite").saveAsTable("mart.Out«k»")
b.write.insertInto("mart.more«k»")
""", (R, 1, 0.9, "hive://db.t«k»", "hive"), (R, 2, 0.9, "hive://db.u«k»", "hive"), (W, 3, 0.9, "hive://mart.out«k»", "hive"), (W, 4, 0.9, "hive://mart.more«k»", "hive")),
    "x06_embedded_sql": case("pyspark", '''
spark.sql("""
  WITH c AS (SELECT * FROM raw.a«k»)
  INSERT OVERWRITE TABLE mart.o«k»
  SELECT * FROM c JOIN raw.b«k» b ON c.i = b.i LEFT JOIN RAW.A«k» z ON 1 = 1
""")
''', (R, 2, 0.8, "hive://raw.a«k»", "hive"), (W, 3, 0.8, "hive://mart.o«k»", "hive"), (R, 4, 0.8, "hive://raw.b«k»", "hive")),
    "x07_delta": case("pyspark", """
t = DeltaTable.forPath(spark, "/delta/«k»")
u = DeltaTable.forName(spark, "db.d«k»")
t.alias("a").merge(src, "a.i = b.i").whenMatchedUpdateAll().execute()
v = spark.read.format("delta").load("/delta/in«k»")
""", (R, 1, 0.9, "/delta/«k»", "delta"), (R, 2, 0.9, "hive://db.d«k»", "delta"), (W, 3, 0.75, "/delta/«k»", "delta"), (R, 4, 0.75, "/delta/in«k»", "delta")),
    "x08_jdbc": case("pyspark", """
a = spark.read.jdbc("jdbc:postgresql://h/d", "s.t«k»")
b = spark.read.jdbc(url="jdbc:oracle:thin:@h", table="A.B«k»")
c = spark.read.format("jdbc").option("url", "jdbc:mysql://h/d").option("dbtable", "m«k»").load()
a.write.format("jdbc").option("url", "jdbc:sqlserver://h").option("dbtable", "w«k»").save()
b.write.jdbc("jdbc:h2:x", "v«k»")
""", (R, 1, 0.85, "jdbc:postgresql://h/d#s.t«k»", "postgres"), (R, 2, 0.85, "jdbc:oracle:thin:@h#A.B«k»", "oracle"), (R, 3, 0.85, "jdbc:mysql://h/d#m«k»", "mysql"), (W, 4, 0.85, "jdbc:sqlserver://h#w«k»", "mssql"), (W, 5, 0.85, "jdbc:h2:x#v«k»", "jdbc")),
    "x09_table_of_query": case("pyspark", """
a = spark.read.format("jdbc").option("url", "jdbc:mysql://h/d").option("dbtable", "(select i from t«k» where x > 1) q").load()
b = spark.read.format("jdbc").option("url", "jdbc:mysql://h/d").option("query", "SELECT * FROM s.u«k»").load()
""", (R, 1, 0.85, "jdbc:mysql://h/d#t«k»", "mysql"), (R, 2, 0.85, "jdbc:mysql://h/d#s.u«k»", "mysql")),
    "x10_assignments": case("pyspark", """
BASE = "/data/«k»"
N = 5
other = [1]
""", (C, 1, 0.95, "BASE", "/data/«k»"), (C, 2, 0.95, "N", "5")),
    "x11_f_strings": case("pyspark", """
BASE = "/data/«k»"
OUT = f"{BASE}/out/{day}"
spark.read.parquet(f"{OUT}/x")
""", (C, 1, 0.95, "BASE", "/data/«k»"), (C, 2, 0.85, "OUT", "/data/«k»/out/{day}"), (R, 3, 0.75, "/data/«k»/out/{day}/x", "hdfs")),
    "x12_argv_defaults": case("pyspark", """
import sys
SRC = sys.argv[1] if len(sys.argv) > 1 else "/in/«k»"
spark.read.orc(SRC)
""", (C, 2, 0.8, "SRC", "/in/«k»"), (R, 3, 0.75, "/in/«k»", "hdfs")),
    "x13_environment_defaults": case("pyspark", """
import os
A = os.getenv("A", "/a/«k»")
B = os.environ.get("B", "/b/«k»")
D = os.getenv("D")
spark.read.text(A).write.text(B)
""", (C, 2, 0.85, "A", "/a/«k»"), (C, 3, 0.85, "B", "/b/«k»"), (R, 5, 0.75, "/a/«k»", "hdfs"), (W, 5, 0.75, "/b/«k»", "hdfs")),
    "x14_dates": case("pyspark", """
from datetime import datetime
DAY = datetime.now().strftime("%Y%m%d")
spark.read.json(f"/in/«k»/{DAY}")
""", (C, 2, 0.9, "DAY", "20260305"), (R, 3, 0.75, "/in/«k»/20260305", "hdfs")),
    "x14_dates_left_open": case("pyspark", """
from datetime import datetime
DAY = datetime.now().strftime("%Y%m%d")
spark.read.json(f"/in/«k»/{DAY}")
""", (R, 3, 0.75, "/in/«k»/{DAY}", "hdfs"), as_of=None),
    "x15_parameter_defaults": case("pyspark", """
def go(src="/in/«k»", n=3):
    return spark.read.csv(src)
""", (C, 1, 0.8, "src", "/in/«k»"), (R, 2, 0.75, "/in/«k»", "hdfs")),
    "x16_self_attributes": case("pyspark", """
class Job:
    def __init__(self):
        self.path = "/in/«k»"

    def run(self):
        return spark.read.avro(self.path)
""", (C, 3, 0.75, "config.path", "/in/«k»"), (R, 6, 0.75, "/in/«k»", "hdfs")),
    "x17_folding": case("pyspark", """
ROOT = "/r/«k»"
spark.read.parquet(ROOT + "/a")
spark.read.parquet(ROOT + "/" + name)
spark.read.parquet("{}/b".format(ROOT))
spark.read.parquet(conf["path"])
spark.read.parquet(os.path.join(ROOT, "c", "d"))
""", (C, 1, 0.95, "ROOT", "/r/«k»"), (R, 2, 0.75, "/r/«k»/a", "hdfs"), (R, 3, 0.75, "/r/«k»/{name}", "hdfs"), (R, 4, 0.75, "/r/«k»/b", "hdfs"), (R, 5, 0.75, "{conf}", "hdfs"), (R, 6, 0.75, "/r/«k»/c/d", "hdfs")),
    "x18_option_chains": case("pyspark", """
a = (spark.read
     .options(url="jdbc:mysql://h/d", dbtable="o«k»")
     .option("fetchsize", "10").option("driver", "x").option("a", "b").option("c", "d")
     .format("jdbc")
     .load())
""", (R, 1, 0.85, "jdbc:mysql://h/d#o«k»", "mysql")),
    "x19_syntax_errors": case("pyspark", """
def broken(«k»:
""", (E, 0, 0.0, "", "")),
    "x20_calls_of_helpers": case("pyspark", """
def load(path, fmt="parquet"):
    return spark.read.format(fmt).load(path)

a = load("/one/«k»")
b = load(path="/two/«k»", fmt="delta")
""", (C, 1, 0.8, "fmt", "parquet"), (R, 2, 0.75, "{path}", "hdfs"), (R, 4, 0.75, "/one/«k»", "hdfs"), (R, 5, 0.75, "/two/«k»", "delta")),
    "m01_bound_arguments": case("pyspark", """
def put(df, db, name="t«k»"):
    df.write.saveAsTable(db + "." + name)

put(x, "mart")
put(x, "mart", "z«k»")
put(x, "a", "b", "too", "many")
""", (C, 1, 0.8, "name", "t«k»"), (W, 2, 0.9, "hive://{db}.t«k»", "hive"), (W, 4, 0.8, "hive://mart.t«k»", "hive"), (W, 5, 0.8, "hive://mart.z«k»", "hive")),
    "m02_nested_helpers": case("pyspark", """
def inner(p):
    return spark.read.orc(p)

def outer(base):
    return inner(base + "/x")

outer("/deep/«k»")
""", (R, 2, 0.75, "{p}", "hdfs"), (R, 5, 0.75, "{base}/x", "hdfs"), (R, 7, 0.75, "/deep/«k»/x", "hdfs")),
    "m04_method_calls": case("pyspark", """
class Io:
    def grab(self, path):
        return spark.read.csv(path)

    def run(self):
        return self.grab("/m/«k»")
""", (R, 3, 0.75, "{path}", "hdfs"), (R, 6, 0.75, "/m/«k»", "hdfs")),
}

HIVE = {
    "h01_comments": case("hive", """
-- FROM gone.a«k»
/* JOIN gone.b«k»
   more */
SELECT '-- FROM x' FROM db.c«k»; -- end
""", (R, 4, 0.85, "hive://db.c«k»", "hive")),
    "h02_statements": case("hive", """
SELECT * FROM a.x«k»; SELECT ';' FROM a.y«k»;
SELECT * FROM a.x«k»
""", (R, 1, 0.85, "hive://a.x«k»", "hive"), (R, 1, 0.85, "hive://a.y«k»", "hive"), (R, 2, 0.85, "hive://a.x«k»", "hive")),
    "h03_set_variables": case("hive", """
SET hivevar:env=prod«k»;
set hiveconf:queue = q«n»;
SET hive.exec.dynamic.partition=true;
""", (C, 1, 0.9, "env", "prod«k»"), (C, 2, 0.9, "queue", "q«n»"), (C, 3, 0.9, "hive.exec.dynamic.partition", "true")),
    "h04_dispatch": case("hive", """
INSERT INTO TABLE d.a«k» SELECT 1;
SELECT * FROM d.b«k»;
CREATE TABLE d.c«k» (i INT);
UPDATE d.e«k» SET i = 1;
USE d;
""", (W, 1, 0.85, "hive://d.a«k»", "hive"), (R, 2, 0.85, "hive://d.b«k»", "hive"), (W, 3, 0.85, "hive://d.c«k»", "hive"), (W, 4, 0.85, "hive://d.e«k»", "hive")),
    "h05_insert": case("hive", """
INSERT OVERWRITE TABLE m.o«k» PARTITION (d = '1')
SELECT a.* FROM r.a«k» a
LEFT JOIN r.b«k» b ON a.i = b.i;
INSERT OVERWRITE DIRECTORY '/exp/«k»' SELECT * FROM r.c«k»;
""", (W, 1, 0.85, "hive://m.o«k»", "hive"), (R, 2, 0.85, "hive://r.a«k»", "hive"), (R, 3, 0.85, "hive://r.b«k»", "hive"), (W, 4, 0.8, "/exp/«k»", "hdfs"), (R, 4, 0.85, "hive://r.c«k»", "hive")),
    "h05_multiple_insert": case("hive", """
FROM r.src«k» s
INSERT OVERWRITE TABLE m.a«k» SELECT s.i WHERE s.i > 0
INSERT INTO TABLE m.b«k» SELECT s.i WHERE s.i <= 0;
""", (R, 1, 0.85, "hive://r.src«k»", "hive"), (W, 2, 0.85, "hive://m.a«k»", "hive"), (W, 3, 0.85, "hive://m.b«k»", "hive")),
    "h06_select": case("hive", """
SELECT * FROM d.x«k» a, d.y«k» b, d.z«k»
WHERE a.i IN (SELECT i FROM d.w«k»);
""", (R, 1, 0.85, "hive://d.x«k»", "hive"), (R, 1, 0.85, "hive://d.y«k»", "hive"), (R, 1, 0.85, "hive://d.z«k»", "hive"), (R, 2, 0.85, "hive://d.w«k»", "hive")),
    "h07_identifiers": case("hive", """
INSERT INTO TABLE ${hivevar:db}.t_${hivevar:env}_«k» SELECT * FROM `raw`.`s«k»`;
""", (W, 1, 0.85, "hive://${hivevar:db}.t_${hivevar:env}_«k»", "hive"), (R, 1, 0.85, "hive://raw.s«k»", "hive")),
    "h08_create": case("hive", """
CREATE EXTERNAL TABLE IF NOT EXISTS d.ext«k» (i INT)
LOCATION '/data/ext/«k»';
CREATE TABLE d.ctas«k» AS SELECT * FROM d.src«k»;
CREATE TABLE d.copy«k» LIKE d.like«k»;
""", (W, 1, 0.85, "hive://d.ext«k»", "hive"), (L, 2, 0.8, "/data/ext/«k»", "hdfs"), (W, 3, 0.85, "hive://d.ctas«k»", "hive"), (R, 3, 0.85, "hive://d.src«k»", "hive"), (W, 4, 0.85, "hive://d.copy«k»", "hive"), (R, 4, 0.85, "hive://d.like«k»", "hive")),
    "h09_delete_update": case("hive", """
DELETE FROM d.gone«k» WHERE i = 1;
UPDATE d.new«k» SET i = 2;
MERGE INTO d.m«k» USING d.s«k» ON a = b WHEN MATCHED THEN DELETE;
""", (W, 1, 0.85, "hive://d.gone«k»", "hive"), (W, 2, 0.85, "hive://d.new«k»", "hive"), (W, 3, 0.85, "hive://d.m«k»", "hive"), (R, 3, 0.85, "hive://d.s«k»", "hive")),
    "h10_other_statements": case("hive", """
LOAD DATA INPATH '/in/«k»' OVERWRITE INTO TABLE d.l«k»;
ALTER TABLE d.a«k» SET LOCATION '/new/«k»';
CREATE OR REPLACE VIEW d.v«k» AS SELECT * FROM d.t«k»;
""", (R, 1, 0.8, "/in/«k»", "hdfs"), (W, 1, 0.85, "hive://d.l«k»", "hive"), (L, 2, 0.8, "/new/«k»", "hdfs"), (W, 3, 0.85, "hive://d.v«k»", "hive"), (R, 3, 0.85, "hive://d.t«k»", "hive")),
    "h11_names_that_are_no_tables": case("hive", """
WITH c AS (SELECT * FROM d.a«k»), e AS (SELECT * FROM c)
SELECT * FROM e JOIN d.b«k» x ON 1 = 1 LATERAL VIEW explode(x.l) q AS y;
""", (R, 1, 0.85, "hive://d.a«k»", "hive"), (R, 2, 0.85, "hive://d.b«k»", "hive")),
    "h12_one_fact_a_table": case("hive", """
SELECT * FROM D.T«k» a JOIN d.t«k» b ON a.i = b.j
JOIN d.u«k» ON 1 = 1;
""", (R, 1, 0.85, "hive://d.t«k»", "hive"), (R, 2, 0.85, "hive://d.u«k»", "hive")),
}

LONG = "".join(f'\n  .option("key{i}", "a value of some length {i}")' for i in range(25))
SCALA = {
    "l01_comments_and_chains": case("scala", """
// spark.read.parquet("/gone/«k»")
val a = spark.read // text
  .parquet("hdfs://nn/x«k»")
/* a.write.orc("/gone/«k»") */
""", (R, 2, 0.75, "hdfs://nn/x«k»", "hdfs")),
    "l02_reads": case("scala", """
val base = "/in/«k»"
val a = spark.read.csv(base)
val b = spark.read.json(s"$base/j")
val c = spark.read.table("Db.T«k»")
val d = spark.read.option("x", "y").orc("/o/«k»")
""", (C, 1, 0.9, "base", "/in/«k»"), (R, 2, 0.75, "/in/«k»", "hdfs"), (R, 3, 0.75, "/in/«k»/j", "hdfs"), (R, 4, 0.75, "hive://db.t«k»", "hive"), (R, 5, 0.75, "/o/«k»", "hdfs")),
    "l03_formats": case("scala", """
val a = spark.read.format("delta").load("/d/«k»")
val b = spark.read.format("sftp").load("/s/«k»")
a.write.format("delta").save("/e/«k»")
b.write.format("csv").save("/f/«k»")
""", (R, 1, 0.75, "/d/«k»", "delta"), (R, 2, 0.75, "/s/«k»", "sftp"), (W, 3, 0.75, "/e/«k»", "delta"), (W, 4, 0.75, "/f/«k»", "hdfs")),
    "l03_long_chains": case("scala", f"""
val a = spark.read.format("csv"){LONG}
  .load("/in/«k»")
a.write.format("orc"){LONG}
  .save("/out/«k»")
""", (R, 1, 0.75, "/in/«k»", "hdfs"), (W, 28, 0.75, "/out/«k»", "hdfs")),
    "l04_writes": case("scala", """
a.write.mode("append").parquet("/p/«k»")
a.write.partitionBy("d").saveAsTable("m.t«k»")
a.write.insertInto("m.u«k»")
a.writeStream.format("parquet").option("path", "/w/«k»").option("checkpointLocation", "/c/«k»").start()
""", (W, 1, 0.75, "/p/«k»", "hdfs"), (W, 2, 0.75, "hive://m.t«k»", "hive"), (W, 3, 0.75, "hive://m.u«k»", "hive"), (W, 4, 0.75, "/w/«k»", "hdfs"), (W, 4, 0.85, "/c/«k»", "hdfs")),
    "l05_jdbc": case("scala", f"""
val u = "jdbc:postgresql://h/d"
val a = spark.read.jdbc(u, "s.t«k»", props)
val b = spark.read.format("jdbc").option("url", u).option("dbtable", "(select * from x«k» join y«k» on i = j) q").load()
b.write{LONG}.jdbc(u, "o«k»", props)
""", (C, 1, 0.9, "u", "jdbc:postgresql://h/d"), (R, 2, 0.8, "jdbc:postgresql://h/d#s.t«k»", "postgres"), (R, 3, 0.8, "jdbc:postgresql://h/d#x«k»", "postgres"), (R, 3, 0.8, "jdbc:postgresql://h/d#y«k»", "postgres"), (W, 4, 0.8, "jdbc:postgresql://h/d#o«k»", "postgres")),
    "l06_kafka": case("scala", """
val a = spark.readStream.format("kafka").option("subscribe", "in«k»").load()
a.writeStream.format("kafka").option("topic", "out«k»").start()
producer.send(new ProducerRecord[String, String]("rec«k»", v))
consumer.subscribe(List("sub«k»"))
val b = spark.readStream.format("kafka").load()
""", (R, 1, 0.85, "kafka://in«k»", "kafka"), (W, 2, 0.85, "kafka://out«k»", "kafka"), (W, 3, 0.85, "kafka://rec«k»", "kafka"), (R, 4, 0.85, "kafka://sub«k»", "kafka"), (R, 5, 0.75, "kafka://unknown_topic", "kafka")),
    "l07_variables": case("scala", """
val a = "/a/«k»"
var b: String = "x" + "«n»"
val c = if (args.length > 0) args(0) else "/def/«k»"
val d = a + "/sub"
spark.read.text(d)
""", (C, 1, 0.9, "a", "/a/«k»"), (C, 2, 0.9, "b", "x«n»"), (C, 3, 0.85, "c", "/def/«k»"), (R, 5, 0.75, "/a/«k»/sub", "hdfs")),
    "l08_date_patterns": case("scala", """
val day = new SimpleDateFormat("yyyy-MM-dd").format(new Date())
val hour = LocalDateTime.now.format(DateTimeFormatter.ofPattern("yyyyMMdd"))
spark.read.json(s"/in/«k»/$day")
""", (C, 1, 0.88, "day", "2026-03-05"), (C, 2, 0.88, "hour", "20260305"), (R, 3, 0.75, "/in/«k»/2026-03-05", "hdfs")),
    "l09_helpers": case("scala", """
def grab(path: String) = spark.read.parquet(path)
def put(df: DataFrame, to: String) = { df.write.orc(to) }
val x = grab("/h/«k»")
put(x, "/g/«k»")
""", (R, 1, 0.75, "{path}", "hdfs"), (W, 2, 0.75, "{to}", "hdfs"), (R, 3, 0.75, "/h/«k»", "hdfs"), (W, 4, 0.75, "/g/«k»", "hdfs")),
    "m03_default_arguments": case("scala", """
def grab(path: String, kind: String = "delta") = spark.read.format(kind).load(path)
val x = grab("/h/«k»")
""", (R, 1, 0.75, "{path}", "hdfs"), (R, 2, 0.75, "/h/«k»", "delta")),
}

JAVA = {
    "j01_comments": case("java", """
// spark.read().parquet("/gone/«k»");
String s = "http://x//«k»"; /* fs.open(new Path("/gone")) */
spark.read().parquet("/in/«k»");
""", (C, 2, 0.9, "s", "http://x//«k»"), (R, 3, 0.8, "/in/«k»", "hdfs")),
    "j02_variables": case("java", """
public static final String IN = "/in/«k»";
String out = IN + "/out";
private String t = "a" + "b";
""", (C, 1, 0.9, "IN", "/in/«k»"), (C, 3, 0.9, "t", "ab")),
    "j03_spark": case("java", f"""
Dataset<Row> a = spark.read().format("csv"){LONG}
  .load("/in/«k»");
a.write().mode("append").parquet("/out/«k»");
a.write().saveAsTable("m.t«k»");
spark.sql("SELECT * FROM d.q«k»");
""", (R, 1, 0.8, "/in/«k»", "hdfs"), (W, 28, 0.8, "/out/«k»", "hdfs"), (W, 29, 0.8, "hive://m.t«k»", "hive"), (R, 30, 0.8, "hive://d.q«k»", "hive")),
    "j04_kafka": case("java", """
producer.send(new ProducerRecord<String, String>("p«k»", v));
consumer.subscribe(Arrays.asList("c«k»"));
producer.send(new ProducerRecord<>(topic, v));
""", (W, 1, 0.85, "kafka://p«k»", "kafka"), (R, 2, 0.85, "kafka://c«k»", "kafka"), (W, 3, 0.75, "kafka://{topic}", "kafka")),
    "j05_hdfs": case("java", """
fs.copyToLocalFile(new Path("/a/«k»"), local);
fs.copyFromLocalFile(local, new Path("/b/«k»"));
fs.rename(new Path("/c/«k»"), new Path("/d/«k»"));
fs.open(new Path("/e/«k»"));
fs.create(new Path("/f/«k»"));
fs.mkdirs(new Path("/g/«k»"));
fs.delete(new Path("/h/«k»"), true);
""", (R, 1, 0.75, "/a/«k»", "hdfs"), (W, 2, 0.75, "/b/«k»", "hdfs"), (R, 3, 0.75, "/c/«k»", "hdfs"), (W, 3, 0.75, "/d/«k»", "hdfs"), (R, 4, 0.75, "/e/«k»", "hdfs"), (W, 5, 0.75, "/f/«k»", "hdfs"), (W, 6, 0.75, "/g/«k»", "hdfs"), (R, 7, 0.75, "/h/«k»", "hdfs")),
    "j06_jdbc": case("java", """
df.read().jdbc("jdbc:mysql://h/d", "r«k»", p);
df.write().jdbc("jdbc:oracle:thin:@h", "W«k»", p);
stmt.executeUpdate("INSERT INTO TABLE d.i«k» SELECT * FROM d.s«k»");
""", (R, 1, 0.8, "jdbc:mysql://h/d#r«k»", "mysql"), (W, 2, 0.8, "jdbc:oracle:thin:@h#W«k»", "oracle"), (W, 3, 0.8, "hive://d.i«k»", "hive"), (R, 3, 0.8, "hive://d.s«k»", "hive")),
    "j07_path_variables": case("java", """
static final String IN = "/in/«k»";
Path a = new Path(IN + "/" + day);
Path b = new Path(IN, "child");
InputStream s = fs.open(a);
fs.mkdirs(b);
if (fs.exists(new Path(IN + "/flag"))) { }
FileOutputFormat.setOutputPath(job, new Path("/mr/«k»"));
""", (C, 1, 0.9, "IN", "/in/«k»"), (R, 4, 0.75, "/in/«k»/{day}", "hdfs"), (W, 5, 0.75, "/in/«k»/child", "hdfs"), (R, 6, 0.75, "/in/«k»/flag", "hdfs"), (W, 7, 0.75, "/mr/«k»", "hdfs")),
    "j08_formatted_sql": case("java", """
String db = "mart";
stmt.execute(String.format("CREATE TABLE %s.t«k» AS SELECT * FROM %s", db, "raw.s«k»"));
stmt.execute(String.format("INSERT OVERWRITE DIRECTORY '/x/«k»' SELECT * FROM %s.u«k»", db));
""", (C, 1, 0.9, "db", "mart"), (W, 2, 0.8, "hive://mart.t«k»", "hive"), (R, 2, 0.8, "hive://raw.s«k»", "hive"), (W, 3, 0.75, "/x/«k»", "hdfs"), (R, 3, 0.8, "hive://mart.u«k»", "hive")),
}

SHELL = {
    "b01_comments": case("shell", """
#!/bin/bash
# hdfs dfs -cp /gone/«k» /gone
hdfs dfs -cp "/a#«k»" /b/«k» # hadoop fs -cp /gone /gone
""", (R, 3, 0.7, "/a#«k»", "hdfs"), (W, 3, 0.7, "/b/«k»", "hdfs")),
    "b02_continuations": case("shell", """
hdfs dfs \\
  -cp /a/«k» \\
  /b/«k»
""", (R, 1, 0.7, "/a/«k»", "hdfs"), (W, 1, 0.7, "/b/«k»", "hdfs")),
    "b03_variables": case("shell", """
A=/a/«k»
export B="/b/«k»"
C='$A/c'
""", (C, 1, 0.85, "A", "/a/«k»"), (C, 2, 0.85, "B", "/b/«k»"), (C, 3, 0.7, "C", "$A/c")),
    "b04_dates": case("shell", """
D=$(date +%Y-%m-%d)
E=`date "+%Y%m%d"`
hdfs dfs -put x_«k» /in/«k»/$(date +%Y/%m)
""", (C, 1, 0.85, "D", "2026-03-05"), (C, 2, 0.85, "E", "20260305"), (W, 3, 0.7, "/in/«k»/2026/03", "hdfs")),
    "b05_date_arithmetic": case("shell", """
A=$(date -d "3 days ago" +%Y%m%d)
B=$(date -d "yesterday" +%Y%m%d)
C=$(date -d "+2 weeks" +%Y%m%d)
D=$(date -d "-1 month" +%Y%m%d)
""", (C, 1, 0.85, "A", "20260302"), (C, 2, 0.85, "B", "20260304"), (C, 3, 0.85, "C", "20260319"), (C, 4, 0.85, "D", "20260203")),
    "b06_dates_left_open": case("shell", """
D=$(date +%Y-%m-%d)
hdfs dfs -put x /in/«k»/$(date +%Y%m%d)
""", (C, 1, 0.7, "D", "{date:%Y-%m-%d}"), (W, 2, 0.7, "/in/«k»/{date:%Y%m%d}", "hdfs"), as_of=None),
    "b07_parameter_defaults": case("shell", """
A=${1:-/a/«k»}
B="${X:-${Y:-/b/«k»}}"
C=${A1:-${A2:-${A3:-${A4:-${A5:-${A6:-${A7:-/deep/«k»}}}}}}}
D=${Z:-$HOME}/d
""", (C, 1, 0.85, "A", "/a/«k»"), (C, 2, 0.85, "B", "/b/«k»"), (C, 3, 0.85, "C", "/deep/«k»"), (C, 4, 0.7, "D", "$HOME/d")),
    "b08_hdfs_copies": case("shell", """
hdfs dfs -get /g/«k» local
hadoop fs -put local /p/«k»
hdfs dfs -mv /m/«k» /n/«k»
hdfs dfs -copyFromLocal a /c/«k»
hdfs dfs -cat /t/«k» | wc -l
hdfs dfs -mkdir /x
""", (R, 1, 0.7, "/g/«k»", "hdfs"), (W, 2, 0.7, "/p/«k»", "hdfs"), (R, 3, 0.7, "/m/«k»", "hdfs"), (W, 3, 0.7, "/n/«k»", "hdfs"), (W, 4, 0.7, "/c/«k»", "hdfs"), (R, 5, 0.7, "/t/«k»", "hdfs")),
    "b09_distcp": case("shell", """
hadoop distcp -m 20 -update hdfs://x/a«k» hdfs://y/b«k»
""", (R, 1, 0.75, "hdfs://x/a«k»", "hdfs"), (W, 1, 0.75, "hdfs://y/b«k»", "hdfs")),
    "b10_scp": case("shell", """
scp user@host:/exp/«k».csv /tmp/
scp -P 22 out«k».csv user@host:/imp/
""", (R, 1, 0.7, "user@host:/exp/«k».csv", "sftp"), (W, 2, 0.7, "user@host:/imp/", "sftp")),
    "b11_sftp": case("shell", """
sftp u@h.example.com <<EOF
cd /out/«k»
get a.csv
put b.csv
mput *.txt
EOF
""", (R, 3, 0.65, "u@h.example.com:/out/«k»/a.csv", "sftp"), (W, 4, 0.65, "u@h.example.com:/out/«k»/b.csv", "sftp"), (W, 5, 0.65, "u@h.example.com:/out/«k»/*.txt", "sftp")),
    "b12_rsync": case("shell", """
rsync -avz u@h:/src/«k»/ /local/
rsync -a /local/ rsync://h/mod/«k»
""", (R, 1, 0.7, "u@h:/src/«k»/", "sftp"), (W, 2, 0.7, "rsync://h/mod/«k»", "sftp")),
    "b13_psql": case("shell", """
psql -h pg -d dw -c "\\\\copy (SELECT * FROM s.t«k» JOIN s.u«k» ON 1 = 1) to 'x.csv'"
""".replace("\\\\", "\\"), (R, 1, 0.65, "jdbc:postgresql://pg/dw#s.t«k»", "postgres"), (R, 1, 0.65, "jdbc:postgresql://pg/dw#s.u«k»", "postgres")),
    "b14_mysql": case("shell", """
mysqldump -h my shop t«k» u«k» > x.sql
mysql -h my <<EOF
SELECT * FROM shop.v«k»;
EOF
""", (R, 1, 0.7, "jdbc:mysql://my/shop#t«k»", "mysql"), (R, 1, 0.7, "jdbc:mysql://my/shop#u«k»", "mysql"), (R, 3, 0.65, "jdbc:mysql://my#shop.v«k»", "mysql")),
    "b15_oracle": case("shell", """
expdp u/p tables=A.T«k»,A.U«k» dumpfile=x
sqlplus -s u/p@db <<EOF
SELECT * FROM A.V«k»;
EOF
""", (R, 1, 0.7, "jdbc:oracle://unknown#A.T«k»", "oracle"), (R, 1, 0.7, "jdbc:oracle://unknown#A.U«k»", "oracle"), (R, 3, 0.6, "jdbc:oracle://unknown#a.v«k»", "oracle")),
    "b16_spark_submit": case("shell", """
spark-submit --master yarn --conf spark.a=b --class com.x.Main«k» app«k».jar --in /x
spark-submit --class com.x.Only«k»
""", (J, 1, 0.85, "app«k».jar", "spark-submit"), (J, 2, 0.85, "com.x.Only«k»", "spark-submit")),
    "b17_main_application": case("shell", """
spark-submit --py-files lib.py,b.zip --jars a.jar,b.jar --files conf.py jobs/etl_«k».py run.py
""", (J, 1, 0.85, "jobs/etl_«k».py", "spark-submit")),
    "b18_submit_options": case("shell", """
spark-submit --name="my job" --conf "spark.x=a b" --conf spark.y=z etl«k».py --d "2 3" | tee log
""", (J, 1, 0.85, "etl«k».py", "spark-submit")),
    "b19_hive": case("shell", """
hive -e "INSERT INTO TABLE m.t«k» SELECT * FROM r.s«k»"
hive -f load_«k».hql
beeline -u jdbc:hive2://h -e "SELECT * FROM b.q«k»"
beeline -u jdbc:hive2://h -f run_«k».sql
""", (J, 1, 0.75, "hive", "hive -e"), (W, 1, 0.75, "hive://m.t«k»", "hive"), (R, 1, 0.75, "hive://r.s«k»", "hive"), (J, 2, 0.8, "load_«k».hql", "hive -f"), (J, 3, 0.75, "beeline", "beeline -e"), (R, 3, 0.75, "hive://b.q«k»", "hive"), (J, 4, 0.8, "run_«k».sql", "beeline -f")),
    "b20_cron": case("shell", """
0 5 * * * spark-submit --master yarn a«k».py
*/10 * * * 1-5 /opt/run_«k».sh
@daily /opt/day_«k».py --x
# 1 1 * * * /gone.sh
""", (J, 1, 0.75, "a«k».py", "spark-submit"), (J, 2, 0.7, "/opt/run_«k».sh", "cron"), (J, 3, 0.7, "/opt/day_«k».py", "cron")),
}


def _nifi(*groups: str, contexts: str = "") -> str:
    return '{"parameterContexts": [%s],\n"flowContents": {"processors": [\n%s\n]}}' % (contexts, ",\n".join(groups))


def _unit(i: str, kind: str, **p: str) -> str:
    return '{"identifier": "%s", "name": "n%s", "type": "org.apache.nifi.%s", "config": {"properties": {%s}}}' % (i, i, kind, ", ".join(f'"{k.replace("_", " ")}": "{v}"' for k, v in p.items()))


FLOWS = {
    "n01_nested_groups": case("nifi", '{"flowContents": {"processors": [\n%s],\n"processGroups": [{"processors": [\n%s],\n"processGroups": [{"processors": [\n%s]}]}]}}' % (_unit("a", "GetHDFS", Directory="/a/«k»"), _unit("b", "PutHDFS", Directory="/b/«k»"), _unit("c", "FetchHDFS", HDFS_Filename="/c/«k»")),
        (R, 2, 0.75, "/a/«k»", "hdfs"), (W, 4, 0.75, "/b/«k»", "hdfs"), (R, 6, 0.75, "/c/«k»", "hdfs")),
    "n02_reading_processors": case("nifi", _nifi(
        _unit("a", "GetFile", Input_Directory="/f/«k»"), _unit("b", "GetSFTP", Hostname="h", Remote_Path="/s/«k»"), _unit("c", "ConsumeKafka_2_6", topic="t«k»"), _unit("d", "SelectHiveQL", Database_Name="d", Table_Name="T«k»"),
        _unit("e", "GetHBase", Table_Name="b«k»"), _unit("f", "GetMongo", Mongo_Database_Name="m", Mongo_Collection_Name="c«k»"), _unit("g", "QueryDatabaseTable", Table_Name="q«k»"), _unit("h", "ExecuteSQL", SQL_select_query="select * from s.e«k»"), _unit("i", "FetchS3Object", Bucket="u", Object_Key="o«k»"), _unit("j", "GetHTTP", URL="http://x/«k»")),
        (R, 3, 0.75, "/f/«k»", "file"), (R, 4, 0.75, "sftp://h/s/«k»", "sftp"), (R, 5, 0.75, "kafka://t«k»", "kafka"), (R, 6, 0.75, "hive://d.t«k»", "hive"), (R, 7, 0.75, "hbase://b«k»", "hbase"), (R, 8, 0.75, "mongodb://m/c«k»", "mongodb"), (R, 9, 0.75, "jdbc://q«k»", "jdbc"), (R, 10, 0.75, "jdbc://s.e«k»", "jdbc"), (R, 11, 0.75, "s3://u/o«k»", "s3"), (R, 12, 0.75, "http://x/«k»", "http")),
    "n03_writing_processors": case("nifi", _nifi(
        _unit("a", "PutFile", Directory="/f/«k»"), _unit("b", "PutSFTP", Hostname="h", Remote_Path="/s/«k»"), _unit("c", "PublishKafka_2_6", topic="t«k»"), _unit("d", "PutHiveStreaming", hive_database_name="d", hive_table_name="T«k»"), _unit("e", "PutHBaseCell", Table_Name="b«k»"), _unit("f", "PutMongo", Mongo_Database_Name="m", Mongo_Collection_Name="c«k»"), _unit("g", "PutDatabaseRecord", Table_Name="q«k»"),
        _unit("i", "PutS3Object", Bucket="u", Object_Key="o«k»"), _unit("j", "PostHTTP", URL="http://x/«k»"), _unit("k", "PutElasticsearchHttp", Index="x«k»")),
        (W, 3, 0.75, "/f/«k»", "file"), (W, 4, 0.75, "sftp://h/s/«k»", "sftp"), (W, 5, 0.75, "kafka://t«k»", "kafka"), (W, 6, 0.75, "hive://d.t«k»", "hive"), (W, 7, 0.75, "hbase://b«k»", "hbase"), (W, 8, 0.75, "mongodb://m/c«k»", "mongodb"), (W, 9, 0.75, "jdbc://q«k»", "jdbc"), (W, 10, 0.75, "s3://u/o«k»", "s3"), (W, 12, 0.75, "elasticsearch://x«k»", "elasticsearch")),
    "n04_parameter_contexts": case("nifi", _nifi(contexts='{"name": "c", "parameters": [\n{"name": "dir", "value": "/p/«k»"},\n{"name": "none"}]}'), (C, 2, 0.95, "dir", "/p/«k»")),
    "c01_format_dispatch": case("conf", """
a.b = /x/«k»
c: /y/«k»
""", (C, 1, 0.9, "a.b", "/x/«k»"), (C, 2, 0.9, "c", "/y/«k»")),
    "c02_flattened_json": case("json", '{"a": {"b": "/x/«k»", "c": null, "t": true},\n"l": [1, {"d": "v«n»"}]}', (C, 1, 0.9, "a.b", "/x/«k»"), (C, 1, 0.9, "a.t", "true"), (C, 2, 0.8, "l[0]", "1"), (C, 2, 0.9, "l[1].d", "v«n»")),
    "c02_flattened_yaml": case("yaml", """
job:
  name: etl_«k»
  inputs:
    - /in/«k»
    - path: /p/«k»
""", (C, 2, 0.9, "job.name", "etl_«k»"), (C, 3, 0.8, "job.inputs[0]", "/in/«k»"), (C, 5, 0.9, "job.inputs[1].path", "/p/«k»")),
    "c03_properties": case("properties", """
# comment=no
! other=no
in.path=/in/«k»
url = jdbc:x?a=b
k: v«n»
""", (C, 3, 0.9, "in.path", "/in/«k»"), (C, 4, 0.9, "url", "jdbc:x?a=b"), (C, 5, 0.9, "k", "v«n»")),
    "c04_xml": case("xml", """
<configuration>
<property><name>fs.default</name><value>hdfs://nn«k»</value></property>
<job id="j«k»"/>
</configuration>
""", (C, 2, 0.9, "fs.default", "hdfs://nn«k»"), (C, 3, 0.7, "job.id", "j«k»")),
}

CASES = PYSPARK | HIVE | SCALA | JAVA | SHELL | FLOWS
