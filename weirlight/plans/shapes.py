"""Relational and streaming shapes that analysed programs use, over the driver's tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from weirlight.plans.bridge import table
from weirlight.plans.registry import query
from weirlight.sources.storage import shared_dir
from weirlight.streaming import ingest

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _cents(c: str = "o_totalprice"):
    return F.round(F.col(c) * 100).cast("long")


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey")
def shape_full_outer_join(spark, d):
    """Both tables whole, on a key that gives each order one row."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def shape_semi_join(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def shape_anti_join(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def shape_broadcast_join(spark, d):
    """Nation and region are fixed tables of 25 and 5 rows; that bound is checked before they are broadcast."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    if places.limit(1001).count() <= 1000:
        places = F.broadcast(places)
    return table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("customers"))


@query(f"SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM (SELECT *, {_CENTS} // 1000000 AS bucket FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)")
def shape_ranking_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"))


@query(f"SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, CAST(sum({_CENTS}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum({_CENTS}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_seven FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def shape_analytic_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.sum(_cents()).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.sum(_cents()).over(w.rowsBetween(-6, 0)).alias("last_seven"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS k FROM orders) WHERE k = 1 GROUP BY o_custkey")
def shape_keep_latest(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM orders GROUP BY ALL HAVING count(*) > 20")
def shape_aggregate_having(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(_cents()).alias("cents")).where("n > 20")


@query("SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT c_nationkey)), ',') AS nations, round(stddev_samp(c_custkey), 4) AS spread FROM customer GROUP BY c_mktsegment")
def shape_collect_and_stddev(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("c_nationkey")), ",").alias("nations"), F.round(F.stddev_samp("c_custkey"), 4).alias("spread"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, true AS median_near, true AS customers_near FROM orders GROUP BY o_orderstatus")
def shape_approximate(spark, d):
    """Approximate figures beside exact ones: the median's rank is off by 1 in 1,000 at most, the distinct count by 15 % (three standard errors)."""
    orders = table(spark, d, "orders")
    near = orders.groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", 0.5, 1000).alias("median"), F.approx_count_distinct("o_custkey").alias("about"))
    exact = orders.join(near, "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") < F.col("median")).alias("below"), F.count_if(F.col("o_totalprice") <= F.col("median")).alias("upto"), F.max("about").alias("about"))
    off = F.col("n") * 0.001 + 1
    return exact.select("o_orderstatus", "n", "customers", ((F.col("below") <= F.col("n") / 2 + off) & (F.col("upto") >= F.col("n") / 2 - off)).alias("median_near"), (F.abs(F.col("about") - F.col("customers")) <= F.col("customers") * 0.15).alias("customers_near"))


@query("SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
def shape_top_k(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size", "p_partkey").orderBy(F.desc("p_size"), "p_partkey").limit(25)


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 100 + k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def shape_set_operations(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(s)
    return both.union(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(s).select((F.col("k") + 100).alias("k")))


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE n > (SELECT avg(n) FROM big)")
def shape_cte_and_subquery(spark, d):
    for n in ("orders", "customer"):
        table(spark, d, n).createOrReplaceTempView(f"w_{n}")
    return spark.sql("WITH big AS (SELECT o_custkey, count(*) AS n FROM w_orders GROUP BY o_custkey) SELECT c_custkey, n FROM w_customer JOIN big ON c_custkey = o_custkey WHERE n > (SELECT avg(n) FROM big)")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS v, p_partkey % 3 = 0 AS changed FROM part UNION ALL SELECT -p_partkey, p_size, true FROM part WHERE p_partkey % 50 = 0")
def shape_merge(spark, d):
    """What a merge gives: matched rows updated, others kept, new ones added."""
    old = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    new = old.where("k % 3 = 0").select("k", (F.col("v") + 1).alias("nv")).unionByName(old.where("k % 50 = 0").select((-F.col("k")).alias("k"), F.col("v").alias("nv")))
    return old.join(new, "k", "full").select("k", F.coalesce("nv", "v").alias("v"), F.col("nv").isNotNull().alias("changed"))


@query("SELECT k, CAST(k * (k + 1) // 2 AS BIGINT) AS total FROM (SELECT unnest(range(1, 51)) AS k)")
def shape_recursion(spark, d):
    return spark.sql("WITH RECURSIVE r(k, total) AS (SELECT 1L, 1L UNION ALL SELECT k + 1, total + k + 1 FROM r WHERE k < 50) SELECT * FROM r")


@query("SELECT p_partkey, upper(trim(p_brand)) AS brand, regexp_extract(p_brand, '([0-9]+)', 1) AS number, length(p_name) AS n FROM part")
def shape_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(F.trim("p_brand")).alias("brand"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"), F.length("p_name").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(CAST(o_orderdate AS DATE) - 30 AS VARCHAR) AS before FROM orders")
def shape_dates(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.datediff(day, F.lit("1990-01-01").cast("date")).cast("long").alias("days"), F.date_sub(day, 30).cast("string").alias("before"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'good' END AS state, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def shape_conditions(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(b < 0, "debt").when(b < 1000, "low").otherwise("good").alias("state"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def shape_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_type, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS total, count(*) AS n, CAST(count(*) FILTER (value > 50) AS BIGINT) AS high FROM events GROUP BY event_type")
def shape_pandas_udf(spark, d):
    @F.pandas_udf("boolean")
    def is_high(v: pd.Series) -> pd.Series:
        return v > 50

    e = table(spark, d, "events").withColumn("h", is_high("value"))
    return e.groupBy("event_type").agg(F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total"), F.count("*").alias("n"), F.count_if("h").alias("high"))


_WINDOWED = "SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS window_start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL"


@query(_WINDOWED)
def shape_tumbling_window(spark, d):
    return ingest.windowed(table(spark, d, "events"))


@query("SELECT count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events")
def shape_stream(spark, d):
    """The events as a stream of files, run to its end into a Parquet sink with a checkpoint."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    done = ingest.drained(ingest.event_stream(spark, f"{d}/events.parquet"), f"{at}/out", f"{at}/checkpoint")
    return done.agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("SELECT n_name, event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def shape_stream_static_join(spark, d):
    """A stream of events joined with tables that stand still, then counted over what it wrote."""
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = ingest.event_stream(spark, f"{d}/events.parquet").join(people, F.col("user_id") == F.col("c_custkey")).select("event_id", "event_type", "n_name")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return ingest.drained(joined, f"{at}/out", f"{at}/checkpoint").groupBy("n_name", "event_type").agg(F.count("*").alias("n"))


@query("SELECT 'open' AS part, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'done', o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def shape_multiple_insert(spark, d):
    """One scan written to two targets, as FROM ... INSERT ... INSERT does: a written table partitioned by target, read by each."""
    orders = table(spark, d, "orders")
    target = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done")
    at = f"{shared_dir(spark)}/insert-{uuid.uuid4().hex}"
    orders.select(target.alias("part"), "o_orderkey").where("part is not null").write.partitionBy("part").parquet(at)
    own = lambda p: spark.read.parquet(f"{at}/part={p}").select(F.lit(p).alias("part"), "o_orderkey")
    return own("open").unionByName(own("done"))


_GAPS = "SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events"


@query(f"SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ({_GAPS})) GROUP BY user_id, s")
def shape_session_windows(spark, d):
    return ingest.sessions(table(spark, d, "events"))
