"""Relational queries on the star schema and the event stream: joins, windows, sets, as-of lookups, time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.operators import timeline
from twinscript.queries import register
from twinscript.session import shared_folder
from twinscript.sources.tables import table
from twinscript.streaming import events as ev


@register("price_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def price_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= timestamp '1998-09-02'")
    return r.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@register("nation_revenue", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as orders from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey join nation on c_nationkey = n_nationkey group by 1")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    """The lines are summed by order before they meet the customers, so the wide join moves one row for each order."""
    per = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").join(per, "o_orderkey")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_custkey", "o_custkey")
    n = table(spark, d, "nation", "n_nationkey", "n_name").withColumnRenamed("n_nationkey", "c_nationkey")
    return o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))


@register("order_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def order_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderstatus", "o_orderpriority").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("customer_ranks", "select c_custkey, rank() over w as r, dense_rank() over w as dr, ntile(4) over (partition by c_nationkey order by c_acctbal desc, c_custkey) as q from customer window w as (partition by c_nationkey order by c_acctbal desc)")
def customer_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").select("c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("q"))


@register("order_frames", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last_three, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders")
def order_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.lag("o_orderkey").over(w).alias("before"))


@register("idle_customers", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def idle_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer", "c_custkey").join(urgent, "c_custkey", "left_anti")


@register("shared_nations", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def shared_nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_nationkey").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("k")))


@register("unsold_parts", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity >= 40")
def unsold_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that were never sold in bulk."""
    bulk = table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 40").select(F.col("l_partkey").alias("k")).distinct()
    return table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("k")).exceptAll(bulk)


@register("order_pivot", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def order_pivot(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return g.select("o_orderpriority", *(F.coalesce(s, F.lit(0)).cast("bigint").alias(s.lower()) for s in "FOP"))


_SPANS = "select user_id, epoch_us(ts) // 1000 as a, epoch_us(ts) // 1000 + cast(floor(value * 1000) as bigint) as b from events where value > 0"
_UNION = f"with s as ({_SPANS}), m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as p from s), i as (select *, sum(case when p is null or a > p then 1 else 0 end) over (partition by user_id order by a, b rows between unbounded preceding and current row) as k from m), u as (select user_id, k, min(a) as a, max(b) as b from i group by 1, 2)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "user_id", "ts", "value").where("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", F.unix_millis("ts").alias("a"), (F.unix_millis("ts") + F.floor(F.col("value") * 1000).cast("bigint")).alias("b"))


@register("interval_union", f"{_UNION} select user_id, a, b from u")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return timeline.interval_union(_spans(spark, d), ["user_id"], "a", "b")


@register("covered_time", f"{_UNION} select user_id, count(*) as islands, cast(sum(b - a) as bigint) as covered from u group by 1")
def covered_time(spark: SparkSession, d: str) -> DataFrame:
    return timeline.covered_length(_spans(spark, d), ["user_id"], "a", "b")


@register("last_purchase", "select e.event_id, p.value as last_value from (select event_id, user_id, ts from events where event_type <> 'purchase') e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts")
def last_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return timeline.as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), buys, "user_id", "ts", "value").select("event_id", F.col("value").alias("last_value"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


@register("tumbling_counts", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(_events(spark, d), "1 hour", "event_type").withColumn("total", F.round("total", 4))


@register("sliding_counts", "select time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as start, count(*) as n from events, (select unnest([0, 1]) as k) group by 1")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding(_events(spark, d), "1 hour", "30 minutes")


@register("session_counts", "with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minutes then 1 else 0 end as s from events window w as (partition by user_id order by ts)), i as (select *, sum(s) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, min(ts) as start, count(*) as n from i group by user_id, k")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(_events(spark, d), "30 minutes", "user_id")


@register("stream_by_type", "select event_type, count(distinct event_id) as n from events group by 1")
def stream_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The table read as a stream, without repeats, written batch by batch through the resumable sink, then counted."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(d, pathGlobFilter="events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ev.run_once(ev.distinct_events(stream, "event_id", late="3650 days"), f"{base}/checkpoint", ev.partition_writer(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@register("late_events", "select time_bucket(interval 1 hour, ts) as start, count(*) as n from events where event_id % 7 <> 0 group by 1")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events counted by hour as a stream in two arrivals; a seventh of them comes with the second, long after the watermark has passed, and is dropped."""
    base = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    rows = table(spark, d, "events", "event_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg(F.max("ts")).first()[0]
    # the first arrival ends with an event far ahead, which moves the watermark beyond all others
    ahead = spark.createDataFrame([(-1, last)], "event_id bigint, ts timestamp").withColumn("ts", F.expr("ts + interval 30 days"))
    arrivals = [rows.where("event_id % 7 <> 0").unionByName(ahead), rows.where("event_id % 7 = 0"), ahead.withColumn("ts", F.expr("ts + interval 30 days"))]
    out = f"{base}/out"
    for k, arrival in enumerate(arrivals):
        arrival.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(arrival.schema).parquet(f"{base}/in")
        counted = ev.tumbling(stream.withColumn("value", F.lit(0.0)), "1 hour", late="1 day").select("start", "n")
        counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, n bigint").parquet(out).where(F.col("start") <= F.lit(last))


@register("polled_orders", "select o_orderstatus, count(*) as n, count(distinct o_custkey) as customers from orders group by 1")
def polled_orders(spark: SparkSession, d: str) -> DataFrame:
    """A folder polled three times while files arrive: each poll takes what is new, and what it wrote before stays as it is."""
    base = f"{shared_folder(spark)}/polled-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    for k in range(3):
        rows.where(F.pmod("o_orderkey", F.lit(3)) == k).write.mode("append").parquet(f"{base}/in")
        ev.run_once(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/checkpoint", ev.partition_writer(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@register("approximate_users", "select event_type, true as near from events group by 1")
def approximate_users(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users by event type from mergeable sketches of each hour, against the exact count: within a tenth."""
    e = table(spark, d, "events", "event_type", "ts", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.hll_sketch_agg("user_id").alias("s"))
    merged = hourly.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("about"))
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return merged.join(exact, "event_type").select("event_type", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("near"))


@register("running_totals", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id), 4) as total from events")
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"))
