"""Relational queries over the star schema and the events: joins, windows, grouping sets, sets, top-k, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quernel.operators.joins import as_of, in_range
from quernel.operators.ordering import stretches
from quernel.session import own_folder, table
from quernel.streaming.watch import windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query, with its SQL if SQL can express it."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _money(c):  # noqa: ANN001, ANN202
    return c.cast("decimal(18,4)")


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,4))) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as sum_base,
cast(sum(cast(l_extendedprice as decimal(18,4)) * (1 - cast(l_discount as decimal(18,4)))) as double) as sum_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums by flag and status of lines shipped up to a day."""
    price, less = _money(F.col("l_extendedprice")), _money(F.col("l_discount"))
    total = lambda c, n: F.sum(c).cast("double").alias(n)
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(total(_money(F.col("l_quantity")), "sum_qty"), total(price, "sum_base"), total(price * (1 - less), "sum_disc"), F.count("*").alias("n"))


@query("""select o_orderkey, o_orderdate, cast(sum(cast(l_extendedprice as decimal(18,4)) * (1 - cast(l_discount as decimal(18,4)))) as double) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' group by 1, 2 order by revenue desc, o_orderkey limit 10""")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The ten orders of a segment with most revenue: a report of top ten."""
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", (_money(F.col("l_extendedprice")) * (1 - _money(F.col("l_discount")))).alias("v"))
    by_order = lines.groupBy("l_orderkey").agg(F.sum("v").cast("double").alias("revenue"))
    return o.join(by_order, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "revenue").orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""select n_name, cast(sum(cast(l_extendedprice as decimal(18,4)) * (1 - cast(l_discount as decimal(18,4)))) as double) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1""")
def local_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation of a region where customer and supplier are of one nation: five joins, ordered by Catalyst."""
    t = lambda n: table(spark, d, n)
    nations = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    rows = t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(F.sum(_money(F.col("l_extendedprice")) * (1 - _money(F.col("l_discount")))).cast("double").alias("revenue"))


@query("select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a returned line, by priority."""
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("select c_mktsegment, count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') group by 1")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order in part, by segment."""
    c = table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""with r as (select user_id, epoch_us(ts) as low, epoch_us(ts) + 3600000000 as high from events where event_type = 'purchase'), p as (select user_id, event_id, epoch_us(ts) as pos from events where event_type = 'view')
select event_id, count(*) as n from p join r on p.user_id = r.user_id and pos >= low and pos < high group by 1""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Views within the hour after a purchase of the same user."""
    e = table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ranges = e.filter("event_type = 'purchase'").select("user_id", micros.alias("low"), (micros + 3_600_000_000).alias("high"))
    points = e.filter("event_type = 'view'").select("user_id", "event_id", micros.alias("at"))
    return in_range(points, ranges, ["user_id"], "at", "low", "high", 3_600_000_000.0).groupBy("event_id").agg(F.count("*").alias("n"))


@query("""with p as (select user_id, ts, event_id as purchase from events where event_type = 'purchase') select v.event_id, (select max_by(purchase, (ts, purchase)) from p where p.user_id = v.user_id and p.ts <= v.ts) as purchase from events v where event_type = 'error'""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """For each error the user's last purchase at or before it."""
    e = table(spark, d, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase"))
    return as_of(e.filter("event_type = 'error'").select("user_id", "ts", "event_id"), bought, ["user_id"], "ts", "bought_at", ["purchase"]).select("event_id", "purchase")


@query("""select user_id, count(*) as sessions, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (
select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 hour then 0 else 1 end as new from events)) group by 1, 2) group by 1""")
def sessionized_events(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a user's events without a gap of two hours."""
    parts = stretches(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 7200)
    return parts.groupBy("user_id", "stretch").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("select event_type, cast(date_trunc('hour', ts) as timestamp) as hour, count(*) as events from events group by 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by type in windows of an hour."""
    e = table(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("events"))
    return e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "events")


@query("select c_mktsegment, o_orderpriority, count(*) as n, cast(grouping(c_mktsegment, o_orderpriority) as bigint) as level from orders join customer on o_custkey = c_custkey group by cube (c_mktsegment, o_orderpriority)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    """Orders by segment and priority in all combinations."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("select l_suppkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey, l_linenumber) as k from lineitem) where k <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three largest lines of each supplier."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("select k, bool_or(a) as in_orders, bool_or(b) as in_events from (select distinct o_custkey as k, true as a, false as b from orders union all select distinct user_id, false, true from events) group by 1")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Union of two key sets with which of them each key is in: intersection and differences in one pass."""
    side = lambda df, c, a: df.select(F.col(c).alias("k"), F.lit(a).alias("a"), F.lit(not a).alias("b")).distinct()
    both = side(table(spark, d, "orders"), "o_custkey", True).unionByName(side(table(spark, d, "events"), "user_id", False))
    return both.groupBy("k").agg(F.max("a").alias("in_orders"), F.max("b").alias("in_events"))


@query("select user_id, cast(sum(cast(props->>'$.k' as bigint)) as bigint) as k, count(*) as n from events group by 1")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Sums over a field of JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("select event_type, cast(date_trunc('hour', ts) as timestamp) as hour, count(*) as events from events group by 1, 2")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the events as a stream with a watermark, closed by a last event of far in the future; its results and its state lie in the shared folder."""
    path = own_folder(spark, "windows")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{path}/in/a")
    last = events.limit(1).withColumn("ts", F.lit("2200-01-01 00:00:00").cast("timestamp")).withColumn("event_type", F.lit(None).cast("string"))
    source = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
    hours = windowed_counts(source).select("event_type", F.col("span.start").cast("timestamp_ntz").alias("hour"), "events")
    for k in range(3):  # the events, the last event, and the batch without rows in which it closes all windows before it
        sink = hours.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        sink.start(f"{path}/out").awaitTermination()
        if k == 0:
            last.write.parquet(f"{path}/in/b")
    return spark.read.schema(hours.schema).parquet(f"{path}/out")
