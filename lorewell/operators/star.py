"""Generic relational coverage over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorewell.sources.tables import table


def pricing_summary(s, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(s, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def star_join(s, d):
    """Revenue by the customers' nation and region."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(price), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def rollup_orders(s, d):
    o = table(s, d, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    return o.rollup("year", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


def cube_parts(s, d):
    return table(s, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"))


def top_orders(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def idle_customers(s, d):
    big = table(s, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(big, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def buying_customers(s, d):
    big = table(s, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


def set_operations(s, d):
    a, b = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "only_customers")).union(tag(a.union(b).distinct(), "any"))


def as_of_orders(s, d):
    """For each shipped line the number of days since its customer's latest order before it: an as-of join by windows."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"))
    l = table(s, d, "lineitem").join(o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("o_custkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"))
    both = l.select("o_custkey", "at", "l_orderkey", "l_linenumber", F.lit(None).cast("timestamp_ntz").alias("order_at")).unionByName(o.select("o_custkey", "at", F.lit(None).cast("long").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), F.col("at").alias("order_at")))
    w = Window.partitionBy("o_custkey").orderBy("at", F.col("order_at").asc_nulls_last(), "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("latest", F.last("order_at", ignorenulls=True).over(w)).filter("l_orderkey IS NOT NULL").groupBy(F.datediff("at", "latest").cast("long").alias("days")).agg(F.count("*").alias("n"))


def events_by_type(s, d):
    return table(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "view"]).agg(F.count(F.lit(1))).fillna(0)


QUERIES = {f.__name__: f for f in (pricing_summary, star_join, rollup_orders, cube_parts, top_orders, idle_customers, buying_customers, set_operations, as_of_orders, events_by_type)}
SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "star_join": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "rollup_orders": "SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(year(o_orderdate), o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)",
    "cube_parts": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)",
    "top_orders": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "idle_customers": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1",
    "buying_customers": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1",
    "set_operations": "SELECT 'both' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only_customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "as_of_orders": "WITH l AS (SELECT o_custkey, l_shipdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.at AS DATE)) AS days, count(*) AS n FROM l ASOF LEFT JOIN orders o ON l.o_custkey = o.o_custkey AND l.at >= o.o_orderdate GROUP BY 1",
    "events_by_type": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
}
