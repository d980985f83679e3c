"""Relational queries on the star schema: the shapes of joins, sorts, limits and set operations that reports use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.session import table


@query("""SELECT n_name, c_mktsegment, count(*) AS orders, sum(o_totalprice)::DECIMAL(20,2)::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.sum("o_totalprice").cast("decimal(20,2)").cast("double").alias("total"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS quantity, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("quantity"), F.count("*").alias("lines"))


@query("""SELECT c_mktsegment, c_custkey, rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) x WHERE rank <= 10""")
def best_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten in each segment."""
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", rank.cast("bigint").alias("rank")).where("rank <= 10")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti")


@query("""SELECT s_nationkey AS nation, 'supplier' AS side, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT c_nationkey, 'customer', count(*) FROM customer GROUP BY ALL""")
def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("nation")).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count("supplier", "s_nationkey").unionByName(count("customer", "c_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def parts_never_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey").exceptAll(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct())


@query("""SELECT p_partkey, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END), max(l_suppkey)) AS supplier FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def preferred_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered fallback: a supplier with returns, else any."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    chosen = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.coalesce(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))), F.max("l_suppkey")).alias("supplier"))
    return chosen.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "left_semi")
