"""Tables of the data folder, and the entity views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer's segment and region; target: total price."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
        .select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name", F.month("o_orderdate").alias("month"), "c_acctbal", "o_totalprice", (F.col("o_totalprice") >= 250000).alias("pricey"))
    )


def lineitem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; it has no key, so it is only ever scored by counts of signatures."""
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice")


def embeddings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst): a customer's nation that ordered from a supplier's nation."""
    o, c, li, s = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "supplier"))
    pairs = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"])
    return pairs.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def trade_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, region, balance, role) of customers (even vid) and suppliers (odd)."""
    where = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    out = None
    for table, role, rest in (("customer", "c", 0), ("supplier", "s", 1)):
        key = {"c": "c_custkey", "s": "s_suppkey"}[role]
        own = read(spark, sf_dir, table).join(where, F.col(f"{role}_nationkey") == F.col("n_nationkey"))
        own = own.select((F.col(key).cast("long") * 2 + rest).alias("vid"), "region", F.col(f"{role}_acctbal").alias("balance"), F.lit(table).alias("role"))
        out = own if out is None else out.unionByName(own)
    return out


def customer_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each customer with each supplier of a line item of their orders, as often as they meet."""
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    pairs = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return pairs.select((F.col("o_custkey").cast("long") * 2).alias("src"), (F.col("l_suppkey").cast("long") * 2 + 1).alias("dst"))
