"""The star-schema test tables as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def node(kind: str, *keys: str) -> Column:
    return F.concat_ws("/", F.lit(kind), *[F.col(k).cast("string") for k in keys])


def _edges(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions, and names."""
    t = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier")}
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return (
        _edges(t["customer"], node("customer", "c_custkey"), "inNation", node("nation", "c_nationkey"))
        .union(_edges(t["supplier"], node("supplier", "s_suppkey"), "inNation", node("nation", "s_nationkey")))
        .union(_edges(t["nation"], node("nation", "n_nationkey"), "inRegion", node("region", "n_regionkey")))
        .union(_edges(t["nation"], node("nation", "n_nationkey"), "name", quoted("n_name")))
        .union(_edges(t["region"], node("region", "r_regionkey"), "name", quoted("r_name")))
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with who placed them and which suppliers sold."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    placed = _edges(orders, node("order", "o_orderkey"), "placedBy", node("customer", "o_custkey"))
    return placed.union(_edges(lines, node("order", "l_orderkey"), "soldBy", node("supplier", "l_suppkey")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation to its next."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    pairs = c.join(following, ["conv_id", "turn"], "left_semi")
    return _edges(pairs, node("conv", "conv_id", "turn"), "next", F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event type directly follows which for the same user."""
    e = _table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = e.select("event_type", F.lag("event_type").over(w).alias("before")).filter(F.col("before").isNotNull()).select("before", "event_type").distinct()
    return _edges(pairs, node("type", "before"), "followedBy", node("type", "event_type"))


def people(spark: SparkSession, persons: int = 1000, acquaintances: int = 2000) -> DataFrame:
    """An invented graph of fixed size: who knows whom, which has long cycles, and who is whose parent, a forest."""
    i = F.col("id")
    person = lambda k: F.concat(F.lit("person/"), k.cast("string"))
    knows = spark.range(acquaintances).select(person(i % persons).alias("s"), F.lit("knows").alias("p"), person((i * 7919 + (i * i) % 10007 * 31 + 13) % persons).alias("o"))
    parents = spark.range(2, persons).filter(i % 3 == 0).select(person(i - 1 - (i * 31) % 17 % (i - 1)).alias("s"), F.lit("parentOf").alias("p"), person(i).alias("o"))
    return knows.union(parents)
