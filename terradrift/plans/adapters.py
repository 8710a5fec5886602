"""The point model over the driver's tables. Integer arithmetic and one division keep doubles alike in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as points."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source_file"),
        k.cast("string").alias("pid"),
        (44 + (k * 104729 % 3000) / 1000).alias("latitude"),
        (6 + (k * 7919 % 8000) / 1000).alias("longitude"),
        F.when(k % 50 == 0, None).otherwise(k * 37 % 720 - 180).cast("double").alias("track_angle"),
        (k * 31 % 1000 / 1000).alias("temporal_coherence"),
        ((F.col("c_acctbal") - 4500) / 500).alias("mean_velocity"),
        F.when(k % 7 == 0, None).otherwise(F.col("c_mktsegment")).alias("class_1"),
    )


def with_orbit(df: DataFrame) -> DataFrame:
    from terradrift.functions.scalars import orbit

    return df.withColumn("orbit", orbit(F.col("track_angle")))


def long_series(spark: SparkSession, sf_dir: str, kind: str = "supplier") -> DataFrame:
    """lineitem as monthly series by supplier or part, events as daily series by user; months and
    days without a value are null rows, as in a wide file."""
    if kind == "user":
        e = table(spark, sf_dir, "events")
        rows = e.groupBy(F.col("user_id").cast("string").alias("pid"), F.to_date("ts").alias("acq_date")).agg(F.sum("value").alias("disp"))
    else:
        li = table(spark, sf_dir, "lineitem")
        key = "l_suppkey" if kind == "supplier" else "l_partkey"
        rows = li.groupBy(F.col(key).cast("string").alias("pid"), F.trunc("l_shipdate", "month").alias("acq_date")).agg((F.avg("l_extendedprice") / 1000).alias("disp"))
    grid = rows.select("pid").distinct().crossJoin(F.broadcast(rows.select("acq_date").distinct()))  # the date axis: a row a date
    return grid.join(rows, ["pid", "acq_date"], "left").select(F.lit(kind).alias("source_file"), "pid", "acq_date", "disp")


def cluster_points(spark: SparkSession, sf_dir: str, kind: str = "customer") -> DataFrame:
    if kind == "customer":
        k = F.col("c_custkey")
        return table(spark, sf_dir, "customer").select(k.alias("idx"), (k * 7919 % 2000).cast("double").alias("e"), (k * 104729 % 2000).cast("double").alias("n"), ((F.col("c_acctbal") - 4500) / 500).alias("v"), (k * 31 % 1000 / 1000).alias("coherence"), F.col("c_mktsegment").alias("class_1"))
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (k * 7919 % 5000).cast("double").alias("e"), (k * 104729 % 5000 + F.col("o_orderkey") % 97).cast("double").alias("n"), ((F.col("o_totalprice") - 250000) / 20000).alias("v"), F.lit(1.0).alias("coherence"), F.col("o_orderpriority").alias("class_1"))


def vectors(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """embeddings as feature rows of one file."""
    names = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(width)]
    return table(spark, sf_dir, "embeddings").select(F.lit("embeddings").alias("source_file"), F.col("vec_id").cast("string").alias("pid"), F.col("label").cast("string").alias("rule"), *names)


def rule_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as feature rows that reach every rule and flag; some features are missing."""
    k, n = F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.col("l_partkey")
    f = {
        "v_robust": F.when(k % 41 == 0, None).otherwise((k * 7919 % 2001 - 1000) / 100),
        "v_diff": F.when(k % 17 == 0, None).otherwise((k * 104729 % 1001 - 500) / 100),
        "rmse_detrended": (n * 31 % 600) / 100,
        "rmse_deseason": (n * 37 % 800) / 100,
        "seasonal_r2": F.when(k % 13 == 0, None).otherwise((n * 41 % 400) / 1000),
        "quad_coeff": (k * 613 % 801 - 400) / 100,
        "quad_r2": (k * 211 % 200) / 1000,
        "n_jumps": (n % 3).cast("double"),
        "jump_max_mm": (n * 43 % 1200) / 100,
        "cusum_score": (n * 47 % 500) / 100,
        "velocity_r2": (k * 307 % 1000) / 1000,
    }
    return table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("source_file"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pid"), *[e.cast("double").alias(c) for c, e in f.items()])
