"""Pulses, points, waveforms and ordered records as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETURN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*RETURN_ORDER))
    return t.select(
        F.col("l_orderkey").alias("pulse_id"),
        nth.alias("return_number"),  # pruned, with its shuffle, where it isn't used
        ((F.col("l_partkey") % 800) * 0.125).alias("x"),
        ((F.col("l_suppkey") % 100) * 0.5 + F.col("l_linenumber") * 0.125).alias("y"),
        F.col("l_quantity").alias("z"),
        F.col("l_linenumber").alias("classification"),
        F.col("l_extendedprice").alias("intensity"),
    )


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(
        F.col("o_orderkey").alias("pulse_id"),
        ((F.col("o_custkey") % 720) * 0.5).alias("azimuth"),
        ((F.col("o_orderkey") % 240) * 0.375).alias("zenith"),
        F.floor(F.col("o_orderkey") / 100).alias("scanline"),
        (F.col("o_orderkey") % 100).alias("scanline_idx"),
        F.lit(0.0).alias("x_origin"),
        F.lit(0.0).alias("y_origin"),
        F.lit(1.5).alias("z_origin"),
    )


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("pulse_id"), F.col("embedding").alias("received"), F.lit(4.0).alias("gain"), F.lit(-1.0).alias("offset"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
