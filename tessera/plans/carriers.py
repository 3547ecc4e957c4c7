"""The engine's tables as views of the driver's, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrays import cells_of


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 arrays; the label is the folder."""
    return cells_of(read(spark, sf_dir, "embeddings").withColumnRenamed("label", "folder"), "vec_id", "embedding", 8, "folder")


def next_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each array's next one under its own number: a second version."""
    return cells(spark, sf_dir).withColumn("array_id", F.col("array_id") - 1)


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with raw integers at a scale of 0.001."""
    return cells(spark, sf_dir).withColumn("raw", F.round(F.col("value") * 1000).cast("long"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: one a user, time in milliseconds."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("channel"), "value", "event_id")


CELLS = "cells AS (SELECT vec_id AS array_id, label AS folder, CAST(i - 1 AS INTEGER) AS pos, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i))"
RAW = CELLS + ", raw_cells AS (SELECT *, CAST(round(value * 1000) AS BIGINT) AS raw FROM cells)"
PAIR = CELLS + ", pair AS (SELECT a.array_id, a.row, a.col, a.value, b.value AS other, b.value - a.value AS delta, abs(b.value - a.value) > 1e-9 AS changed FROM cells a JOIN cells b ON b.array_id = a.array_id + 1 AND a.row = b.row AND a.col = b.col)"
SAMPLES = "samples AS (SELECT user_id AS log_id, epoch_us(ts) // 1000 AS t, event_type AS channel, value, event_id FROM events)"
