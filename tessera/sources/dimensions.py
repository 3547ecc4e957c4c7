"""Dimensions of makes and models from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "make string, models array<struct<key: int, model: string>>"


def makes(texts: DataFrame) -> DataFrame:
    """``make, key, model`` of JSON objects (json), one row a model; other texts and makes without models give none."""
    return texts.select(F.from_json("json", SCHEMA).alias("j")).select("j.make", F.inline("j.models"))


def read_makes(spark: SparkSession, path: str) -> DataFrame:
    """``makes`` of files that hold one object or a list of them."""
    return makes(spark.read.schema(SCHEMA).option("multiLine", "true").json(path).select(F.to_json(F.struct("make", "models")).alias("json")))
