"""Shared pieces: checkpoints in the cluster's shared folder and small SQL fragments."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at ``spark.checkpoint.dir``; where that is unset, at a temporary folder on one machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and go on from there, so that a lost executor costs no rerun."""
    use_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def shuffled(frame: DataFrame) -> DataFrame:
    """``frame`` as a side of a join that is by sort and merge, whatever Spark thinks of its size.

    Spark broadcasts a side by an estimate that takes no account of the rows that
    ``explode`` or a Python function adds, and the driver holds what is broadcast.
    """
    return frame.hint("merge")
