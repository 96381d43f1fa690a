"""Readers for the parquet tables the jobs consume.

Reads are lazy; Catalyst prunes columns and pushes filters into the scan, so
callers select what they need and never ask for ``*`` downstream.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return balanced(spark.read.parquet(os.path.join(base, f"{name}.parquet")))


def balanced(df: DataFrame) -> DataFrame:
    """Spread an under-split input over the cluster's cores.

    A file written as one row group is one scan task, and the row-wise text
    work downstream (regexes, JSON) would run on one core. When the scan has
    fewer splits than the default parallelism, add a round-robin
    redistribution; a large input (many files / row groups) already has
    enough splits and is returned unchanged, with no extra shuffle. Planning
    the scan to count its splits runs no job.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
