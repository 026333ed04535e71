"""Making the package importable where Spark's Python workers run, and how its joins are planned."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Lets workers of a local session import this package from wherever the driver was started.

    On a cluster the package is installed, or sent with --py-files.
    """
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    return spark


def measured(spark: SparkSession) -> SparkSession:
    """Joins of this session broadcast a side by what it was found to hold when it ran, not by its files' sizes.

    Names compress to a hundredth and a row gives dozens of triples, so a few MB of Parquet may be GB of rows,
    which the driver would collect to broadcast them. What is broadcast by a hint stays so.
    """
    if (size := spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", size)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark
