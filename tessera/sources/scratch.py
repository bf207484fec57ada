"""Tables written in the cluster's shared folder, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` for this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        base = _local[0]
    return f"{base.rstrip('/')}/rounds-{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table below ``spark.checkpoint.dir`` and reads it back: a lost executor redoes what
    follows only. On a local master a temporary folder serves where the setting is unset; a cluster must set it."""
    def run(df: DataFrame) -> DataFrame:
        path = folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return run
