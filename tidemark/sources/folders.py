"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where the session names none, a local one, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: computed once, whoever reads it and however often."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def share_code(spark: SparkSession) -> None:
    """Workers find this package where the driver did, should it not be installed; elsewhere, ship it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
