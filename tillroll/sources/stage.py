"""Stages: intermediate rows written once to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import ensure_checkpoint_dir


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. All stages of an application lie under one folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillroll-stages-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Cuts the lineage like ``checkpoint()``, but computes the rows once only,
    keeps columns apart, and gives the planner their size; a lost executor re-reads the files.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
