"""Cutting lineage on storage that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of this session: ``spark.checkpoint.dir``, or in local mode, where it is unset, a new folder."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="textward-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and kept on shared storage, so that a lost executor costs no recomputation.

    A written table, unlike a checkpoint, also brings the true size of the data into later plans: the estimates that
    a checkpoint carries along multiply with every join of an iteration, until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
