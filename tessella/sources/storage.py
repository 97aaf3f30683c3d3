"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; where it is not set, and
    driver and executors are one process, a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str = "land") -> DataFrame:
    """df written as Parquet and read back: computed once, whatever reads it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
