"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that
    setting gets one under the temporary directory."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rulespan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rulespan-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table there and read it again: its lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: str, most: int = 5_000) -> DataFrame:
    """``rows`` of a table dealt by ``key`` over tasks of about ``most`` rows each,
    for work that is heavy by row: a small table has one task or a few by its
    size, and partitions without a number are merged by their size again."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)
