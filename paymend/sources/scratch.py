"""Where jobs may put intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster every executor must see the folder, so the setting is required.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        key = context.applicationId
        if key not in _LOCAL_BASE:
            _LOCAL_BASE[key] = tempfile.mkdtemp(prefix="paymend-")
        base = _LOCAL_BASE[key]
    return f"{base.rstrip('/')}/paymend/{label}-{uuid.uuid4().hex}"


def home(spark: SparkSession, label: str) -> str:
    """The folder of a long-lived job: an absolute ``label`` itself, else a new scratch folder."""
    return label if "/" in label else scratch_dir(spark, label)


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write the frame once and read it back, cutting its lineage.

    The copy lives on shared storage, so a lost executor costs a re-read and
    not a re-run of everything before it.
    """
    path = scratch_dir(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
