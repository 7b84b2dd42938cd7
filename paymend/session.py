"""Session settings the jobs expect."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings: one time zone for all engines, adaptive plans, skew splitting."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paymend")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture for every column function makes wide plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ship(spark: SparkSession) -> str:
    """Send this package to the executors, for clusters where it is not installed.

    The archive is fetched by every executor, also by one that joins later. Returns its path.
    """
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="paymend-")) / package.name
    archive = shutil.make_archive(str(base), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    return archive
