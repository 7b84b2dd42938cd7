"""What streaming jobs keep between micro-batches: small tables on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F

from paymend.sources import files
from paymend.sources.scratch import home

#: Parts that pile up before they are merged.
MERGE_EVERY = 8


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    found = (n.removeprefix(prefix) for n in files.names(spark, path) if n.startswith(prefix))
    return sorted(int(n) for n in found if n.lstrip("-").isdigit())


class BatchTable:
    """A folder with one part per micro-batch.

    A part is overwritten when its batch is replayed after a failure, so each
    batch counts once although the stream itself is at least once. With an
    absolute ``label`` the folder outlives the job, and the next run goes on
    where this one stopped.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = home(spark, label)
        self.schema = None

    def _reader(self) -> DataFrameReader:
        # A part without rows may be a folder without files.
        return self.spark.read if self.schema is None else self.spark.read.schema(self.schema)

    def write(self, df: DataFrame, batch_id: int, by: tuple[str, ...] = ()) -> None:
        self.schema = df.schema
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, up_to: int | None = None) -> DataFrame | None:
        """All parts, or those before batch ``up_to``; None while there are none."""
        try:
            rows = self._reader().option("basePath", self.path).parquet(f"{self.path}/batch_id=*")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return rows if up_to is None else rows.filter(F.col("batch_id") < up_to)

    def part(self, batch_id: int) -> DataFrame:
        return self._reader().parquet(f"{self.path}/batch_id={batch_id}")

    def numbers(self) -> list[int]:
        """Batches with a part."""
        return _numbers(self.spark, self.path, "batch_id=")

    def last_before(self, batch_id: int) -> DataFrame | None:
        """The part of the last batch before, for tables whose part is a full state."""
        before = [n for n in self.numbers() if n < batch_id]
        return self.part(before[-1]) if before else None

    def forget(self, batch_id: int) -> None:
        """Drops the states that the one before ``batch_id`` has replaced; that one is kept for a replay."""
        before = [n for n in self.numbers() if n < batch_id]
        for n in before[:-1]:
            files.remove(self.spark, f"{self.path}/batch_id={n}")


class MergedTable:
    """Parts that add up, merged as they pile up.

    A part holds what one micro-batch adds; ``merge`` makes one row per key of any number of parts.
    Every ``every`` batches the finished parts and the last snapshot become a new snapshot. It counts
    from the moment its number is in the manifest, an empty file made in one step, so a crash
    before leaves the old one in force. What a snapshot replaced is dropped when the next one
    counts: readers of this batch still find it. A read takes one snapshot and ``every`` parts at
    most, however long the stream has run.
    """

    def __init__(self, spark: SparkSession, label: str, merge: Callable[[DataFrame], DataFrame], every: int = MERGE_EVERY):
        self.spark, self.merge, self.every = spark, merge, every
        self.path = home(spark, label)

    def _merged(self, below: int | None = None) -> int | None:
        numbers = [n for n in _numbers(self.spark, f"{self.path}/manifest", "") if below is None or n < below]
        return numbers[-1] if numbers else None

    def _parts(self) -> list[int]:
        return _numbers(self.spark, f"{self.path}/parts", "batch_id=")

    def sources(self, up_to: int | None = None) -> list[str]:
        """Folders that hold the table, or its state before batch ``up_to``."""
        merged = self._merged(up_to)
        parts = [n for n in self._parts() if (merged is None or n > merged) and (up_to is None or n < up_to)]
        first = [] if merged is None else [f"{self.path}/merged/{merged}"]
        return first + [f"{self.path}/parts/batch_id={n}" for n in parts]

    def read(self, up_to: int | None = None) -> DataFrame | None:
        """One row per key; None while there is nothing."""
        sources = self.sources(up_to)
        return self.merge(self.spark.read.parquet(*sources)) if sources else None

    def write(self, df: DataFrame, batch_id: int) -> None:
        self._compact(batch_id)
        df.write.mode("overwrite").parquet(f"{self.path}/parts/batch_id={batch_id}")

    def _compact(self, batch_id: int) -> None:
        """Merges the parts of the batches before, which no replay changes any more."""
        merged = self._merged()
        ready = [n for n in self._parts() if n < batch_id and (merged is None or n > merged)]
        if len(ready) < self.every:
            return
        self.read(batch_id).write.mode("overwrite").parquet(f"{self.path}/merged/{ready[-1]}")
        files.mark(self.spark, f"{self.path}/manifest/{ready[-1]}")
        if merged is None:
            return
        for n in self._parts():
            if n <= merged:
                files.remove(self.spark, f"{self.path}/parts/batch_id={n}")
        for n in _numbers(self.spark, f"{self.path}/manifest", ""):
            if n < merged:
                files.remove(self.spark, f"{self.path}/manifest/{n}")
                files.remove(self.spark, f"{self.path}/merged/{n}")
