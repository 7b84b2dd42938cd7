"""Recoverability models on MLlib: train, accept, score, retrain on drift."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from paymend.functions.scoring import FEATURES
from paymend.operators.drift import BRIER_LIMIT, drift_report
from paymend.sources import files
from paymend.sources.scratch import scratch_dir

ENTRY = "_name string, brier double, reference_rows bigint"


def estimator(kind: str = "boosted", trees: int = 50, label: str = "label") -> Pipeline:
    """Boosted trees (50, depth 3), or scaled logistic regression."""
    raw = VectorAssembler(inputCols=list(FEATURES), outputCol="raw", handleInvalid="skip")
    if kind == "boosted":
        model = GBTClassifier(
            featuresCol="raw", labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.15,
            minInstancesPerNode=15, subsamplingRate=0.8, seed=42,
        )
        return Pipeline(stages=[raw, model])
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=300)
    return Pipeline(stages=[raw, scaler, model])


def split(df: DataFrame, key: str, part: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out rows by a hash of the key, the same on every run."""
    bucket = F.pmod(F.xxhash64(key), F.lit(part))
    return df.filter(bucket != 0), df.filter(bucket == 0)


def score(model: PipelineModel, df: DataFrame, into: str = "score") -> DataFrame:
    """Probability in [0, 1] with four digits; 0.5 where the features are unusable."""
    usable = F.lit(True)
    for name in FEATURES:
        usable = usable & F.col(name).isNotNull()
    safe = df.withColumns({"_usable": usable, **{n: F.coalesce(F.col(n), F.lit(0)) for n in FEATURES}})
    out = model.transform(safe)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(vector_to_array("probability"), F.lit(1))))
    extra = [c for c in ("raw", "scaled", "rawPrediction", "probability", "prediction", "_usable") if c in out.columns]
    return out.withColumn(into, F.when(F.col("_usable"), F.round(p, 4)).otherwise(0.5)).drop(*extra)


def brier_of(model: PipelineModel, hold_out: DataFrame, label: str = "label") -> float:
    error = F.col("score") - F.col(label)
    return score(model, hold_out).agg(F.avg(error * error).alias("b")).first()["b"]


def train(df: DataFrame, key: str, kind: str = "boosted", trees: int = 50) -> tuple[PipelineModel, float, bool]:
    """Fit on the training part; returns the model, its hold-out Brier score and the verdict."""
    training, hold_out = split(df, key)
    model = estimator(kind, trees).fit(training)
    value = brier_of(model, hold_out)
    return model, value, value <= BRIER_LIMIT


# --- registry ----------------------------------------------------------------------
#
# A version is a folder with the model, a one-row entry and the reference rows that later calls are
# compared with. It is written whole before a pointer names it. A pointer is one empty file whose name
# holds its number and the version, so it is there or not, and the highest name is in use. A publisher
# that dies in between leaves a folder that no one reads. Of two that take the same number at once both
# versions are kept, and the higher name wins for every reader.


def publish(
    spark: SparkSession, model: PipelineModel, registry: str | None = None, brier: float | None = None, reference: DataFrame | None = None
) -> str:
    """Store a version, with its Brier score and reference rows, and point the registry at it; returns the registry."""
    folder = registry or scratch_dir(spark, "models")
    version = uuid.uuid4().hex
    path = f"{folder}/versions/{version}"
    model.write().save(f"{path}/model")
    rows = None
    if reference is not None:
        reference.write.parquet(f"{path}/reference")
        rows = spark.read.parquet(f"{path}/reference").count()
    spark.createDataFrame([(version, brier, rows)], ENTRY).coalesce(1).write.parquet(f"{path}/entry")
    _point(spark, folder, version)
    return folder


def _pointers(spark: SparkSession, registry: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers, oldest first."""
    split_names = (name.split("-", 1) for name in files.names(spark, f"{registry}/pointer") if not name.startswith((".", "_")))
    return sorted((int(number), version) for number, version in split_names)


def _point(spark: SparkSession, registry: str, version: str) -> None:
    past = _pointers(spark, registry)
    number = past[-1][0] + 1 if past else 1
    files.mark(spark, f"{registry}/pointer/{number:010d}-{version}")


def _in_use(spark: SparkSession, registry: str) -> str:
    past = _pointers(spark, registry)
    if not past:
        raise LookupError(f"no model is published in {registry}")
    return f"{registry}/versions/{past[-1][1]}"


def current(spark: SparkSession, registry: str) -> PipelineModel:
    """The model in use."""
    return PipelineModel.load(f"{_in_use(spark, registry)}/model")


def current_reference(spark: SparkSession, registry: str) -> DataFrame:
    """The reference rows stored with the model in use."""
    return spark.read.parquet(f"{_in_use(spark, registry)}/reference")


def rollback(spark: SparkSession, registry: str) -> None:
    """Point at the version that was in use before the one in use came; its reference rows are in use with it."""
    past = [version for _, version in _pointers(spark, registry)]
    first = past.index(past[-1]) if past else 0
    if first == 0:
        raise LookupError("there is no earlier version")
    _point(spark, registry, past[first - 1])


def history(spark: SparkSession, registry: str) -> DataFrame:
    """``step, version, brier, reference_rows, in_use``: every pointer; versions count in order of their first one."""
    past = _pointers(spark, registry)
    order = list(dict.fromkeys(version for _, version in past))
    steps = [(step, order.index(version) + 1, version, step == len(past)) for step, (_, version) in enumerate(past, 1)]
    found = spark.createDataFrame(steps, "step int, version int, _name string, in_use boolean")
    if not past:
        return found.select("step", "version", F.lit(None).cast("double").alias("brier"), F.lit(None).cast("bigint").alias("reference_rows"), "in_use")
    entries = spark.read.schema(ENTRY).parquet(*[f"{registry}/versions/{version}/entry" for version in order])
    return found.join(entries, "_name").select("step", "version", "brier", "reference_rows", "in_use")


def retrain_on_drift(
    reference: DataFrame | None, live: DataFrame, key: str, registry: str | None = None, kind: str = "boosted", trees: int = 50
) -> dict:
    """Compare, retrain when drifted, publish when accepted.

    ``reference`` None: the rows stored with the registry's model in use. An accepted model is
    published together with the live rows as its reference. Returns the verdict, the Brier score and
    the reference rows of the model then in use.
    """
    if reference is None:
        if registry is None:
            raise ValueError("give reference rows or a registry that holds them")
        reference = current_reference(live.sparkSession, registry)
    names = [key, "code_index", "amount_rupees"]
    old, new = reference.select(*names, F.lit(False).alias("_live")), live.select(*names, F.lit(True).alias("_live"))
    found = drift_report(old.unionByName(new), [], "code_index", "amount_rupees", F.col("_live")).first()
    result = {"drift": bool(found["drift"]), "brier": None, "accepted": False, "registry": registry, "reference": reference}
    if result["drift"]:
        model, value, ok = train(live, key, kind, trees)
        result.update(brier=value, accepted=ok)
        if ok:
            result["registry"] = publish(live.sparkSession, model, registry, value, live)
            result["reference"] = live
    return result
