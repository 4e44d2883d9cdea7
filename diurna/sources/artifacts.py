"""Model artifacts: a fitted model next to its contract."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Model, PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.plans.scoring import LinearModel
from diurna.schemas import FEATURES, MODEL_CONTRACT, TARGET, TARGET_RANGE

COEFFICIENTS = "intercept double, coefficients array<double>"
REQUIRED = ["model_version", "model_type", "features", "n_features", "target", "target_range"]
COMPLETE = [f.name for f in MODEL_CONTRACT.fields]


def linear_model(fitted: DataFrame, development_size: int = 0, test_size: int = 0) -> LinearModel:
    """One-row coefficient table (see modeling.final_fit) -> model."""
    row = fitted.select("coefficients").first()
    intercept, *rest = row["coefficients"]
    return LinearModel(
        intercept,
        tuple(rest),
        development_size=development_size,
        test_size=test_size,
    )


def _contract(model: LinearModel) -> dict[str, Any]:
    return {
        "model_version": model.model_version,
        "model_type": model.model_type,
        "features": list(model.features),
        "n_features": len(model.features),
        "target": model.target,
        "target_range": list(model.target_range),
        "training_population": model.training_population,
        "development_size": model.development_size,
        "test_size": model.test_size,
    }


def save_linear(spark: SparkSession, model: LinearModel, path: str) -> None:
    """Contract and coefficients as two one-row parquet tables."""
    contract = spark.createDataFrame([_contract(model)], MODEL_CONTRACT)
    contract.write.mode("overwrite").parquet(f"{path}/contract")
    spark.createDataFrame([(model.intercept, list(model.coefficients))], COEFFICIENTS).write.mode(
        "overwrite"
    ).parquet(f"{path}/model")


def save_estimator(
    spark: SparkSession,
    model: Model | PipelineModel,
    path: str,
    model_type: str,
    development_size: int = 0,
    test_size: int = 0,
) -> None:
    """Any fitted pyspark.ml model with the same contract."""
    contract = {
        "model_version": "1.0",
        "model_type": model_type,
        "features": FEATURES,
        "n_features": len(FEATURES),
        "target": TARGET,
        "target_range": list(TARGET_RANGE),
        "training_population": "synthetic",
        "development_size": development_size,
        "test_size": test_size,
    }
    spark.createDataFrame([contract], MODEL_CONTRACT).write.mode("overwrite").parquet(
        f"{path}/contract"
    )
    model.write().overwrite().save(f"{path}/model")


def load_estimator(spark: SparkSession, path: str) -> tuple[dict[str, Any], Model]:
    """(contract, model) of an artifact written by :func:`save_estimator`.

    The model's own metadata names its class.
    """
    contract = load_contract(spark, path, COMPLETE)
    return contract, DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)


def load_contract(spark: SparkSession, path: str, required=REQUIRED) -> dict[str, Any]:
    """The checked contract; ValueError when it is incomplete or inconsistent."""
    table = spark.read.parquet(f"{path}/contract")
    missing = sorted(set(required) - set(table.columns))
    if missing:
        raise ValueError(f"incomplete artifact, missing {missing}")
    contract = table.first().asDict()
    empty = sorted(k for k in required if contract[k] is None)
    if empty:
        raise ValueError(f"incomplete artifact, missing {empty}")
    if len(contract["features"]) != contract["n_features"]:
        raise ValueError("feature list and feature count disagree")
    return contract


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    contract = load_contract(spark, path)
    row = spark.read.schema(COEFFICIENTS).parquet(f"{path}/model").first()
    return LinearModel(
        intercept=row["intercept"],
        coefficients=tuple(row["coefficients"]),
        features=tuple(contract["features"]),
        model_version=contract["model_version"],
        model_type=contract["model_type"],
        target=contract["target"],
        target_range=tuple(contract["target_range"]),
        training_population=contract.get("training_population") or "",
        development_size=contract.get("development_size") or 0,
        test_size=contract.get("test_size") or 0,
    )


def _largest_gap(pairs: DataFrame) -> float:
    """Largest |saved - own|; ValueError above 1e-12 (relative + absolute), or NULL or NaN."""
    gap = F.abs(F.col("saved") - F.col("own"))
    fine = gap <= F.lit(1e-12) + F.lit(1e-12) * F.abs("own")
    found = (
        pairs.select(gap.alias("gap"), (F.coalesce(fine, F.lit(False)) & ~F.isnan(gap)).alias("fine"))
        .agg(F.max("gap").alias("gap"), F.count_if(~F.col("fine")).alias("off"))
        .first()
    )
    if found["off"]:
        raise ValueError(f"reloaded model differs by {found['gap']}")
    return found["gap"] or 0.0


def _complete_contract(spark: SparkSession, path: str) -> None:
    contract = load_contract(spark, path, COMPLETE)
    if contract["features"] != list(FEATURES):
        raise ValueError("saved feature list differs from the whitelist")


def verify_saved(
    spark: SparkSession, model: LinearModel, path: str, reference: DataFrame, rows: int = 20
) -> float:
    """Reload and compare: contract, feature list, predictions on a few rows.

    Returns the largest difference; ValueError above 1e-12 (relative + absolute).
    """
    _complete_contract(spark, path)
    loaded = load_linear(spark, path)
    return _largest_gap(
        reference.limit(rows).select(
            loaded.prediction().alias("saved"), model.prediction().alias("own")
        )
    )


def verify_saved_estimator(
    spark: SparkSession, model: Model, path: str, reference: DataFrame, rows: int = 20
) -> float:
    """The same for any fitted pyspark.ml model; ``reference`` has its input columns."""
    _complete_contract(spark, path)
    _, loaded = load_estimator(spark, path)
    if type(loaded) is not type(model):
        raise ValueError(f"saved model is a {type(loaded).__name__}")
    own, saved = (
        m.stages[-1] if isinstance(m, PipelineModel) else m for m in (model, loaded)
    )
    named = [own.getPredictionCol(), saved.getPredictionCol()]
    ours = model.transform(reference.limit(rows)).withColumnRenamed(named[0], "own")
    # A pipeline adds its inner columns again.
    ours = ours.select(*reference.columns, "own")
    return _largest_gap(loaded.transform(ours).withColumnRenamed(named[1], "saved"))
