"""Reload checks of saved estimators."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from diurna.sources import artifacts


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(60).select(
        F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"),
        (F.col("id") * 2 + F.col("id") % 7).cast("double").alias("y"),
    ).cache()


def pipeline(last):
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="x"), last])


def test_reloaded_models_predict_the_same(spark, rows, tmp_path):
    forest = pipeline(RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=3, seed=1))
    fitted = forest.fit(rows)
    artifacts.save_estimator(spark, fitted, f"{tmp_path}/m", "forest")
    assert artifacts.verify_saved_estimator(spark, fitted, f"{tmp_path}/m", rows) == 0.0


def test_other_models_are_noticed(spark, rows, tmp_path):
    path = f"{tmp_path}/m"
    linear = LinearRegression(featuresCol="x", labelCol="y")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows)
    saved = linear.fit(ready.where("a < 20"))
    artifacts.save_estimator(spark, saved, path, "linear")
    other = linear.fit(ready.withColumn("y", F.col("y") + F.col("a") * F.col("a")))
    with pytest.raises(ValueError, match="differs"):
        artifacts.verify_saved_estimator(spark, other, path, ready)
    with pytest.raises(ValueError, match="saved model is"):
        artifacts.verify_saved_estimator(spark, pipeline(linear).fit(rows), path, rows)
