"""Calibrated models with pyspark.ml: gradient-boosted means and isotonic calibration."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calibrate(rows: DataFrame, margin: float = 1e-4) -> tuple[DataFrame, str]:
    """``rows`` (``p``, ``y``) with ``calibrated``: isotonic if its Brier score beats the raw one by ``margin``, else unchanged."""
    d = rows.withColumns({"p": F.col("p").cast("double"), "label": F.col("y").cast("double")})
    model = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="iso").fit(d.select("p", "label"))
    d = model.transform(d)
    raw, iso = d.agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)), F.avg(F.pow(F.col("iso") - F.col("label"), 2))).first()
    kind = "isotonic" if raw - iso > margin else "identity"
    return d.withColumn("calibrated", F.least(F.greatest(F.col("iso" if kind == "isotonic" else "p"), F.lit(0.01)), F.lit(0.99))).drop("iso", "label"), kind


def boosted_means(train: DataFrame, score: DataFrame, features: list[str], label: str, seed: int = 7) -> DataFrame:
    """``score`` with ``mean`` from boosted trees on ``features`` and ``variance`` from trees on the squared residuals."""
    v = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    t = v.transform(train.na.fill(0.0, features)).withColumn("label", F.col(label).cast("double"))
    mean = GBTRegressor(maxIter=10, maxDepth=3, seed=seed, predictionCol="mean").fit(t)
    resid = mean.transform(t).withColumn("label", F.pow(F.col("label") - F.col("mean"), 2)).drop("mean")
    var = GBTRegressor(maxIter=10, maxDepth=3, seed=seed, predictionCol="variance").fit(resid)
    out = var.transform(mean.transform(v.transform(score.na.fill(0.0, features))))
    return out.withColumn("mean", F.greatest("mean", F.lit(0.0))).withColumn("variance", F.greatest("variance", F.lit(1.0))).drop("features")
