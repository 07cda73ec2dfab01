"""One MLlib model pooled over a whole fleet of series, and its feature importances.

Unlike the per-series fits of :mod:`funnelcast.operators.origin_models`, a pooled model sees the training
matrix of *all* series at once, fitted by MLlib's distributed learners inside a ``Pipeline``: median
``Imputer`` -> ``VectorAssembler`` -> optional ``StandardScaler`` -> estimator. Nothing is collected.

* ridge: the source minimises ``||y - Xw||^2 + alpha ||w||^2``; MLlib minimises
  ``1/(2n) ||y - Xw||^2 + lambda/2 ||w||^2``, so ``lambda = alpha / n`` on
  features scaled by the pipeline (``standardization=False`` on the estimator).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelcast.operators import features as FE
from funnelcast.operators.origin_models import LEARNERS

SCALED = {"linear_regression", "ridge"}


def _estimator(name: str, n_rows: int, params: dict | None = None, seed: int = 42):
    p = {**LEARNERS[name], **(params or {})}
    if name == "linear_regression":
        return LinearRegression(featuresCol="features", labelCol="y", regParam=0.0, standardization=False, solver="normal")
    if name == "ridge":
        return LinearRegression(featuresCol="features", labelCol="y", regParam=p["alpha"] / max(n_rows, 1),
                                elasticNetParam=0.0, standardization=False, solver="normal")
    if name == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=p["n_estimators"],
                                     maxDepth=p["max_depth"], featureSubsetStrategy="all", seed=seed)
    return GBTRegressor(featuresCol="features", labelCol="y", maxIter=p["n_estimators"], maxDepth=p["max_depth"],
                        stepSize=p["learning_rate"], subsamplingRate=p.get("subsample", 1.0), seed=seed)


def build_pipeline(name: str, n_rows: int, features=FE.FEATURE_COLUMNS, params: dict | None = None) -> Pipeline:
    imputed = [f"{c}__imp" for c in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=imputed, strategy="median", relativeError=0.0),
        VectorAssembler(inputCols=imputed, outputCol="raw_features" if name in SCALED else "features", handleInvalid="keep"),
    ]
    if name in SCALED:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    stages.append(_estimator(name, n_rows, params))
    return Pipeline(stages=stages)


def fit(matrix: DataFrame, name: str, params: dict | None = None) -> PipelineModel:
    """Fit one pooled model on the training matrix (rows with a target)."""
    train = matrix.where(F.col("y").isNotNull())
    n = train.count()
    return build_pipeline(name, n, params=params).fit(train)


# --------------------------------------------------------------------------- M11
def feature_importance(model: PipelineModel, features=FE.FEATURE_COLUMNS) -> DataFrame:
    """Importances (trees) or absolute coefficients (linear), sorted descending."""
    est = model.stages[-1]
    values = est.featureImportances.toArray().tolist() if hasattr(est, "featureImportances") else [abs(c) for c in est.coefficients.toArray().tolist()]
    from pyspark.sql import SparkSession

    # model parameters already live on the driver: one value per feature (bounded by the feature list)
    session = SparkSession.getActiveSession()
    df = session.createDataFrame(list(zip(features, [float(v) for v in values])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))
