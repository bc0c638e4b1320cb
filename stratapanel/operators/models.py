"""Gradient-boosted models per fold on MLlib, ensembles and importances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .prep import fit_medians, impute_median, size_weight, time_decay_weight


@dataclass(frozen=True)
class BoostParams:
    """Defaults follow the published hyperparameters where MLlib has a counterpart."""
    rounds: int = 200
    step: float = 0.05
    depth: int = 8
    min_rows: int = 100
    row_share: float = 0.8
    column_share: str = "0.5"
    tolerance: float = 0.0001
    decay: float = 0.9999
    seed: int = 42


def feature_vector(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


def fit_fold(rows: DataFrame, features: list[str], target: str, p: BoostParams = BoostParams(),
             domain: str = "TAC", log_cap: Column | None = None, train: str = "train",
             valid: str = "test") -> tuple[GBTRegressionModel, DataFrame]:
    """Train one fold; returns the model and the fitted medians.

    ``rows`` has a ``side`` column. Medians and weights come from training rows
    only; validation rows steer early stopping through ``validationIndicatorCol``.
    """
    rows = rows.where(F.col("side").isin(train, valid) & F.col(target).isNotNull())
    is_train = F.col("side") == train
    medians = staged(fit_medians(rows.where(is_train), features), "medians")   # one row, for the fit and each scoring
    d = impute_median(rows, medians, features)
    d = time_decay_weight(d.withColumn("_phase", is_train), p.decay, by=["_phase"], out="_decay")
    size = size_weight(log_cap, domain) if log_cap is not None else F.lit(1.0)
    d = d.withColumn("weight", F.when(is_train, F.col("_decay") * F.coalesce(size, F.lit(0.0))).otherwise(F.lit(1.0)))
    d = feature_vector(d, features).select("features", F.col(target).cast("double").alias("label"), "weight",
                                           (~is_train).alias("is_valid"))
    d = staged(d, "fold")   # read again in every boosting round
    gbt = GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="is_valid",
                       maxIter=p.rounds, stepSize=p.step, maxDepth=p.depth, minInstancesPerNode=p.min_rows,
                       subsamplingRate=p.row_share, featureSubsetStrategy=p.column_share, validationTol=p.tolerance, seed=p.seed)
    return gbt.fit(d), medians


def predict(model: GBTRegressionModel, medians: DataFrame, rows: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    """Score rows with one fold's model; the inputs keep their own columns."""
    filled = {f"_x_{c}": F.col(c) for c in features}
    d = rows.withColumns(filled)
    tmp = [f"_x_{c}" for c in features]
    renamed = medians.withColumnsRenamed({f"{c}__median": f"_x_{c}__median" for c in features})
    d = feature_vector(impute_median(d, renamed, tmp), tmp)
    return model.transform(d).withColumnRenamed("prediction", out).drop("features", *tmp)


def fold_scores(panel: DataFrame, folds: DataFrame, fold_ids: list[int], features: list[str], target: str,
                p: BoostParams = BoostParams(), domain: str = "TAC", log_cap: Column | None = None,
                score_all: bool = False) -> tuple[DataFrame, dict[int, GBTRegressionModel]]:
    """Fit each fold as a distributed job and score its rows (or every panel row).

    ``panel`` is read once per boosting round by MLlib: pass a written table.
    Fold ids are settings, so the loop length does not depend on the data.
    """
    from .splits import rows_of_folds
    scored, models = None, {}
    for k in fold_ids:
        rows = rows_of_folds(panel, folds.where(F.col("fold") == k))
        models[k], medians = fit_fold(rows, features, target, p, domain, log_cap)
        base = panel.withColumn("fold", F.lit(k)) if score_all else rows
        part = predict(models[k], medians, base, features)
        scored = part if scored is None else scored.unionByName(part)
    return scored, models


def ensemble_score(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean of the folds' scores per row."""
    return scored.groupBy(*keys).agg(F.avg(score).alias(score), F.count(score).alias("n_models"))


def importance_table(spark, models: dict[int, GBTRegressionModel], features: list[str]) -> DataFrame:
    """(fold, feature, importance): one row per fold and feature."""
    rows = [(k, f, float(v)) for k, m in models.items() for f, v in zip(features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "fold int, feature string, importance double")


def top_importances(table: DataFrame, n: int = 30) -> DataFrame:
    """Strongest features of each fold."""
    from pyspark.sql import Window
    w = Window.partitionBy("fold").orderBy(F.desc("importance"), "feature")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def importance_stability(table: DataFrame, fold_ids: list[int]) -> DataFrame:
    """Features x folds with the mean over folds and mean / sample std, strongest first."""
    wide = table.groupBy("feature").pivot("fold", fold_ids).agg(F.first("importance"))
    wide = wide.withColumnsRenamed({str(k): f"fold_{k}" for k in fold_ids})
    stats = table.groupBy("feature").agg(
        F.avg("importance").alias("average"),
        F.try_divide(F.avg("importance"), F.stddev_samp("importance")).alias("stability"))
    return wide.join(stats, "feature").orderBy(F.desc("average"), "feature")
