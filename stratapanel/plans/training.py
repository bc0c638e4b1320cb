"""The training job: candidates -> event ends -> thinning -> split -> fit per fold -> scores -> metrics and score bins.

``master`` should be a written dataset: splits, fits and reports each read it. Everything but the boosting itself is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, models, splits
from ..operators.domain import Domain, domain_filter
from ..operators.thinning import thin_by_interval
from .staging import staged

FUTURE = ["Future_High", "Future_Low", "Future_Close"]


@dataclass(frozen=True)
class SplitPlan:
    """``method``: fixed (by dates, three phases), purged_kfold or cpcv (by blocks of days, train and valid)."""
    method: str = "purged_kfold"
    n_splits: int = 6
    n_test: int = 2
    pct_embargo: float = 0.01
    valid_start: str = ""
    test_start: str = ""
    embargo_days: int = 0

    @property
    def report_phase(self) -> str:
        return "test" if self.method == "fixed" else "valid"


def training_samples(master: DataFrame, domain: Domain, sessions: DataFrame | None = None) -> DataFrame:
    """The domain's candidates with their event end ``t1``, thinned per stock.

    Candidates are few of the rows and are read by the calendar, the thinning and the split: they are written once.
    """
    d = splits.add_event_end(staged(domain_filter(master, domain), "candidates"), domain.horizon, sessions)
    return thin_by_interval(d, domain.thinning_days)


def training_rows(samples: DataFrame, plan: SplitPlan) -> DataFrame:
    """Samples once per fold and phase (train, valid, test) that they belong to; days in an embargo belong to none."""
    if plan.method == "fixed":
        phase = splits.fixed_holdout(F.col("date"), plan.valid_start, plan.test_start, plan.embargo_days)
        return samples.withColumns({"fold": F.lit(0), "phase": phase}).where(F.col("phase").isNotNull())
    axis = splits.split_axis(samples)
    if plan.method == "purged_kfold":
        folds = splits.purged_kfold(axis, plan.n_splits, plan.pct_embargo)
    elif plan.method == "cpcv":
        folds = splits.cpcv(axis, plan.n_splits, plan.n_test, plan.pct_embargo)
    else:
        raise ValueError(f"unknown split {plan.method}")
    rows = splits.rows_of_folds(samples, staged(folds, "folds"))
    return rows.withColumn("phase", F.when(F.col("side") == "test", "valid").otherwise(F.col("side"))).drop("side", "pos", "end_pos")


@dataclass
class Trained:
    """Models by fold, the medians they were fitted with, scored rows of all folds and phases."""
    models: dict = field(default_factory=dict)
    medians: dict = field(default_factory=dict)
    scored: DataFrame | None = None


def train(rows: DataFrame, fold_ids: list[int], features: list[str], target: str, domain: Domain,
          params: models.BoostParams = models.BoostParams(), log_cap: Column | None = None) -> Trained:
    """One model per fold, fitted on its train rows with its valid rows for early stopping; scores of every phase."""
    rows = staged(rows)   # read for each fold's medians, fit and scores
    out = Trained()
    for k in fold_ids:
        part = rows.where(F.col("fold") == k).withColumn("side", F.col("phase"))
        out.models[k], out.medians[k] = models.fit_fold(part, features, target, params, domain.name, log_cap, valid="valid")
        scored = models.predict(out.models[k], out.medians[k], part.drop("side"), features)
        out.scored = scored if out.scored is None else out.scored.unionByName(scored)
    return out


def score_new(trained: Trained, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Rows scored by every fold's model: their mean and how many models gave one."""
    every = None
    for k, model in trained.models.items():
        part = models.predict(model, trained.medians[k], rows, features).select(*keys, F.lit(k).alias("fold"), "score")
        every = part if every is None else every.unionByName(part)
    return models.ensemble_score(every, keys)


def phase_metrics(scored: DataFrame, target: str, label: str | None = None, spacing: int = 250_000) -> DataFrame:
    """rmse, ic (and auc) per fold and phase."""
    return evaluate.fold_metrics(scored, target, "score", ["fold", "phase"], label, spacing)


def score_bins(scored: DataFrame, target: str, plan: SplitPlan, n: int = 10, task: str = "regression", spacing: int = 250_000) -> DataFrame:
    """Statistics of the target and future prices by score, over the phase that no fit has seen."""
    d = scored.where(F.col("phase") == plan.report_phase)
    binned = evaluate.quantile_bins(d, "score", n, spacing=spacing) if task == "regression" else evaluate.fixed_bins(d, "score", n)
    return evaluate.bin_stats(binned, "bin", target, [c for c in FUTURE if c in scored.columns], spacing)
