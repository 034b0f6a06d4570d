"""Fit, score, evaluate and record models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.regression import LinearRegression as MLLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.errors import NotTrained
from erascope.operators.linear import LeastSquares, LinearModel, require_trained
from erascope.operators.projection import project_panel, resolve_features, resolve_targets, subsample
from erascope.operators.scores import METRICS, UserScore, era_scores, score_summary
from erascope.operators.trees import HistogramTrees, TreeModel
from erascope.sources.files import exists
from erascope.sources.runs import RunStore, split_metric
from erascope.splits import Splits

PREDICTION = "prediction"
VALIDATION, TEST = "val", "test"
SPLIT_ERA = "_split_era"

# Rounds, learning rate and depth of the boosted-tree presets, and their column fraction.
TREE_PRESETS = {
    "small": {"maxIter": 2000, "stepSize": 0.01, "maxDepth": 5},
    "large": {"maxIter": 20000, "stepSize": 0.001, "maxDepth": 6},
    "deep": {"maxIter": 30000, "stepSize": 0.001, "maxDepth": 10},
}
# The library's own: as many rounds as a first look needs, with all columns.
TREE_PRESETS["quick"] = {"maxIter": 12, "stepSize": 0.1, "maxDepth": 4, "featureSubsetStrategy": "all"}
TREE_COLUMN_FRACTION = "0.1"


def histogram_trees(features: Sequence[str], target: str = "target", preset: str = "small", **overrides) -> HistogramTrees:
    """L4. Trees by exact histograms with a preset's rounds, rate and depth; any parameter can be overridden."""
    params = TREE_PRESETS[preset]
    fraction = params.get("featureSubsetStrategy", TREE_COLUMN_FRACTION)
    chosen = {
        "rounds": params["maxIter"], "rate": params["stepSize"], "depth": params["maxDepth"],
        "column_fraction": 1.0 if fraction == "all" else float(fraction), **overrides,
    }
    return HistogramTrees(tuple(features), target, **chosen)


def boosted_trees(features: Sequence[str], target: str = "target", preset: str = "small", **overrides) -> Pipeline:
    """L4. MLlib boosted trees with a preset's rounds, rate and depth; any parameter can be overridden.

    Node ids are cached with checkpoints, so that the lineage of long runs stays short.
    """
    params: dict[str, Any] = {
        "featureSubsetStrategy": TREE_COLUMN_FRACTION,
        **TREE_PRESETS[preset],
        "seed": 42,
        "maxMemoryInMB": 1024,
        "cacheNodeIds": True,
        "checkpointInterval": 10,
        **overrides,
    }
    return with_vector(features, GBTRegressor(labelCol=target, featuresCol="_features", **params))


def ml_linear(features: Sequence[str], target: str = "target", **params) -> Pipeline:
    """L3. MLlib linear regression; ``LeastSquares`` gives the same minimum by normal equations."""
    return with_vector(features, MLLinearRegression(labelCol=target, featuresCol="_features", **params))


def with_vector(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), estimator])


@dataclass
class PanelData:
    """L15. The three splits of a panel as lazy frames ``(id, era, features, targets, meta)``.

    Only training uses ``targets``; validation and test are scored on ``eval_target``.
    """

    panel: DataFrame
    features: Sequence[str] | str | None = None
    first_n: int | None = None
    targets: Sequence[str] | None = None
    eval_target: str = "target"
    features_dtype: str = "Int8"
    splits: Splits = field(default_factory=Splits)
    catalogue: Mapping[str, Sequence[str]] | None = None
    limits: Mapping[str, float] = field(default_factory=dict)  # split -> fraction of rows; 0 skips it

    @property
    def feature_names(self) -> list[str]:
        return resolve_features(self.features, self.catalogue, self.first_n)

    @property
    def target_names(self) -> list[str]:
        return resolve_targets(self.targets)

    @property
    def meta(self) -> str | None:
        return S.PanelColumns.of(self.panel).meta

    def train_dataset(self) -> DataFrame:
        return self._split("train", self.splits.train, self.target_names)

    def val_dataset(self) -> DataFrame:
        return self._split(VALIDATION, self.splits.validation, [self.eval_target])

    def test_dataset(self) -> DataFrame:
        return self._split(TEST, self.splits.test, [self.eval_target])

    def runs_split(self, split: str) -> bool:
        return self.limits.get(split) is None or self.limits[split] > 0

    def _split(self, name: str, eras, targets: Sequence[str]) -> DataFrame:
        rows = project_panel(
            self.panel, eras.start, eras.stop, self.feature_names, None, targets, self.features_dtype
        )
        return subsample(rows, self.limits.get(name))


class Module:
    """A model with its metrics: fit, guarded predict, evaluate, save and load.

    ``estimator`` has ``fit(df)`` and its model ``transform(df)``, adding ``prediction``. ``metrics`` are
    names of built-in scores, functions of Column aggregates as taken by ``erawise``, or ``UserScore``, which
    also takes functions of arrays and the aggregate over eras.
    """

    def __init__(self, estimator=None, metrics: Sequence[str | Callable | UserScore] = METRICS, strategy: str = "auto"):
        self.estimator, self.metrics, self.strategy = estimator, tuple(metrics), strategy
        self.model = None

    @property
    def trained(self) -> bool:
        return self.model is not None

    def train(self, rows: DataFrame) -> Module:
        """L5."""
        self.model = self.estimator.fit(rows)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """L6. Rows with ``prediction``; an error before training."""
        return require_trained(self.model).transform(rows)

    def evaluate(self, rows: DataFrame, split: str, target: str, meta: str | None) -> DataFrame:
        """L7. ``(split, metric, value)``: all built-in scores come from one pass over the eras."""
        return evaluate_predictions(self.predict(rows), split, target, meta, self.metrics, strategy=self.strategy)

    def validate(self, data: PanelData) -> DataFrame:
        return self.evaluate(data.val_dataset(), VALIDATION, data.eval_target, data.meta)

    def test(self, data: PanelData) -> DataFrame:
        return self.evaluate(data.test_dataset(), TEST, data.eval_target, data.meta)

    def save(self, spark: SparkSession, path: str) -> None:
        """L9. Coefficients or trees as tables, or an MLlib model folder."""
        model = require_trained(self.model)
        if isinstance(model, LinearModel):
            model.save(spark, f"{path}/linear")
        elif isinstance(model, TreeModel):
            model.save(spark, f"{path}/trees")
        else:
            model.write().overwrite().save(f"{path}/mllib")

    @classmethod
    def load(cls, spark: SparkSession, path: str, metrics: Sequence[str | Callable | UserScore] = METRICS) -> Module:
        module = cls(None, metrics)
        if exists(spark, f"{path}/linear"):
            module.model = LinearModel.load(spark, f"{path}/linear")
        elif exists(spark, f"{path}/trees"):
            module.model = TreeModel.load(spark, f"{path}/trees")
        else:
            module.model = PipelineModel.load(f"{path}/mllib")
        return module


def evaluate_predictions(
    scored: DataFrame,
    split: str,
    target: str = "target",
    meta: str | None = "meta",
    metrics: Sequence[str | Callable | UserScore] = METRICS,
    preds: str | Sequence[str] = PREDICTION,
    strategy: str = "auto",
) -> DataFrame:
    """L7 on given predictions: ``(split, metric, value)``."""
    names = [m for m in metrics if isinstance(m, str)]
    parts = []
    if names:
        needed = [m for m in METRICS if m in names or (m == "payoff" and "annual_return" in names)]
        summary = score_summary(era_scores(scored, preds, target, meta, metrics=needed, strategy=strategy))
        entries = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
        parts.append(summary.select(F.lit(split).alias("split"), F.inline(F.array(*entries))))
    for fn in metrics:
        if not isinstance(fn, str):
            user = fn if isinstance(fn, UserScore) else UserScore(fn)
            value = user.value(scored, preds, target, meta, strategy=strategy)
            parts.append(value.select(F.lit(split).alias("split"), F.lit(user.__name__).alias("metric"), "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


class Trainer:
    """Runs a module on a data set and keeps its metrics in a run store."""

    def __init__(self, store: RunStore, run_id: str, model_dir: str):
        self.store, self.run_id, self.model_dir = store, run_id, model_dir

    def fit(self, module: Module, data: PanelData) -> Module:
        """Fit on the training split, save the model, then score both other splits and record the scores."""
        module.train(data.train_dataset())
        module.save(self.store.spark, self.model_dir)
        self.store.log_metrics(self.run_id, populate_metrics(module, data), new_attempt=True)
        return module

    def evaluate(
        self, split: str, data: PanelData, module: Module | None = None, model_path: str | None = None
    ) -> DataFrame:
        """L8. Stored scores of the run win; else a given or stored model is evaluated."""
        if not data.runs_split(split):
            return self.store.metrics(self.run_id).where(F.lit(False)).select("split", "metric", "value")
        stored = self.store.metrics(self.run_id, split).select("split", "metric", "value")
        if not stored.isEmpty():
            return stored
        if model_path is not None:
            module = Module.load(self.store.spark, model_path, module.metrics if module else METRICS)
        if module is None:
            raise ValueError("either a module or a model path is needed")
        if not module.trained:
            raise NotTrained("train the module before evaluating it")
        return module.validate(data) if split == VALIDATION else module.test(data)

    def validate(self, data: PanelData, module: Module | None = None, model_path: str | None = None) -> DataFrame:
        return self.evaluate(VALIDATION, data, module, model_path)

    def test(self, data: PanelData, module: Module | None = None, model_path: str | None = None) -> DataFrame:
        return self.evaluate(TEST, data, module, model_path)


def populate_metrics(module: Module, data: PanelData) -> DataFrame:
    """L10. Scores of both evaluation splits; a split turned off gives no rows.

    Built-in scores of both splits come from one pass: their rows are stacked, predicted and scored by split and era.
    """
    splits = [(VALIDATION, data.val_dataset), (TEST, data.test_dataset)]
    rows = {name: dataset() for name, dataset in splits if data.runs_split(name)}
    if not rows:
        return data.panel.sparkSession.createDataFrame([], "split string, metric string, value double")
    names = [m for m in module.metrics if isinstance(m, str)]
    if len(rows) < 2 or len(names) < len(module.metrics):
        return reduce(lambda a, b: a.unionByName(b), [module.evaluate(df, name, data.eval_target, data.meta) for name, df in rows.items()])
    stacked = reduce(lambda a, b: a.unionByName(b), [
        df.where(F.col(S.ERA).isNotNull()).withColumn(SPLIT_ERA, F.concat_ws(":", F.lit(name), S.ERA)) for name, df in rows.items()
    ])
    needed = [m for m in METRICS if m in names or (m == "payoff" and "annual_return" in names)]
    scores = era_scores(module.predict(stacked), PREDICTION, data.eval_target, data.meta, SPLIT_ERA, needed, module.strategy)
    summary = score_summary(scores.withColumn("split", F.substring_index(SPLIT_ERA, ":", 1)), ["split"])
    # a split without eras has null scores, as when it is scored alone
    every = data.panel.sparkSession.createDataFrame([(n,) for n in rows], "split string").join(summary, "split", "left")
    return every.select("split", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


@dataclass(frozen=True)
class TrainOutput:
    """L12. Scores of the monitored metric and the full record."""

    val_score: float | None
    test_score: float | None
    record: DataFrame
    module: Module


def train_output(metrics: DataFrame, monitor: str) -> DataFrame:
    """L13. ``(split, metric, value, is_monitor)``; the monitor is looked up by name in every split."""
    _, name = split_metric(monitor)
    return metrics.select("split", "metric", "value", (F.lower("metric") == name).alias("is_monitor"))


def train(data: PanelData, module: Module, trainer: Trainer, monitor: str = "payoff") -> TrainOutput:
    """L12. Fit, validate, test and record; the score is None where the monitored metric is absent."""
    trainer.fit(module, data)
    metrics = trainer.validate(data, module).unionByName(trainer.test(data, module))
    record = train_output(metrics, monitor)
    scores = {r["split"]: r["value"] for r in record.where("is_monitor").collect()}
    return TrainOutput(scores.get(VALIDATION), scores.get(TEST), record, module)


def least_squares_module(data: PanelData, metrics: Sequence[str | Callable | UserScore] = METRICS, **options) -> Module:
    """The linear preset for a data set (first training target)."""
    return Module(LeastSquares(tuple(data.feature_names), tuple(data.target_names[:1]), **options), metrics)
