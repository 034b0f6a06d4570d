"""Scores of predictions against targets and a meta model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope.functions.numeric import NAN, nan_if_null, safe_div, signed_power, with_norm_ppf
from erascope.functions.ranking import (
    HOT_GROUP_ROWS,
    add_group_stats,
    join_back,
    per_group,
    profile_groups,
    written,
)
from erascope.operators.eras import add_ensemble, add_normal_scores

# Fixed values of the scoring rules.
CORR_WEIGHT = 0.5
MMC_WEIGHT = 2.0
MMC_FACTOR = 4.0
ROUNDS_PER_YEAR = 52 * 5
PAYOUT_FACTOR = 0.1

METRICS = ("corr", "mmc", "payoff")
RANGE_BLOCK = 1_000_000
# States of user scores are merged in groups of so many tasks, then of so many groups, then all.
MERGE_STEPS = (16, 16, None)


def corr_of(target_power: Column, preds_power: Column) -> Column:
    """M1. Pearson correlation as an aggregate; NaN when a side is constant or there is one row."""
    return safe_div(
        F.covar_pop(target_power, preds_power), F.stddev_pop(target_power) * F.stddev_pop(preds_power)
    )


def mmc_of(target: Column, preds: Column, meta: Column) -> Column:
    """M2. Covariance of the target with the part of ``preds`` orthogonal to ``meta``, as one aggregate.

    Covariance is linear, so no second pass over the rows is needed.
    """
    slope = safe_div(F.sum(meta * preds), F.sum(meta * meta))
    return F.lit(MMC_FACTOR) * (F.covar_pop(target, preds) - slope * F.covar_pop(target, meta))


def payoff_of(corr: Column, mmc: Column) -> Column:
    """M3. Weighted sum of both scores, not clipped."""
    return F.lit(CORR_WEIGHT) * corr + F.lit(MMC_WEIGHT) * mmc


def scoring_columns(
    df: DataFrame,
    preds: Sequence[str],
    target: str,
    meta: str | None,
    by: Sequence[str],
    how: str,
    small: bool,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Rows with ``t`` (target), ``te`` (signed power of the centred target), ``p`` and ``m`` (normal scores).

    With a meta model, ``raw_meta`` has its values as given (null as NaN).

    Several prediction columns are ensembled first. For one column the ensemble is a monotone map of its
    ranks, so ranking once gives the same scores.
    """
    names = [f"_pred_{i}" for i in range(len(preds))]
    rows = df.select(
        *by,
        *extra,
        nan_if_null(target).alias("t"),
        *[F.col(p).alias(n) for p, n in zip(preds, names)],
        *([F.col(meta).alias("_meta")] if meta else []),
    )
    rows = add_group_stats(rows, {"_mean_t": F.avg("t")}, by, how, small)
    rows = rows.withColumn("te", signed_power(F.col("t") - F.col("_mean_t"))).drop("_mean_t")
    if len(names) > 1:
        rows = add_ensemble(rows, names, "_ensemble", by, how, small)
        ranked = {"p": "_ensemble"}
    else:
        ranked = {"p": names[0]}
    if meta:
        ranked["m"] = "_meta"
    rows = add_normal_scores(rows, ranked, by, how, small)
    return rows.select(*by, *extra, "t", "te", "p", *(["m", nan_if_null("_meta").alias("raw_meta")] if meta else []))


def score_aggregates(metrics: Sequence[str]) -> dict[str, Column]:
    """Aggregates over ``scoring_columns`` rows for the requested metrics."""
    corr = corr_of(F.col("te"), signed_power(F.col("p")))
    aggs: dict[str, Column] = {}
    if "corr" in metrics:
        aggs["corr"] = corr
    if "mmc" in metrics or "payoff" in metrics:
        mmc = mmc_of(F.col("t"), F.col("p"), F.col("m"))
        if "mmc" in metrics:
            aggs["mmc"] = mmc
        if "payoff" in metrics:
            aggs["payoff"] = payoff_of(corr, mmc)
    return aggs


def era_scores(
    df: DataFrame,
    preds: str | Sequence[str],
    target: str = "target",
    meta: str | None = "meta",
    era: str = "era",
    metrics: Sequence[str] = METRICS,
    strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """M4. One row per era: ``era, n`` and the requested scores. Rows without an era take no part.

    A missing meta model is allowed; the scores that need it are then NaN.
    """
    columns = _as_list(preds)
    needs_meta = any(m != "corr" for m in metrics)
    part, meta_column = _meta_or_nan(df, meta) if needs_meta else (df, None)
    used = [era, target, *columns, *([meta_column] if meta_column else [])]
    rows = part.where(F.col(era).isNotNull()).select(*dict.fromkeys(used))

    def build(group: DataFrame, how: str, small: bool) -> DataFrame:
        scored = scoring_columns(group, columns, target, meta_column, [era], how, small)
        aggs = score_aggregates(metrics)
        return scored.groupBy(era).agg(
            F.count(F.lit(1)).alias("n"), *[a.alias(name) for name, a in aggs.items()]
        )

    return per_group(rows, [era], strategy, build, hot_rows, narrow=True)


def global_scores(
    df: DataFrame, preds: str, target: str = "target", meta: str | None = "meta",
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """W9. Scores of all rows as one group; one prediction column, no ensembling."""
    columns = _as_list(preds)
    if len(columns) != 1:
        raise ValueError("without eras only one prediction column can be scored")
    needs_meta = any(m != "corr" for m in metrics)
    part, meta_column = _meta_or_nan(df, meta) if needs_meta else (df, None)
    used = dict.fromkeys([target, *columns, *([meta_column] if meta_column else [])])
    scored = scoring_columns(written(part.select(*used)), columns, target, meta_column, [], "prefix", True)
    aggs = score_aggregates(metrics)
    return scored.agg(F.count(F.lit(1)).alias("n"), *[a.alias(name) for name, a in aggs.items()])


def mean_score(score: Column | str) -> Column:
    """A14. Mean over eras; every era weighs the same and a NaN era makes the mean NaN."""
    return F.avg(nan_if_null(score))


def annualized_return(payoff: Column | str) -> Column:
    """A15. Geometric mean growth per round, compounded over a year.

    A growth factor below zero gives NaN and one of exactly zero gives -1.
    """
    growth = F.lit(1.0) + F.lit(PAYOUT_FACTOR) * nan_if_null(payoff)
    lowest = F.min(growth)
    compounded = F.pow(F.exp(F.avg(F.log(growth))), F.lit(float(ROUNDS_PER_YEAR))) - 1.0
    return (
        F.when(F.max(F.isnan(growth)) | (lowest < 0), F.lit(NAN))
        .when(lowest == 0, F.lit(-1.0))
        .otherwise(compounded)
    )


def score_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M5-M8. Mean corr, mmc, payoff and the annual return of an era-score table: one row, or one per group of ``by``."""
    present = [m for m in METRICS if m in scores.columns]
    aggs = [mean_score(m).alias(m) for m in present]
    if "payoff" in present:
        aggs.append(annualized_return("payoff").alias("annual_return"))
    return scores.groupBy(*by).agg(*aggs)


def corr(df: DataFrame, preds, target="target", meta=None, era: str | None = "era", **options) -> DataFrame:
    """M5. Mean CORR over eras (or of all rows when ``era`` is None)."""
    return _one_metric(df, "corr", preds, target, meta, era, options)


def mmc(df: DataFrame, preds, target="target", meta="meta", era: str | None = "era", **options) -> DataFrame:
    """M6. Mean MMC over eras."""
    return _one_metric(df, "mmc", preds, target, meta, era, options)


def payoff(df: DataFrame, preds, target="target", meta="meta", era: str | None = "era", **options) -> DataFrame:
    """M7. Mean payoff over eras."""
    return _one_metric(df, "payoff", preds, target, meta, era, options)


def annual_return(
    df: DataFrame, preds, target="target", meta="meta", era: str | None = "era", **options
) -> DataFrame:
    """M8. Annual return over eras; without eras it is the plain payoff."""
    if era is None:
        return global_scores(df, preds, target, meta, ["payoff"]).select(F.col("payoff").alias("annual_return"))
    scores = era_scores(df, preds, target, meta, era, ["payoff"], **options)
    return scores.agg(annualized_return("payoff").alias("annual_return"))


def corr_vector(
    df: DataFrame, target: str = "target", out: str = "corr_vector", era: str = "era",
    strategy: str = "auto", hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """M9. Per-row weight whose dot product with the signed power of the normal scores is CORR (no ties)."""

    def build(part: DataFrame, how: str, small: bool) -> DataFrame:
        return add_corr_vector(part, target, out, [era], how, small)

    return per_group(df, [era], strategy, build, hot_rows)


def mmc_vector(
    df: DataFrame, target: str = "target", meta: str = "meta", out: str = "mmc_vector", era: str = "era",
    strategy: str = "auto", hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """M10. Per-row weight whose dot product with the normal scores of predictions is MMC."""

    def build(part: DataFrame, how: str, small: bool) -> DataFrame:
        return add_mmc_vector(part, target, meta, out, [era], how, small)

    return per_group(df, [era], strategy, build, hot_rows)


def payoff_vector(
    df: DataFrame, target: str = "target", meta: str = "meta", out: str = "payoff_vector", era: str = "era",
    strategy: str = "auto", hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """M11. Normal scores in the order of the MMC weights: a payoff close to the best possible one.

    For large eras this order is the best one with high probability; it is a lower bound in general.
    """

    def build(part: DataFrame, how: str, small: bool) -> DataFrame:
        weighted = add_mmc_vector(part, target, meta, "_weight", [era], how, small)
        return add_normal_scores(weighted, {out: "_weight"}, [era], how, small).drop("_weight")

    return per_group(df, [era], strategy, build, hot_rows)


def add_corr_vector(
    df: DataFrame, target: str, out: str, by: Sequence[str], how: str, small: bool
) -> DataFrame:
    t = nan_if_null(target)
    rows = add_group_stats(df, {"_size": F.count(F.lit(1)), "_mean": F.avg(t)}, by, how, small)
    rows = rows.withColumn("_power", signed_power(t - F.col("_mean")))
    rows = add_group_stats(rows, {"_spread": F.stddev_pop("_power")}, by, how, small)
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_group_size"))
    sizes = groups.select(F.col("_group_size").alias("_of")).distinct()
    # the scale of a size goes to the groups first: rows are never joined on a size that many groups share
    scale = groups.join(full_rank_spread(sizes, "_of", "_scale"), F.col("_group_size") == F.col("_of"))
    scale = scale.select(*by, "_scale")
    rows = join_back(rows, F.broadcast(scale) if small else scale, by, by)
    value = safe_div(F.col("_power"), F.col("_size") * F.col("_spread") * F.col("_scale"))
    return rows.withColumn(out, value).drop("_size", "_mean", "_power", "_spread", "_scale")


def add_mmc_vector(
    df: DataFrame, target: str, meta: str, out: str, by: Sequence[str], how: str, small: bool
) -> DataFrame:
    t = nan_if_null(target)
    rows = add_normal_scores(df, {"_m": meta}, by, how, small)
    rows = add_group_stats(rows, {"_size": F.count(F.lit(1)), "_mean": F.avg(t)}, by, how, small)
    rows = rows.withColumn("_t", t - F.col("_mean"))
    rows = add_group_stats(
        rows, {"_mt": F.sum(F.col("_m") * F.col("_t")), "_mm": F.sum(F.col("_m") * F.col("_m"))}, by, how, small
    )
    rest = F.col("_t") - F.col("_m") * safe_div(F.col("_mt"), F.col("_mm"))
    return rows.withColumn(out, F.lit(MMC_FACTOR) / F.col("_size") * rest).drop(
        "_m", "_size", "_mean", "_t", "_mt", "_mm"
    )


def full_rank_spread(sizes: DataFrame, size: str, out: str) -> DataFrame:
    """For each distinct ``n``: standard deviation of the signed power of the normal scores of ranks 1..n.

    The scores are symmetric around zero, so this is the root of the mean of ``|score| ** 3``, and the lower
    half of the ranks gives half of the sum. Ranks are generated in blocks that are spread over the cluster.
    """
    half = F.ceil(F.col(size) / 2)
    blocks = sizes.select(
        size, F.explode(F.sequence(F.lit(0), ((half - 1) / RANGE_BLOCK).cast("long"))).alias("_block")
    ).repartition(size, "_block")
    first = F.col("_block") * RANGE_BLOCK + 1
    last = F.least(half, (F.col("_block") + 1) * RANGE_BLOCK)
    ranks = blocks.select(size, F.explode(F.sequence(first, last)).alias("_rank"))
    scored = with_norm_ppf(ranks, {"_score": (F.col("_rank") - 0.5) / F.col(size)})
    # the middle rank of an odd size has score 0 and may count twice
    total = F.sum(F.pow(F.abs("_score"), F.lit(3.0)))
    return scored.groupBy(size).agg(F.sqrt(2.0 * total / F.col(size)).alias(out))


def erawise(
    df: DataFrame,
    score: Callable[[Column, Column, Column], Column],
    preds: str | Sequence[str],
    target: str = "target",
    meta: str | None = "meta",
    era: str = "era",
    name: str | None = None,
    strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """U1. User score per era given as a Column aggregate of (target, preds, meta).

    ``preds`` arrive as normal scores, ``meta`` as given. The aggregate is combined map-side, so eras of any
    size work. Returns ``era`` and one column named after the function.
    """
    columns = _as_list(preds)
    part, meta_column = _meta_or_nan(df, meta)
    label = name or function_name(score)

    def build(group: DataFrame, how: str, small: bool) -> DataFrame:
        scored = scoring_columns(group, columns, target, meta_column, [era], how, small)
        return scored.groupBy(era).agg(score(F.col("t"), F.col("p"), F.col("raw_meta")).alias(label))

    return per_group(part.where(F.col(era).isNotNull()), [era], strategy, build, hot_rows)


def erawise_pandas(
    df: DataFrame,
    score: Callable,
    preds: str | Sequence[str],
    target: str = "target",
    meta: str | None = "meta",
    era: str = "era",
    name: str | None = None,
    max_era_rows: int | None = None,
) -> DataFrame:
    """U1. User score per era given as a function of three numpy arrays, with the same values as in ``erawise``.

    Such a function needs one era in one task. Given ``max_era_rows``, the largest era is measured first, and
    beyond it an error points to ``erawise``, which has no such bound.
    """
    columns = _as_list(preds)
    part, meta_column = _meta_or_nan(df, meta)
    part = part.where(F.col(era).isNotNull())
    largest = profile_groups(part, [era], max_era_rows).largest if max_era_rows is not None else 0
    if max_era_rows is not None and largest > max_era_rows:
        raise ValueError(
            f"the largest era has {largest} rows, above max_era_rows={max_era_rows}; "
            "express the score as a Column aggregate and use erawise()"
        )
    names = [f"_pred_{i}" for i in range(len(columns))]
    rows = part.select(
        F.col(era).alias("era"),
        nan_if_null(target).alias("t"),
        nan_if_null(meta_column).alias("m"),
        *[F.col(c).alias(n) for c, n in zip(columns, names)],
    )
    if len(names) > 1:
        rows = add_ensemble(rows, names, "p", ["era"], "window", True)
    else:
        rows = add_normal_scores(rows, {"p": names[0]}, ["era"], "window", True)
    label = name or function_name(score)
    era_type = df.schema[era].dataType.simpleString()

    def score_one(key, pdf):
        value = score(pdf["t"].to_numpy(), pdf["p"].to_numpy(), pdf["m"].to_numpy())
        return pd.DataFrame({"era": [key[0]], "score": [float(value)]})

    scored = rows.select("era", "t", "p", "m").groupBy("era").applyInPandas(
        score_one, f"era {era_type}, score double"
    )
    return scored.select(F.col("era").alias(era), F.col("score").alias(label))


@dataclass(frozen=True)
class MergeableScore:
    """U1. A user score in four functions, for arrays of any era size.

    ``start()`` gives an empty state, ``add(state, t, p, m)`` takes in the arrays of a batch of rows of one era,
    ``merge(a, b)`` joins two states of the same era, ``finish(state)`` gives the score. States are pickled between tasks and
    should not grow with the rows; the order of rows and of merges is open.
    """

    start: Callable
    add: Callable
    merge: Callable
    finish: Callable
    __name__: str = "score"


def erawise_mergeable(
    df: DataFrame,
    score: MergeableScore,
    preds: str | Sequence[str],
    target: str = "target",
    meta: str | None = "meta",
    era: str = "era",
    name: str | None = None,
    strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """U1. User score per era from a ``MergeableScore``, with the same values as in ``erawise``.

    Each task adds its Arrow batches to one state per era, and states are merged by a tree of groups: a task holds a batch
    and states, never an era.
    """
    columns = _as_list(preds)
    part, meta_column = _meta_or_nan(df, meta)
    kind = df.schema[era].dataType.simpleString()
    states = f"era {kind}, part int, state binary"

    def begin(batches):
        import pickle

        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby("era", sort=False):
                state = held[key] if key in held else score.start()
                held[key] = score.add(state, rows["t"].to_numpy(), rows["p"].to_numpy(), rows["m"].to_numpy())
        part_id = TaskContext.get().partitionId()
        yield pd.DataFrame({"era": list(held), "part": part_id, "state": [pickle.dumps(s) for s in held.values()]})

    def join(key, pdf):
        import pickle

        return pd.DataFrame({"era": [key[0]], "part": [key[1]], "state": [pickle.dumps(reduce(score.merge, map(pickle.loads, pdf["state"])))]})

    def end(batches):
        import pickle

        for batch in batches:
            yield pd.DataFrame({"era": batch["era"], "score": [float(score.finish(pickle.loads(s))) for s in batch["state"]]})

    def build(group: DataFrame, how: str, small: bool) -> DataFrame:
        scored = scoring_columns(group, columns, target, meta_column, [era], how, small)
        rows = scored.select(F.col(era).alias("era"), "t", "p", F.col("raw_meta").alias("m"))
        found = rows.mapInPandas(begin, states)
        for step in MERGE_STEPS:
            few = (F.floor(F.col("part") / step).cast("int") if step else F.lit(0)).alias("part")
            found = found.groupBy("era", few).applyInPandas(join, states)
        done = found.select("era", "state").mapInPandas(end, f"era {kind}, score double")
        return done.select(F.col("era").alias(era), F.col("score").alias(name or score.__name__))

    return per_group(part.where(F.col(era).isNotNull()), [era], strategy, build, hot_rows)


@dataclass(frozen=True)
class UserScore:
    """U1. A user metric: a score per era and the aggregate over eras (A14 unless given).

    ``score`` takes Columns of (target, preds, meta) and is an aggregate, or numpy arrays if ``arrays`` is set, or
    is a ``MergeableScore``.
    """

    score: Callable
    over_eras: Callable[[str], Column] = mean_score
    arrays: bool = False

    @property
    def __name__(self) -> str:
        return function_name(self.score)

    def value(self, df: DataFrame, preds, target: str = "target", meta: str | None = "meta", era: str = "era", strategy: str = "auto") -> DataFrame:
        """One row with the column ``value``."""
        options = {"name": "score"} if self.arrays else {"name": "score", "strategy": strategy}
        scored = erawise_mergeable if isinstance(self.score, MergeableScore) else erawise_pandas if self.arrays else erawise
        per_era = scored(df, self.score, preds, target, meta, era, **options)
        return per_era.agg(self.over_eras("score").alias("value"))


def function_name(fn: Callable) -> str:
    """Metric name of a callable; partials are unwrapped."""
    while isinstance(fn, partial):
        fn = fn.func
    return fn.__name__


def _one_metric(df, metric, preds, target, meta, era, options) -> DataFrame:
    if era is None:
        return global_scores(df, preds, target, meta, [metric]).select(metric)
    scores = era_scores(df, preds, target, meta, era, [metric], **options)
    return scores.agg(mean_score(metric).alias(metric))


def _meta_or_nan(df: DataFrame, meta: str | None) -> tuple[DataFrame, str]:
    if meta:
        return df, meta
    return df.withColumn("_no_meta", F.lit(NAN)), "_no_meta"


def _as_list(preds: str | Sequence[str]) -> list[str]:
    return [preds] if isinstance(preds, str) else list(preds)
