"""Per-era transforms (W1-W9). ``by=("era",)`` groups by era; ``by=()`` treats all rows as one group.

Rows without an era form a group of their own, whichever the plan; panels are checked to have none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope.functions import ranking
from erascope.functions.numeric import nan_if_null, safe_div, signed_power
from erascope.functions.ranking import (
    HOT_GROUP_ROWS,
    add_average_ranks,
    add_group_stats,
    as_rankable,
    per_group,
    written,
)

BY_ERA = ("era",)

# Row means of standardized predictions are rounded before they are ranked again, so that scores that
# cancel exactly tie instead of being ordered by floating-point noise.
ENSEMBLE_DIGITS = 12


def average_rank(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = BY_ERA, strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """W1. Average rank (ties share their mean rank) of float32 values; ``columns``: output -> input."""

    def build(part: DataFrame, how: str, small: bool) -> DataFrame:
        return _ranked(part, columns, by, how, small).drop("_n")

    return per_group(df, by, strategy, build, hot_rows)


def center(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = BY_ERA, strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """W2. Value minus the mean of its group."""
    return _with_stats(
        df, by, strategy, hot_rows,
        {f"_mean_{o}": F.avg(nan_if_null(c)) for o, c in columns.items()},
        {o: nan_if_null(c) - F.col(f"_mean_{o}") for o, c in columns.items()},
    )


def gaussianize(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = BY_ERA, strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """W3 / W9. Normal score of the average rank; the denominator counts all rows of the group."""

    def build(part: DataFrame, how: str, small: bool) -> DataFrame:
        return add_normal_scores(part, columns, by, how, small)

    return per_group(df, by, strategy, build, hot_rows)


def exponentiate(df: DataFrame, columns: Mapping[str, str], exponent: float = 1.5) -> DataFrame:
    """W5. Signed power."""
    return df.withColumns({o: signed_power(nan_if_null(c), exponent) for o, c in columns.items()})


def orthogonal_projection(
    df: DataFrame, meta: str, vector: str, out: str, by: Sequence[str] = BY_ERA, strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """W6. Part of ``vector`` orthogonal to ``meta`` inside the group; NaN where ``meta`` is all zero."""
    m, v = nan_if_null(meta), nan_if_null(vector)
    return _with_stats(
        df, by, strategy, hot_rows,
        {"_mv": F.sum(m * v), "_mm": F.sum(m * m)},
        {out: v - m * safe_div(F.col("_mv"), F.col("_mm"))},
    )


def standardize(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = BY_ERA, strategy: str = "auto",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """W7. Value over the population standard deviation; NaN for a constant group."""
    return _with_stats(
        df, by, strategy, hot_rows,
        {f"_std_{o}": F.stddev_pop(nan_if_null(c)) for o, c in columns.items()},
        {o: safe_div(nan_if_null(c), F.col(f"_std_{o}")) for o, c in columns.items()},
    )


def ensemble(
    df: DataFrame, preds: Sequence[str], out: str = "ensemble", by: Sequence[str] = BY_ERA,
    strategy: str = "auto", hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """W8. Normal score of the mean of the standardized normal scores of several prediction columns."""

    def build(part: DataFrame, how: str, small: bool) -> DataFrame:
        return add_ensemble(part, preds, out, by, how, small)

    return per_group(df, by, strategy, build, hot_rows)


# Building blocks for a given plan ("window" or "prefix"), also used by the scores.


def add_normal_scores(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str], how: str, small: bool
) -> DataFrame:
    values = {o: f"_value_{o}" for o in columns}
    prepared = df.withColumns({values[o]: as_rankable(c) for o, c in columns.items()})
    return ranking.add_normal_scores(prepared, values, by, how, small).drop(*values.values())


def add_ensemble(
    df: DataFrame, preds: Sequence[str], out: str, by: Sequence[str], how: str, small: bool
) -> DataFrame:
    scores = {f"_g_{i}": p for i, p in enumerate(preds)}
    scored = add_normal_scores(df, scores, by, how, small)
    spread = {f"_s_{i}": F.stddev_pop(f"_g_{i}") for i in range(len(preds))}
    scored = add_group_stats(scored, spread, by, how, small)
    total = sum((safe_div(F.col(f"_g_{i}"), F.col(f"_s_{i}")) for i in range(len(preds))), F.lit(0.0))
    scored = scored.withColumn("_mean", F.round(total / len(preds), ENSEMBLE_DIGITS) + F.lit(0.0))
    scored = scored.drop(*scores, *spread)
    if how == "prefix":
        # the means are read twice, for their distinct values and for the rows: written down once
        scored = written(scored)
    return add_normal_scores(scored, {out: "_mean"}, by, how, small).drop("_mean")


def _ranked(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str], how: str, small: bool
) -> DataFrame:
    values = {o: f"_value_{o}" for o in columns}
    prepared = df.withColumns({values[o]: as_rankable(c) for o, c in columns.items()})
    return add_average_ranks(prepared, values, by, how, small, size="_n").drop(*values.values())


def _with_stats(
    df: DataFrame, by: Sequence[str], strategy: str, hot_rows: int,
    stats: Mapping[str, Column], results: Mapping[str, Column],
) -> DataFrame:
    def build(part: DataFrame, how: str, small: bool) -> DataFrame:
        return add_group_stats(part, stats, by, how, small).withColumns(dict(results)).drop(*stats)

    return per_group(df, by, strategy, build, hot_rows)
