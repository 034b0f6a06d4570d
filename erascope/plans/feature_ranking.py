"""Rank all features of a panel by information about the target."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from erascope import schema as S
from erascope import splits
from erascope.operators.counts import count_pairs_with_target
from erascope.operators.information import pair_information
from erascope.operators.lazy_ordering import lazy_greedy_order
from erascope.operators.ordering import CRITERIA, DENSE, greedy_order, named_order
from erascope.operators.projection import before_era, target_code
from erascope.session import scratch_path
from erascope.sources.catalogue import merge_feature_sets


def rank_features(
    panel: DataFrame,
    features: Sequence[str] | None = None,
    target: str = "target",
    era_1: int = splits.TRAIN_ERA_1,
    criteria: Sequence[str] = CRITERIA,
    top_k: int | None = None,
) -> DataFrame:
    """``(method, pos, feature)`` over the training eras.

    Lists of up to ``DENSE`` features are read once to count pairs; everything after works on one row per feature pair,
    which is written down once so that no later step counts again. Longer lists have no pair table: the training rows
    are written down with the features and the class only, and each pick is counted against the candidates that can still win.
    """
    spark = panel.sparkSession
    names = list(features or S.select_names(panel, S.FEATURE_PREFIX))
    rows = before_era(panel, era_1)
    if len(names) > DENSE:
        path = scratch_path(spark, "ranked-rows")
        rows.select(*names, target).write.parquet(path)
        stored = spark.read.parquet(path)
        orders = [lazy_greedy_order(stored, names, target_code(target), c, top_k) for c in criteria]
        return named_order(reduce(lambda a, b: a.unionByName(b), orders), names)
    counts = count_pairs_with_target(rows, names, target_code(target))
    path = scratch_path(spark, "pair-information")
    pair_information(counts).write.parquet(path)
    pairs = spark.read.parquet(path)
    return named_order(greedy_order(pairs, criteria, top_k), names)


def rank_and_store(panel: DataFrame, data_dir: str, **options) -> DataFrame:
    """F10 with S5: orders become feature sets named after the criteria."""
    order = rank_features(panel, **options)
    merge_feature_sets(order, data_dir)
    return order
