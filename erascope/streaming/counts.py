"""Contingency counts kept up to date over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from erascope import schema as S
from erascope.operators.counts import checked_class, count_pairs_with_target, pair_entries

COUNT_COLUMNS = ("f1", "f2", "u", "v", "y", "n")


def pair_count_stream(
    stream: DataFrame, features: Sequence[str], code: Column, levels: int = S.FEATURE_LEVELS
) -> DataFrame:
    """Running pair counts as one streaming aggregate (``complete`` or ``update`` mode).

    The state is one row per cell, so this form suits short feature lists.
    """
    rows = stream.select(checked_class(code, levels).alias("y"), *features).where(F.col("y").isNotNull())
    pairs = rows.select(F.inline(pair_entries(features, levels)), "y")
    return pairs.groupBy("f1", "f2", "u", "v", "y").agg(F.count(F.lit(1)).alias("n"))


def accumulate_pair_counts(
    stream: DataFrame,
    features: Sequence[str],
    code: Column,
    path: str,
    checkpoint: str,
    levels: int = S.FEATURE_LEVELS,
    **options,
) -> StreamingQuery:
    """Counts are additive: each micro-batch is counted like a table and stored under its batch id.

    A batch that is run again replaces its own partition, so every row counts once. Wide feature lists
    use the tiled counter, and no state is kept between batches.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = count_pairs_with_target(batch, features, code, levels, **options)
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def accumulated_counts(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all batches so far: ``(f1, f2, u, v, y, n)``."""
    keys = COUNT_COLUMNS[:-1]
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))
