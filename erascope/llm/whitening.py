"""Whitened embeddings by a covariance with multiplicities.

Vectors are rounded down to whole steps, and identical vectors become one row with their number of copies. The
copies (or one each, if asked for) weigh the fit: exact sums per dimension, then centred products of matrices,
one per task, whose entries Spark adds up. Only the matrix, as wide as a vector, reaches the driver. Each distinct
vector is whitened once and joined back to its rows; vectors with very many copies, of which there can be only a few, are
joined by broadcast, so that no task gets all rows of one vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope.llm.common import staged

STEPS = 64  # steps of an entry per unit
SHIFT = 1_000_000
COMPONENTS = 32
FARTHEST = 2.0**52  # entries are held within this many steps, so that they stay whole numbers
HOT_SHARE = 1024  # a vector with more than one in so many rows is joined by broadcast: fewer than 1,024 of them
LOW_BITS = 26
LONGEST = (1 << 63) - 1

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def stepped(vector: Column, width: int) -> Column:
    """Entries in whole steps, shifted; shorter vectors are filled up with zeros."""
    steps = F.transform(
        vector,
        lambda c: F.floor(F.greatest(F.least(c.cast("double") * STEPS, F.lit(FARTHEST)), F.lit(-FARTHEST))).cast("long") + SHIFT,
    )
    return F.concat(steps, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size(vector)))


def complete(vector: Column) -> Column:
    """Whether ``vector`` is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )


def matrix(batch: pd.DataFrame, column: str = "x") -> np.ndarray:
    return np.stack(batch[column].to_numpy()) if len(batch) else np.zeros((0, 0))


def total_products(rows: DataFrame, centred: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """Sum over ``rows`` of ``weight`` times the outer product of a row of ``centred``; entries are summed by Spark."""
    i, j = np.triu_indices(width)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                values = centred(batch)
                total += (values * batch["weight"].to_numpy(np.float64)[:, None]).T @ values
        yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})

    found = rows.mapInPandas(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    result = np.zeros((width, width))
    for row in found:
        result[row["i"], row["j"]] = result[row["j"], row["i"]] = row["value"]
    return result


def exact_sums(distinct: DataFrame, width: int) -> list[int]:
    """Weighted sum of ``x`` per dimension, exact: high and low bits are summed apart."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            if len(batch):
                x, weight = matrix(batch), batch["weight"].to_numpy(np.int64)
                high += weight @ (x >> LOW_BITS)
                low += weight @ (x & ((1 << LOW_BITS) - 1))
        yield pd.DataFrame({"place": np.arange(width), "high": high, "low": low})

    summed = distinct.mapInPandas(partial, "place int, high long, low long").groupBy("place").agg(
        F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")
    )
    totals = [0] * width
    for row in summed.collect():
        totals[row["place"]] = (int(row["high"]) << LOW_BITS) + int(row["low"])
    return totals


def squared_deviations(steps: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * step - rest)^2`` per row, exact; null where it is more than a long holds."""
    if not len(steps):
        return []
    largest = int(np.abs(steps).max()) * n + max(map(abs, rest))
    if largest * largest * steps.shape[1] <= LONGEST:
        off = steps * np.int64(n) - np.array(rest, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(s) - r) ** 2 for s, r in zip(row, rest, strict=True)) for row in steps]
    return [v if v <= LONGEST else None for v in exact]


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and the matrix that projects on their unit eigenvectors over the roots.

    Eigenvalues that are zero within rounding have no column.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:most], 0.0), vectors[:, ::-1][:, :most]
    rank = int((values > values[:1].max(initial=0.0) * len(covariance) * np.finfo(float).eps).sum())
    return values, vectors[:, :rank] / np.sqrt(values[:rank])


def whiten(rows: DataFrame, vector: str = "embedding", name: str = "vec_id", components: int = COMPONENTS, by_copies: bool = True) -> DataFrame:
    """The columns of ``SCHEMA`` for every row of ``rows`` with a complete vector and each of up to ``components`` components.

    Vectors that are null or hold null or non-finite entries have no rows. Shorter vectors count as filled up with
    zeros to the longest one; entries beyond 2^52 steps count as that bound. Rows with equal or null ids each get
    their rows. ``by_copies=False`` fits on each distinct vector once; ``n`` is then the number of distinct ones.
    Components without variance have null ``whitened`` and are left out of ``identity_error``; a sum of squares
    beyond the range of a long is a null ``deviation``. No complete vector, or only empty ones: no rows.
    """
    spark = rows.sparkSession
    sound = rows.filter(complete(F.col(vector))).select(F.col(name).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    width = sound.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], SCHEMA)
    stepping = sound.select("vec_id", stepped(F.col("v"), width).alias("x"))
    copies = F.count(F.lit(1))
    distinct = staged(stepping.groupBy("x").agg(copies.alias("copies"), (copies if by_copies else F.lit(1).cast("long")).alias("weight")), "white-distinct")
    n = int(distinct.agg(F.sum("weight")).first()[0])
    sums = exact_sums(distinct, width)
    base = [s // n for s in sums]  # whole steps below the mean: what is left of a vector is a small whole number
    rest = [s - n * b for s, b in zip(sums, base, strict=True)]
    fraction = np.array([r / n for r in rest])
    whole = np.array(base, np.int64)

    def centred(batch: pd.DataFrame) -> np.ndarray:
        return (matrix(batch) - whole).astype(np.float64) - fraction

    covariance = total_products(distinct, centred, width) / n
    values, projection = principal(covariance, components)
    rank = projection.shape[1]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                deviation = pd.array(squared_deviations(matrix(batch) - whole, n, rest), dtype="Int64")
                yield pd.DataFrame({**batch[["x", "copies", "weight"]], "deviation": deviation, "white": list(centred(batch) @ projection)})

    schema = "x array<long>, copies long, weight long, deviation long, white array<double>"
    white = staged(distinct.mapInPandas(project, schema), "white-vectors")
    error = 0.0
    if rank:
        # a further entry 1 sums up the means
        def extended(batch: pd.DataFrame) -> np.ndarray:
            return np.hstack([matrix(batch, "white"), np.ones((len(batch), 1))])

        moments = total_products(white, extended, rank + 1) / n
        mean = moments[rank, :rank]
        error = float(np.abs(moments[:rank, :rank] - np.outer(mean, mean) - np.eye(rank)).max())
    every = int(distinct.agg(F.sum("copies")).first()[0]) if not by_copies else n
    hot = F.broadcast(white.filter(F.col("copies") > max(1, every // HOT_SHARE)).select("x", "deviation", "white"))
    cold = white.filter(F.col("copies") <= max(1, every // HOT_SHARE)).select("x", "deviation", "white")
    joined = stepping.join(hot, "x").unionByName(stepping.join(hot.select("x"), "x", "left_anti").join(cold, "x"))
    trace = float(np.trace(covariance))
    explained = F.lit([float(v) / trace if trace else 0.0 for v in values])
    numbered = joined.select("vec_id", "deviation", "white", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("component"))
    return numbered.select(
        "vec_id",
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.get("white", F.col("component") - 1).alias("whitened"),
        F.get(explained, F.col("component") - 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
