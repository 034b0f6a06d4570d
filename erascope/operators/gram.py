"""Cross products of columns summed over all rows.

Wide matrices are tables of square tiles: a tile is one row with its cells as an array. Each task emits one partial
tile per pair of column bands, partial tiles are added up by a tree of small groups, and whoever needs the whole
matrix collects one row per tile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erascope.functions.numeric import nan_if_null
from erascope.operators.counts import partial_tasks

ONE = "1"
MAX_EXPRESSION_COLUMNS = 12
# Columns of a band; a tile has at most the square of it.
BAND = 64
# Partial tiles that are added up at once.
FAN_IN = 16


def gram(
    df: DataFrame, columns: Sequence[str], method: str = "auto", max_tasks: int | None = None
) -> DataFrame:
    """``(i, j, value)`` with ``i <= j``: sums of products of columns by position, in double.

    The name ``"1"`` stands for a constant one, so that counts and sums come out of the same pass.
    ``expressions`` keeps all products in one map-side aggregate; ``blocks`` takes the cells of ``gram_tiles``. A null
    or NaN value fails the job.
    """
    if _method(columns, method) == "expressions":
        return _by_expressions(df, columns)
    size = len(columns)
    width = F.least(F.lit(BAND), F.lit(size) - F.col("bj") * BAND)
    cells = gram_tiles(df, columns, max_tasks).select("bi", "bj", width.alias("w"), F.posexplode("cells").alias("at", "value"))
    placed = cells.select(
        (F.col("bi") * BAND + F.floor(F.col("at") / F.col("w"))).cast("int").alias("i"), (F.col("bj") * BAND + F.col("at") % F.col("w")).alias("j"), "value"
    )
    return placed.where("i <= j")


def _method(columns: Sequence[str], method: str) -> str:
    if method not in ("auto", "expressions", "blocks"):
        raise ValueError(f"unknown method {method!r}")
    if method == "auto":
        return "expressions" if len(columns) <= MAX_EXPRESSION_COLUMNS else "blocks"
    return method


def gram_tiles(df: DataFrame, columns: Sequence[str], max_tasks: int | None = None) -> DataFrame:
    """``(bi, bj, cells)`` with ``bi <= bj``: products of the column bands ``bi`` and ``bj``, cells row by row."""
    tasks = max_tasks or partial_tasks(df.sparkSession)
    real = [c for c in dict.fromkeys(columns) if c != ONE]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in real]).coalesce(tasks)
    partial = rows.mapInArrow(_tile_products(list(columns), BAND), "bi int, bj int, part int, cells array<double>")
    return add_tiles(partial, tasks)


def add_tiles(partial: DataFrame, parts: int) -> DataFrame:
    """Sums of the partial tiles ``(bi, bj, part, cells)`` with ``part < parts``; a group adds up at most ``FAN_IN``."""
    while parts > 1:
        last = parts <= FAN_IN
        group = (F.lit(0) if last else F.floor(F.col("part") / FAN_IN).cast("int")).alias("part")
        few = partial.groupBy("bi", "bj", group).agg(F.collect_list("cells").alias("all"))
        total = F.aggregate(
            F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda sums, cells: F.zip_with(sums, cells, lambda x, y: x + y)
        )
        partial = few.select("bi", "bj", "part", total.alias("cells"))
        parts = -(-parts // FAN_IN)
    return partial.select("bi", "bj", "cells")


def gram_matrix(df: DataFrame, columns: Sequence[str], method: str = "auto") -> np.ndarray:
    """The symmetric matrix of cross products on the driver: ``size ** 2`` numbers, a count of columns, not of rows."""
    if _method(columns, method) == "expressions":
        return to_matrix(_by_expressions(df, columns), len(columns))
    size = len(columns)
    matrix = np.zeros((size, size))
    for row in gram_tiles(df, columns).collect():
        i, j = row["bi"] * BAND, row["bj"] * BAND
        tile = np.array(row["cells"]).reshape(min(BAND, size - i), -1)
        matrix[i : i + tile.shape[0], j : j + tile.shape[1]] = tile
        matrix[j : j + tile.shape[1], i : i + tile.shape[0]] = tile.T
    return matrix


def to_matrix(products: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix on the driver: ``size ** 2`` numbers, a count of columns, not of rows."""
    matrix = np.zeros((size, size))
    for row in products.collect():
        matrix[row["i"], row["j"]] = matrix[row["j"], row["i"]] = row["value"]
    return matrix


def _by_expressions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    def finite(name: str):
        if name == ONE:
            return F.lit(1.0)
        value = nan_if_null(name)
        return F.when(~F.isnan(value), value).otherwise(
            F.raise_error(F.lit(f"{name}: missing value in a cross product")).cast("double")
        )

    rows = df.select(*[finite(c).alias(f"_{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    entries = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.coalesce(F.col(f"s{i}_{j}"), F.lit(0.0)).alias("value")
        )
        for i, j in pairs
    ]
    return sums.select(F.inline(F.array(*entries)))


def _tile_products(columns: list[str], band: int):
    def products(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        size = len(columns)
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = np.ones((batch.num_rows, size))
            for k, name in enumerate(columns):
                if name != "1":
                    block[:, k] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            if np.isnan(block).any():
                raise ValueError("missing value in a cross product")
            total += block.T @ block
        part = TaskContext.get().partitionId()
        bands = range(-(-size // band))
        tiles = [(i, j) for i in bands for j in bands if i <= j]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in tiles], pa.int32()), pa.array([j for _, j in tiles], pa.int32()), pa.array([part] * len(tiles), pa.int32()),
                pa.array([total[i * band : (i + 1) * band, j * band : (j + 1) * band].ravel() for i, j in tiles], pa.list_(pa.float64())),
            ],
            names=["bi", "bj", "part", "cells"],
        )

    return products
