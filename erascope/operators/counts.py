"""Contingency counts of small-integer features.

Features are known by position in the caller's list. Counts are long tables; an absent row is a zero.
Pair tables hold ``f1 <= f2``; ``mirrored`` gives the full square.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope import schema as S

# Rows are first counted per full feature tuple when the number of possible tuples is below this.
MAX_TUPLES = 500_000
# Features per tile: a task holds levels * (levels * TILE) ** 2 longs, 40 MB at 200 and five levels.
TILE = 200
# Rows that a one-hot product is taken over at once, whatever the size of the Arrow batches.
PIECE = 8192


def checked(column: str, levels: int = S.FEATURE_LEVELS) -> Column:
    """Value of a feature; one outside ``0 .. levels-1`` (or null) fails the job."""
    c = F.col(column)
    message = F.concat(F.lit(f"{column}: value out of range: "), F.coalesce(c.cast("string"), F.lit("null")))
    return F.when(c.between(0, levels - 1), c.cast("tinyint")).otherwise(F.raise_error(message).cast("tinyint"))


def checked_class(code: Column, levels: int = S.FEATURE_LEVELS) -> Column:
    """Target class; null stays null (such rows take no part), one outside ``0 .. levels-1`` fails the job."""
    message = F.concat(F.lit("target class out of range: "), code.cast("string"))
    known = code.isNull() | code.between(0, levels - 1)
    return F.when(known, F.when(known, code).cast("tinyint")).otherwise(F.raise_error(message).cast("tinyint"))


def count_values(df: DataFrame, features: Sequence[str], levels: int = S.FEATURE_LEVELS) -> DataFrame:
    """A7. ``(f, x, n)``. Rows are unpivoted and combined map-side."""
    entries = [F.struct(F.lit(i).alias("f"), checked(c, levels).alias("x")) for i, c in enumerate(features)]
    return df.select(F.inline(F.array(*entries))).groupBy("f", "x").agg(F.count(F.lit(1)).alias("n"))


def count_with_target(
    df: DataFrame, features: Sequence[str], code: Column, levels: int = S.FEATURE_LEVELS, weight: str | None = None
) -> DataFrame:
    """A8. ``(f, x, y, n)``; ``code`` is the target class, rows without one take no part. A row counts ``weight`` times."""
    entries = [F.struct(F.lit(i).alias("f"), checked(c, levels).alias("x")) for i, c in enumerate(features)]
    times = F.col(weight) if weight else F.lit(1)
    rows = df.select(checked_class(code, levels).alias("y"), *features, times.cast("long").alias("_n")).where(F.col("y").isNotNull())
    long = rows.select(F.inline(F.array(*entries)), "y", "_n")
    return long.groupBy("f", "x", "y").agg(F.sum("_n").alias("n"))


def pair_entries(features: Sequence[str], levels: int = S.FEATURE_LEVELS) -> Column:
    """Array of ``(f1, f2, u, v)`` for all ``f1 <= f2`` of a row."""
    values = [checked(c, levels) for c in features]
    return F.array(
        *[
            F.struct(F.lit(i).alias("f1"), F.lit(j).alias("f2"), values[i].alias("u"), values[j].alias("v"))
            for i in range(len(values))
            for j in range(i, len(values))
        ]
    )


def count_pairs_with_target(
    df: DataFrame,
    features: Sequence[str],
    code: Column,
    levels: int = S.FEATURE_LEVELS,
    method: str = "auto",
    tile: int = TILE,
    max_tasks: int | None = None,
) -> DataFrame:
    """A10. ``(f1, f2, u, v, y, n)`` for ``f1 <= f2``; rows without a target class take no part.

    ``tuples``: rows are counted per distinct (features, class) tuple first, and only the tuples are
    expanded to pairs; there are at most ``levels ** (J + 1)`` of them. ``tiles``: one-hot products in
    Arrow batches, one partial table per task; each pair of feature tiles reads only its own columns.
    ``auto`` takes tuples while their possible number is small.
    """
    if method not in ("auto", "tuples", "tiles"):
        raise ValueError(f"unknown method {method!r}")
    rows = df.select(checked_class(code, levels).alias("_y"), *dict.fromkeys(features))
    rows = rows.where(F.col("_y").isNotNull())
    if method == "auto":
        method = "tuples" if few_tuples(features, levels) else "tiles"
    if method == "tuples":
        tuples = count_tuples(df, features, code, levels)
        pairs = tuples.select(F.inline(pair_entries(features, levels)), F.col("_y").alias("y"), "_n")
        return pairs.groupBy("f1", "f2", "u", "v", "y").agg(F.sum("_n").alias("n"))
    return _tiled(rows, list(features), levels, tile, max_tasks)


def few_tuples(features: Sequence[str], levels: int = S.FEATURE_LEVELS) -> bool:
    """Whether rows are counted per distinct feature tuple first."""
    return levels ** (len(features) + 1) <= MAX_TUPLES


def count_tuples(df: DataFrame, features: Sequence[str], code: Column, levels: int = S.FEATURE_LEVELS) -> DataFrame:
    """``(_y, *features, _n)``: how many rows have each tuple of values; rows without a target class take no part."""
    names = list(dict.fromkeys(features))
    rows = df.select(checked_class(code, levels).alias("_y"), *names).where(F.col("_y").isNotNull())
    return rows.groupBy("_y", *names).agg(F.count(F.lit(1)).alias("_n"))


def count_pairs_between(
    rows: DataFrame, features: Sequence[str], left: Sequence[int], right: Sequence[int], levels: int = S.FEATURE_LEVELS, weight: str | None = None
) -> DataFrame:
    """``(f1, f2, y, cells)`` for every feature of ``left`` with every one of ``right``, by position.

    ``rows`` have the features and the class ``_y``; a row counts ``weight`` times. ``cells`` counts the values ``(u, v)`` in order. A task holds as many
    features of ``left`` at once as fit with ``right`` into the cells of two full tiles, and reads the columns of these only.
    """
    size = max(1, TILE * TILE // max(1, len(right)))
    cells = [f"c{u}_{v}" for u in range(levels) for v in range(levels)]
    schema = "f1 int, f2 int, y tinyint, " + ", ".join(f"{c} bigint" for c in cells)
    partial = None
    for start in range(0, len(left), size):
        some = list(left[start : start + size])
        needed = dict.fromkeys([features[i] for i in some] + [features[i] for i in right])
        part = rows.select("_y", *needed, *([weight] if weight else [])).coalesce(partial_tasks(rows.sparkSession))
        counted = part.mapInArrow(_one_hot_counter(list(features), some, list(right), levels, ordered=False, weight=weight), schema)
        partial = counted if partial is None else partial.unionAll(counted)
    summed = partial.groupBy("f1", "f2", "y").agg(*[F.sum(c).alias(c) for c in cells])
    return summed.select("f1", "f2", "y", F.array(*cells).alias("cells"))


def count_pairs(df: DataFrame, features: Sequence[str], levels: int = S.FEATURE_LEVELS, **options) -> DataFrame:
    """A9. ``(f1, f2, u, v, n)`` for ``f1 <= f2``, over all rows."""
    return count_pairs_with_target(df, features, F.lit(0), levels, **options).drop("y")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Full square of a pair table: off-diagonal rows are added with both sides swapped."""
    swap = {"f1": "f2", "f2": "f1", "u": "v", "v": "u"}
    other = pairs.where(F.col("f1") < F.col("f2")).select(*[F.col(swap.get(c, c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(other)


def target_counts_of(pairs: DataFrame) -> DataFrame:
    """A11. ``(f, x, y, n)`` from pair counts: the diagonal of the pair table."""
    diagonal = pairs.where(F.col("f1") == F.col("f2"))
    return diagonal.groupBy(F.col("f2").alias("f"), F.col("v").alias("x"), "y").agg(F.sum("n").alias("n"))


def pair_counts_of(pairs: DataFrame) -> DataFrame:
    """A12. ``(f1, f2, u, v, n)``: pair counts summed over the target class."""
    return pairs.groupBy("f1", "f2", "u", "v").agg(F.sum("n").alias("n"))


def partial_tasks(spark: SparkSession) -> int:
    """Upper limit for tasks that each emit a whole partial table: enough to keep every core busy."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _tiled(rows: DataFrame, features: list[str], levels: int, tile: int, max_tasks: int | None) -> DataFrame:
    tiles = [range(s, min(s + tile, len(features))) for s in range(0, len(features), tile)]
    pairs_of_tiles = len(tiles) * (len(tiles) + 1) // 2
    # all pairs of tiles together emit about as many partial tables as there are tasks at once
    tasks = max_tasks or max(1, partial_tasks(rows.sparkSession) // pairs_of_tiles)
    cells = [f"c{u}_{v}" for u in range(levels) for v in range(levels)]
    schema = "f1 int, f2 int, y tinyint, " + ", ".join(f"{c} bigint" for c in cells)
    partial = None
    for a, left in enumerate(tiles):
        for right in tiles[a:]:
            needed = dict.fromkeys([features[i] for i in left] + [features[i] for i in right])
            # fewer, longer tasks: each emits one partial table whatever its number of rows
            part = rows.select("_y", *needed).coalesce(tasks)
            counted = part.mapInArrow(_one_hot_counter(features, left, right, levels), schema)
            partial = counted if partial is None else partial.unionAll(counted)
    summed = partial.groupBy("f1", "f2", "y").agg(*[F.sum(c).alias(c) for c in cells])
    entries = [
        F.struct(
            F.lit(u).cast("tinyint").alias("u"), F.lit(v).cast("tinyint").alias("v"), F.col(f"c{u}_{v}").alias("n")
        )
        for u in range(levels)
        for v in range(levels)
    ]
    long = summed.select("f1", "f2", F.inline(F.array(*entries)), "y")
    return long.where(F.col("n") > 0).select("f1", "f2", "u", "v", "y", "n")


def _one_hot_counter(
    features: list[str], left: Sequence[int], right: Sequence[int], levels: int, ordered: bool = True, weight: str | None = None
):
    """Function for ``mapInArrow``: counts of all value pairs of two feature tiles, per target class.

    ``ordered`` keeps only pairs whose first feature does not stand behind the second.
    """
    same = list(left) == list(right)
    first, second = list(left), list(right)

    def count(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((levels, len(first) * levels, len(second) * levels), dtype=np.int64)
        seen = False

        def one_hot(batch, positions):
            columns = []
            for p in positions:
                column = batch.column(batch.schema.get_field_index(features[p]))
                values = column.to_numpy(zero_copy_only=False)
                if column.null_count or (len(values) and (values.min() < 0 or values.max() >= levels)):
                    raise ValueError(f"{features[p]}: value out of range")
                columns.append(values)
            block = np.stack(columns, axis=1)
            hot = block[:, :, None] == np.arange(levels, dtype=block.dtype)
            # float32 products are exact: a piece has far fewer than 2**24 rows
            return hot.reshape(len(block), -1).astype(np.float32)

        pieces = (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE))
        for batch in pieces:
            seen = True
            y = batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False)
            a = one_hot(batch, first)
            b = a if same else one_hot(batch, second)
            if weight:
                # in double, where products are exact up to 2**53 rows
                a = a * batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            for k in np.unique(y):
                pick = y == k
                total[k] += (a[pick].T @ b[pick]).astype(np.int64)
        if not seen:
            return
        fi, fj = np.meshgrid(first, second, indexing="ij")
        upper = (fi <= fj).ravel() if ordered else np.ones(fi.size, dtype=bool)
        f1 = fi.ravel()[upper].astype(np.int32)
        f2 = fj.ravel()[upper].astype(np.int32)
        for k in range(levels):
            square = total[k].reshape(len(first), levels, len(second), levels).transpose(0, 2, 1, 3)
            flat = square.reshape(len(first) * len(second), levels * levels)[upper]
            keep = flat.any(axis=1)
            if not keep.any():
                continue
            arrays = [pa.array(f1[keep]), pa.array(f2[keep]), pa.array(np.full(keep.sum(), k, dtype=np.int8))]
            arrays += [pa.array(np.ascontiguousarray(flat[keep, c])) for c in range(levels * levels)]
            names = ["f1", "f2", "y", *[f"c{u}_{v}" for u in range(levels) for v in range(levels)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return count
