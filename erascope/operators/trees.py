"""Boosted regression trees on small-integer features (L4).

Features have few values, so histograms are exact: a level of a tree needs, per open node, sampled feature and
value, the sum of residuals and the number of rows. Each task adds them up over its Arrow batches and emits one
partial table, Spark sums these and picks the best split of each node with a window; one row per node reaches the
driver. A tree of depth d is d such aggregates; leaf values follow from the sums of the last level.

Rows are not rewritten for a tree: tasks apply the trees grown since the residuals were last written, and residuals are
written anew every ``write_every`` trees, so that neither lineage nor this work grows with the rounds. Short feature lists are
first reduced to distinct feature tuples with their number of rows and sum of targets, which is all squared loss needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.functions.numeric import nan_if_null
from erascope.operators.counts import MAX_TUPLES, checked
from erascope.session import scratch_path
from erascope.sources.files import discard

# A split must gain more than this, and sums of residuals are divided by rows plus this.
LEAST_GAIN = 1e-6
SHRINKAGE = 1.0
# Gains are compared after rounding, so that equal splits tie whatever the order of summation.
GAIN_DECIMALS = 9


@dataclass(frozen=True)
class Tree:
    """One tree in heap order: the children of node k are 2k+1 (value up to the threshold) and 2k+2."""

    feature: np.ndarray  # position of the split feature, -1 in leaves
    threshold: np.ndarray
    value: np.ndarray  # of leaves, with the learning rate
    gain: np.ndarray
    rows: np.ndarray  # 0 where there is no node

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return Tree(
            np.full(size, -1, np.int32), np.zeros(size, np.int8), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        )

    def used(self) -> set[int]:
        return set(self.feature[self.feature >= 0].tolist())

    def nodes(self, columns: dict[int, np.ndarray], size: int, steps: int) -> np.ndarray:
        """Node of each row after up to ``steps`` splits."""
        at = np.zeros(size, np.int64)
        for _ in range(steps):
            split = self.feature[at]
            moved = np.zeros(size, bool)
            right = np.zeros(size, bool)
            for f in np.unique(split[split >= 0]).tolist():
                here = split == f
                moved |= here
                right |= here & (columns[f] > self.threshold[at])
            if not moved.any():
                break
            at = np.where(moved, 2 * at + 1 + right, at)
        return at

    def predict(self, columns: dict[int, np.ndarray], size: int) -> np.ndarray:
        return self.value[self.nodes(columns, size, len(self.feature).bit_length())]


@dataclass(frozen=True)
class TreeModel:
    """A base value and trees that are added to it."""

    features: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...]

    def transform(self, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        """Add ``prediction``. Only the features that some tree uses are sent to the workers."""
        names = list(features or self.features)
        if len(names) != len(self.features):
            raise ValueError(f"got {len(names)} features, the model was fitted on {len(self.features)}")
        used = sorted(set().union(*[t.used() for t in self.trees]))
        if not used:
            return df.withColumn("prediction", F.lit(self.base + sum(float(t.value[0]) for t in self.trees)))
        shared = df.sparkSession.sparkContext.broadcast((self.base, self.trees))

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            base, trees = shared.value
            for batch in batches:
                columns = {f: batch[f"x{f}"].to_numpy() for f in used}
                total = np.full(len(batch), base)
                for tree in trees:
                    total += tree.predict(columns, len(batch))
                yield pd.Series(total)

        values = F.struct(*[checked(names[f]).alias(f"x{f}") for f in used])
        return df.withColumn("prediction", score(values))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(tree, node, feature, threshold, value, gain, rows)``; tree -1 is the base value, leaves have no feature."""
        rows = [(-1, 0, None, None, float(self.base), 0.0, 0)]
        for i, t in enumerate(self.trees):
            for node in np.flatnonzero(t.rows).tolist():
                f = int(t.feature[node])
                split = (self.features[f], int(t.threshold[node]), None) if f >= 0 else (None, None, float(t.value[node]))
                rows.append((i, node, *split, float(t.gain[node]), int(t.rows[node])))
        schema = "tree int, node int, feature string, threshold int, value double, gain double, rows long"
        return spark.createDataFrame(rows, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """L9. The tables of nodes and features."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        names = spark.createDataFrame(list(enumerate(self.features)), "pos int, feature string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        features = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("pos").collect()]
        place = {name: i for i, name in enumerate(features)}
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        base = float(nodes.loc[nodes["tree"] == -1, "value"].iloc[0])
        trees = []
        for _, rows in nodes[nodes["tree"] >= 0].groupby("tree"):
            made = Tree.empty(max(int(rows["node"].max() + 1).bit_length() - 1, 0))
            at = rows["node"].to_numpy()
            made.feature[at] = [place.get(f, -1) for f in rows["feature"]]
            made.threshold[at] = rows["threshold"].fillna(0).astype(np.int8)
            made.value[at] = rows["value"].fillna(0.0)
            made.gain[at], made.rows[at] = rows["gain"], rows["rows"]
            trees.append(made)
        return TreeModel(tuple(features), base, tuple(trees))


@dataclass(frozen=True)
class HistogramTrees:
    """Estimator for squared loss: ``fit(df) -> TreeModel``.

    Each tree sees ``max(1, int(column_fraction * features))`` columns, those with the smallest md5 of
    ``seed:tree:position``. Of splits with the same gain the first feature with the smallest threshold wins. The base
    value is the mean of the target. A null or NaN target and a feature outside ``0 .. levels-1`` fail the job; no
    rows give no trees and a base of NaN.
    """

    features: tuple[str, ...]
    target: str = "target"
    rounds: int = 100
    rate: float = 0.1
    depth: int = 5
    column_fraction: float = 0.1
    seed: int = 42
    levels: int = S.FEATURE_LEVELS
    write_every: int = 50
    names: list[str] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "features", tuple(self.features))
        object.__setattr__(self, "names", [f"x{i}" for i in range(len(self.features))])

    def sampled(self, tree: int) -> list[int]:
        """Positions of the columns that a tree may split on."""
        order = sorted(range(len(self.features)), key=lambda f: hashlib.md5(f"{self.seed}:{tree}:{f}".encode()).hexdigest())
        return sorted(order[: max(1, int(self.column_fraction * len(order)))])

    def fit(self, df: DataFrame) -> TreeModel:
        spark = df.sparkSession
        y = nan_if_null(self.target)
        sound = F.when(~F.isnan(y), y).otherwise(F.raise_error(F.lit(f"{self.target}: missing value")).cast("double"))
        rows = df.select(*[checked(c, self.levels).alias(x) for c, x in zip(self.features, self.names, strict=True)], sound.alias("y"))
        if self.levels ** len(self.features) <= MAX_TUPLES:
            rows = rows.groupBy(*self.names).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
        else:
            rows = rows.select(*self.names, F.lit(1).cast("long").alias("n"), "y")
        path = scratch_path(spark, "tree-rows")
        rows.write.parquet(path)
        schema = rows.schema
        now = spark.read.schema(schema).parquet(path)
        n, total = now.agg(F.sum("n"), F.sum("y")).first()
        if not n:
            return TreeModel(self.features, float("nan"), ())
        base = total / n
        written = 0  # trees whose values are taken off the residuals already
        trees: list[Tree] = []
        sums = total - n * base
        offset = base
        while len(trees) < self.rounds:
            grown, sums = self._grow(now, len(trees), trees[written:], offset, sums, int(n))
            trees.append(grown)
            if len(trees) - written >= self.write_every and len(trees) < self.rounds:
                fresh = scratch_path(spark, "tree-rows")
                self._settled(now, trees[written:], offset).write.parquet(fresh)
                discard(spark, path)
                path, written, offset = fresh, len(trees), 0.0
                now = spark.read.schema(schema).parquet(path)
        discard(spark, path)
        return TreeModel(self.features, base, tuple(trees))

    def _settled(self, rows: DataFrame, pending: list[Tree], offset: float) -> DataFrame:
        """The rows with what the pending trees and the offset say taken off ``y``."""
        names, used = self.names, sorted(set().union(*[t.used() for t in pending]))

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, _ = residuals(batch, columns_of(batch, used), pending, offset)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], batch.column("n"), pa.array(y)], names=[*names, "n", "y"])

        return rows.mapInArrow(settle, rows.select(*names, "n", "y").schema)

    def _grow(self, rows: DataFrame, number: int, pending: list[Tree], offset: float, sums: float, n: int) -> tuple[Tree, float]:
        """A tree on the residuals, and the sum of residuals that it leaves."""
        tree = Tree.empty(self.depth)
        tree.rows[0] = n
        totals = {0: (sums, n)}
        for level in range(self.depth):
            first = 2**level - 1
            open_nodes = [k for k in totals if k >= first and tree.rows[k] > 1]
            if not open_nodes:
                break
            for s in self._best_splits(rows, self.sampled(number), pending, offset, tree, level).collect():
                k = s["node"]
                tree.feature[k], tree.threshold[k], tree.gain[k] = s["f"], s["x"], s["gain"]
                totals[2 * k + 1] = (s["left_g"], s["left_n"])
                totals[2 * k + 2] = (s["g"] - s["left_g"], s["n"] - s["left_n"])
                for child in (2 * k + 1, 2 * k + 2):
                    tree.rows[child] = totals[child][1]
        left = 0.0
        for k, (g, count) in totals.items():
            if tree.feature[k] < 0:
                tree.value[k] = self.rate * g / (count + SHRINKAGE)
                left += g - count * tree.value[k]
        return tree, left

    def _best_splits(self, rows: DataFrame, sampled: list[int], pending: list[Tree], offset: float, tree: Tree, level: int) -> DataFrame:
        """``node, f, x, gain, left_g, left_n, g, n`` of the best split of each node of a level that has one."""
        levels, width, first = self.levels, 2**level, 2**level - 1
        needed = sorted(set(sampled) | tree.used() | set().union(*[t.used() for t in pending]))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((len(sampled), width * levels))
            n = np.zeros((len(sampled), width * levels))
            for batch in batches:
                columns = columns_of(batch, needed)
                y, weight = residuals(batch, columns, pending, offset)
                node = tree.nodes(columns, len(y), level) - first
                here = node >= 0
                for i, f in enumerate(sampled):
                    cell = node[here] * levels + columns[f][here]
                    g[i] += np.bincount(cell, y[here], width * levels)
                    n[i] += np.bincount(cell, weight[here], width * levels)
            i, cell = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((cell // levels + first).astype(np.int32)), pa.array(np.array(sampled, np.int32)[i]), pa.array((cell % levels).astype(np.int8)),
                    pa.array(g[i, cell]), pa.array(n[i, cell].astype(np.int64)),
                ],
                names=["node", "f", "x", "g", "n"],
            )

        cells = rows.select(*[f"x{f}" for f in needed], "n", "y").mapInArrow(partial, "node int, f int, x tinyint, g double, n long")
        return best_splits(cells.groupBy("node", "f", "x").agg(F.sum("g").alias("g"), F.sum("n").alias("n")))


def best_splits(cells: DataFrame) -> DataFrame:
    """Best split per node from its sums ``(node, f, x, g, n)``: ``node, f, x, gain, left_g, left_n, g, n``."""
    pair = Window.partitionBy("node", "f")
    upto = pair.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cells.select(
        "node", "f", "x", F.sum("g").over(upto).alias("left_g"), F.sum("n").over(upto).alias("left_n"),
        F.sum("g").over(pair).alias("g"), F.sum("n").over(pair).alias("n"),
    ).where("left_n < n")

    def score(g, n):
        return g * g / (n + SHRINKAGE)

    g, n, left_g, left_n = (F.col(c) for c in ("g", "n", "left_g", "left_n"))
    gain = F.round(score(left_g, left_n) + score(g - left_g, n - left_n) - score(g, n), GAIN_DECIMALS)
    scored = sums.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    best = F.max_by(F.struct("f", "x", "gain", "left_g", "left_n", "g", "n"), F.struct("gain", -F.col("f"), -F.col("x")))
    return scored.groupBy("node").agg(best.alias("best")).select("node", "best.*")


def columns_of(batch: pa.RecordBatch, positions: Sequence[int]) -> dict[int, np.ndarray]:
    return {f: batch.column(f"x{f}").to_numpy(zero_copy_only=False) for f in positions}


def residuals(batch: pa.RecordBatch, columns: dict[int, np.ndarray], pending: Sequence[Tree], offset: float) -> tuple[np.ndarray, np.ndarray]:
    """What is left of ``y`` after the offset and the pending trees, and the number of rows that each entry stands for."""
    n = batch.column("n").to_numpy(zero_copy_only=False)
    predicted = np.full(len(n), offset)
    for tree in pending:
        predicted += tree.predict(columns, len(n))
    return batch.column("y").to_numpy(zero_copy_only=False) - n * predicted, n.astype(np.float64)
