"""Ordinary least squares by normal equations (L1-L3)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope.errors import NotTrained, SingularSystem
from erascope.operators.gram import ONE, gram_matrix

INTERCEPT = "(intercept)"
# Terms up to which a prediction is a plain sum; the code of longer ones is more than the JVM compiles.
PLAIN_TERMS = 32


@dataclass(frozen=True)
class LinearModel:
    """Coefficients per target; the intercept is 0 when none was fitted."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def expression(self, target: int = 0, features: Sequence[str] | None = None) -> Column:
        """Prediction as a Column: products added up in the order of the features, column by column in Arrow if they are many.

        A null feature makes it null.
        """
        names = self.check(features)
        values = [F.col(name).cast("double") for name in names]
        start, weights = float(self.intercepts[target]), [float(b) for b in self.coefficients[target]]
        if len(names) <= PLAIN_TERMS:
            return reduce(lambda total, term: total + term[0] * F.lit(term[1]), zip(values, weights, strict=True), F.lit(start))

        @F.arrow_udf("double")
        def predict(*columns: pa.Array) -> pa.Array:
            total = pa.scalar(start)
            for x, b in zip(columns, weights, strict=True):
                total = pc.add(total, pc.multiply(x, b))
            return total

        return predict(*values)

    def check(self, features: Sequence[str] | None) -> Sequence[str]:
        names = self.features if features is None else list(features)
        if len(names) != len(self.features):
            raise ValueError(f"got {len(names)} features, the model was fitted on {len(self.features)}")
        return names

    def transform(self, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        """L2. Add ``prediction``, or ``prediction_<target>`` for several targets."""
        single = len(self.targets) == 1
        return df.withColumns(
            {
                "prediction" if single else f"prediction_{t}": self.expression(i, features)
                for i, t in enumerate(self.targets)
            }
        )

    def table(self, spark: SparkSession) -> DataFrame:
        """``(target, pos, term, value)``; position 0 is the intercept."""
        rows = []
        for t, betas, b0 in zip(self.targets, self.coefficients, self.intercepts):
            rows.append((t, 0, INTERCEPT, float(b0)))
            rows += [(t, k + 1, name, float(b)) for k, (name, b) in enumerate(zip(self.features, betas))]
        return spark.createDataFrame(rows, "target string, pos int, term string, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        """L9. Coefficients as a Parquet table."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        rows = spark.read.parquet(path).orderBy("target", "pos").collect()
        targets = tuple(dict.fromkeys(r["target"] for r in rows))
        features = tuple(r["term"] for r in rows if r["target"] == targets[0] and r["pos"] > 0)
        values = {(r["target"], r["pos"]): r["value"] for r in rows}
        return LinearModel(
            features,
            targets,
            tuple(tuple(values[t, k + 1] for k in range(len(features))) for t in targets),
            tuple(values[t, 0] for t in targets),
        )


@dataclass(frozen=True)
class LeastSquares:
    """Estimator with the shape of an MLlib one: ``fit(df) -> model``, ``model.transform(df)``."""

    features: tuple[str, ...]
    targets: tuple[str, ...] = ("target",)
    intercept: bool = True
    method: str = "auto"

    def fit(self, df: DataFrame) -> LinearModel:
        return fit_ols(df, self.features, self.targets, self.intercept, self.method)


def fit_ols(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str] = ("target",),
    intercept: bool = True,
    method: str = "auto",
) -> LinearModel:
    """L1. Exact least squares for any number of targets; only the cross products reach the driver."""
    terms = ([ONE] if intercept else []) + list(features)
    columns = terms + list(targets)
    matrix = gram_matrix(df, columns, method)
    k = len(terms)
    solution = solve(matrix[:k, :k], matrix[:k, k:])
    start = 1 if intercept else 0
    return LinearModel(
        tuple(features),
        tuple(targets),
        tuple(tuple(float(b) for b in solution[start:, t]) for t in range(len(targets))),
        tuple(float(solution[0, t]) if intercept else 0.0 for t in range(len(targets))),
    )


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve the normal equations; a singular system is an error."""
    scale = np.sqrt(np.diag(a))
    if not np.all(scale > 0):
        raise SingularSystem("a column is zero in every row")
    scaled = a / np.outer(scale, scale)
    if np.linalg.cond(scaled) > 1 / np.finfo(float).eps:
        raise SingularSystem("the columns are linearly dependent")
    return np.linalg.solve(scaled, b / scale[:, None]) / scale[:, None]


def require_trained(model):
    """L6. A model must have been fitted."""
    if model is None:
        raise NotTrained("fit the model before using it")
    return model
