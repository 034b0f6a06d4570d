"""Feature selection."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.operators.gram import ONE, gram_matrix
from erascope.operators.linear import LinearModel, fit_ols, solve
from erascope.operators.ordering import DEFAULT_CRITERION
from erascope.splits import EMBARGO, EraRange, walk_forward

ATTRIBUTION_PREFIX = "attr_"
P_THRESHOLD = 0.05
REFRESH = 64  # drops after which the inverse is computed anew, against rounding


class SelectionStrategy(ABC):
    """F11 / U3. A strategy returns the chosen features as ``(pos, feature)``."""

    @abstractmethod
    def select(self, panel: DataFrame, features: Sequence[str]) -> DataFrame: ...


class FunctionStrategy(SelectionStrategy):
    """A plain function ``(panel, features) -> list of names`` as a strategy."""

    def __init__(self, choose: Callable[[DataFrame, Sequence[str]], Sequence[str]]):
        self.choose = choose

    def select(self, panel: DataFrame, features: Sequence[str]) -> DataFrame:
        return ordered_names(panel, list(self.choose(panel, features)))


class InformationStrategy(SelectionStrategy):
    """The first features of a greedy information order."""

    def __init__(self, criterion: str = DEFAULT_CRITERION, first_n: int | None = None, **options):
        self.criterion, self.first_n, self.options = criterion, first_n, options

    def select(self, panel: DataFrame, features: Sequence[str]) -> DataFrame:
        from erascope.plans.feature_ranking import rank_features

        order = rank_features(panel, features, criteria=[self.criterion], top_k=self.first_n, **self.options)
        return order.select("pos", "feature")


class AttributionStrategy(SelectionStrategy):
    """F12 + F13. Fit on the early part of the range, attribute on its last eras, eliminate by t-values.

    ``attribute(train, validation, features)`` may give other attributions than those of least squares: a frame
    with the target and one ``attr_<feature>`` column per feature, e.g. from a tree model or columns that the
    validation rows already have. ``starting_features`` narrows the list before anything is fitted.
    """

    def __init__(
        self,
        outer: EraRange,
        n_validation: int,
        embargo: int = EMBARGO,
        target: str = "target",
        threshold: float = P_THRESHOLD,
        attribute: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] | None = None,
        starting_features: Sequence[str] | None = None,
    ):
        self.train, self.validation = walk_forward(outer, n_validation, embargo)
        self.target, self.threshold = target, threshold
        self.attribute = attribute or self.linear
        self.starting = None if starting_features is None else set(starting_features)

    def linear(self, train: DataFrame, validation: DataFrame, features: Sequence[str]) -> DataFrame:
        """Attributions of a least-squares model of the training rows."""
        return linear_attributions(validation, fit_ols(train, features, [self.target]), [self.target])

    def report(self, panel: DataFrame, features: Sequence[str]) -> DataFrame:
        names = [c for c in features if self.starting is None or c in self.starting]
        train, validation = (panel.where(r.contains(S.ERA)) for r in (self.train, self.validation))
        return eliminate(self.attribute(train, validation, names), names, self.target, self.threshold)

    def select(self, panel: DataFrame, features: Sequence[str]) -> DataFrame:
        return selected_only(self.report(panel, features))


def select_features(
    panel: DataFrame, features: Sequence[str], strategy: SelectionStrategy | None = None
) -> DataFrame:
    """F11. Apply the configured strategy, or pass the list through unchanged."""
    if strategy is None:
        return ordered_names(panel, list(features))
    return strategy.select(panel, features)


def ordered_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [(i, n) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "pos int, feature string")


def linear_attributions(df: DataFrame, model: LinearModel, keep: Sequence[str] = ()) -> DataFrame:
    """F12. ``beta * (x - mean of x)`` per feature as ``attr_<feature>``: exact for a linear model."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in model.features]).first()
    columns = [
        ((F.col(c).cast("double") - F.lit(float(means[c]))) * F.lit(beta)).alias(ATTRIBUTION_PREFIX + c)
        for c, beta in zip(model.features, model.coefficients[0])
    ]
    return df.select(*keep, *columns)


def eliminate(
    attributed: DataFrame,
    features: Sequence[str],
    target: str = "target",
    threshold: float = P_THRESHOLD,
    prefix: str = ATTRIBUTION_PREFIX,
) -> DataFrame:
    """F13. Regress the target on attribution columns and drop the most negative t-value until none is left.

    Decisions: no intercept, two-sided p-values; a feature is selected when its coefficient is positive
    and p is below the threshold in the last fit. Any attribution columns will do, e.g. tree attributions
    computed elsewhere. One pass over the data builds the cross products; the elimination works on them.
    Returns ``(pos, feature, coefficient, t_value, p_value, selected, dropped_at)``.
    """
    columns = [ONE] + [prefix + c for c in features] + [target]
    matrix = gram_matrix(attributed, columns)
    rows = eliminate_on_products(matrix, features, threshold)
    return attributed.sparkSession.createDataFrame(
        rows,
        "pos int, feature string, coefficient double, t_value double, p_value double, selected boolean, "
        "dropped_at int",
    )


def eliminate_on_products(matrix: np.ndarray, features: Sequence[str], threshold: float) -> list[tuple]:
    """Backward elimination on a matrix over (1, attributions.., target); features with no spread go first."""
    n = matrix[0, 0]
    last = matrix.shape[0] - 1
    alive = [k for k in range(1, last) if matrix[k, k] > 0]
    results: dict[int, tuple] = {
        k: (0.0, math.nan, math.nan, False, 0) for k in range(1, last) if matrix[k, k] <= 0
    }
    step, inverse = 0, None
    scale = np.sqrt(np.maximum(np.diag(matrix), 0.0))
    while alive:
        if step % REFRESH == 0:
            inverse = _scaled_inverse(matrix, alive, scale)
        size = scale[alive]
        beta = inverse @ (matrix[alive, last] / size) / size
        freedom = n - len(alive)
        residual = max(matrix[last, last] - float(beta @ matrix[alive, last]), 0.0)
        t = beta * size / np.sqrt(residual / freedom * np.diag(inverse))
        worst = int(np.argmin(t))
        if t[worst] >= 0:
            for k, b, tv in zip(alive, beta, t, strict=True):
                pv = student_two_sided(float(tv), freedom)
                results[k] = (float(b), float(tv), pv, bool(b > 0 and pv < threshold), None)
            break
        step += 1
        results[alive[worst]] = (float(beta[worst]), float(t[worst]), student_two_sided(float(t[worst]), freedom), False, step)
        # the inverse without a row and column, by one outer product
        column = np.delete(inverse[:, worst], worst)
        inverse = np.delete(np.delete(inverse, worst, 0), worst, 1) - np.outer(column, column) / inverse[worst, worst]
        alive.pop(worst)
    return [(k - 1, features[k - 1], *results[k]) for k in range(1, last)]


def selected_only(report: DataFrame) -> DataFrame:
    """T4. Selected features in their original order, as ``(pos, feature)``."""
    return report.where("selected").select("pos", "feature")


def _scaled_inverse(matrix: np.ndarray, alive: list[int], scale: np.ndarray) -> np.ndarray:
    """Inverse of the products of the columns left, each scaled to length one; a singular system is an error."""
    scaled = matrix[np.ix_(alive, alive)] / np.outer(scale[alive], scale[alive])
    return solve(scaled, np.eye(len(alive)))


def student_two_sided(t: float, freedom: float) -> float:
    """Two-sided p-value of Student's t, by the regularized incomplete beta function of ``freedom / (freedom + t * t)``."""
    t, freedom = float(t), float(freedom)
    if math.isnan(t) or freedom <= 0:
        return math.nan
    square = t * t
    if square == 0.0:
        return 1.0
    if math.isinf(square):
        return 0.0
    a, b = freedom / 2.0, 0.5
    x, rest = freedom / (freedom + square), square / (freedom + square)
    front = math.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) - a * math.log1p(square / freedom) + b * math.log(rest))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - front * _beta_fraction(b, a, rest) / b
    return front * _beta_fraction(a, b, x) / a


def _log_gamma_step(a: float) -> float:
    """``lgamma(a + 1/2) - lgamma(a)``; for large ``a`` by its series, as the difference would cancel."""
    if a < 50.0:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    series = -1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)
    return 0.5 * math.log(a) + series


def _beta_fraction(a: float, b: float, x: float, tolerance: float = 1e-15, steps: int = 10_000) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    value = d
    for m in range(1, steps):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            change = c * d
            value *= change
        if abs(change - 1.0) < tolerance:
            return value
    return value
