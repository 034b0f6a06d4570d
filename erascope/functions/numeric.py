"""Scalar Column expressions; all stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the percentage points of the normal distribution, algorithm AS 241
# (Wichura 1988), highest power first. Each pair is (numerator, denominator).
PPF_CENTRE = (
    (
        2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
        1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
    ),
    (
        5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
        5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
    ),
)
PPF_MIDDLE = (
    (
        7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
        3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
    ),
    (
        1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
        6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
    ),
)
PPF_TAIL = (
    (
        2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
        2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
    ),
    (
        2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
        1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
    ),
)
PPF_CENTRE_HALF_WIDTH = 0.425
PPF_CENTRE_OFFSET = 0.180625
PPF_MIDDLE_LIMIT = 5.0
PPF_MIDDLE_OFFSET = 1.6

NAN = float("nan")


def nan_if_null(c: Column | str) -> Column:
    """Null becomes NaN; the result is double."""
    return F.coalesce(_col(c).cast("double"), F.lit(NAN))


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` with NaN for a zero or missing divisor (ANSI division would raise)."""
    return F.coalesce(F.try_divide(a, b), F.lit(NAN))


def signed_power(x: Column, exponent: float = 1.5) -> Column:
    """``sign(x) * |x| ** exponent``."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(exponent))


def with_norm_ppf(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add the inverse of the standard normal distribution function of each value in ``(0, 1)``.

    Done in two projections, so that the argument of the polynomials is computed once per row and the
    generated code stays small.
    """
    step = df
    for out, p in columns.items():
        step = step.withColumn(f"_p_{out}", F.coalesce(p, F.lit(NAN)))
    step = step.withColumns({f"_r_{out}": _argument(F.col(f"_p_{out}")) for out in columns})
    step = step.withColumns({out: _quantile(F.col(f"_p_{out}"), F.col(f"_r_{out}")) for out in columns})
    return step.drop(*[f"_{k}_{out}" for out in columns for k in "pr"])


def norm_ppf(p: Column) -> Column:
    """The same as one Column; for large tables use ``with_norm_ppf``."""
    return _quantile(p, _argument(p))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and clear the sign of zero."""
    return F.round(_col(c), digits) + F.lit(0.0)


def _argument(p: Column) -> Column:
    """Centre: offset minus the squared distance from 0.5 (never negative); tails: a negated root.

    The sign tells the two apart: in the tails the value is below -1.6.
    """
    q = p - 0.5
    argument = F.when(F.abs(q) <= PPF_CENTRE_HALF_WIDTH, PPF_CENTRE_OFFSET - q * q).otherwise(
        -F.sqrt(-F.log(F.least(p, 1.0 - p)))
    )
    # never null in fact; saying so keeps null checks out of the generated polynomials
    return F.coalesce(argument, F.lit(NAN))


def _quantile(p: Column, r: Column) -> Column:
    q = p - 0.5
    return (
        F.when(r >= 0, q * _rational(PPF_CENTRE, r))
        .when(r >= -PPF_MIDDLE_LIMIT, F.signum(q) * _rational(PPF_MIDDLE, -r - PPF_MIDDLE_OFFSET))
        .otherwise(F.signum(q) * _rational(PPF_TAIL, -r - PPF_MIDDLE_LIMIT))
    )


def _rational(pair: tuple[tuple[float, ...], tuple[float, ...]], r: Column) -> Column:
    return _horner(pair[0], r) / _horner(pair[1], r)


def _horner(coefficients: tuple[float, ...], r: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * r + c
    return value


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
