"""Era catalogue and data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erascope import schema as S
from erascope.errors import PanelCheckFailed


def special_eras(panel: DataFrame, benchmark_column: str | None = None) -> DataFrame:
    """A1. One row with the first era of each kind of data, in one aggregate over a few columns."""
    return panel.agg(F.lit(S.FIRST_ERA).alias("train"), *special_era_columns(panel, benchmark_column))


def special_era_columns(panel: DataFrame, benchmark_column: str | None = None) -> list[Column]:
    """A1. The aggregates of ``special_eras`` that look at the rows; also fit to be observed while the panel is written."""
    columns = S.PanelColumns.of(panel)
    marker = benchmark_column or (
        S.BENCHMARK_START_COLUMN if S.BENCHMARK_START_COLUMN in columns.benchmarks else columns.benchmarks[0]
    )
    era = F.col(S.ERA)

    def first_era(condition: Column) -> Column:
        return F.min(F.when(condition, era))

    return [
        first_era(F.col(marker).isNotNull()).alias("benchmark"),
        first_era(F.col(S.DATA_TYPE) == "validation").alias("validation"),
        first_era(F.col(columns.meta).isNotNull()).alias("metamodel"),
        first_era(F.col(S.DATA_TYPE) == "test").alias("test"),
        F.max(era).alias("live"),
    ]


def eras_as_dict(eras: DataFrame) -> dict[str, int]:
    """The one catalogue row as a mapping."""
    return eras.first().asDict()


@dataclass(frozen=True)
class Rule:
    """``violations`` is true for a row that breaks the rule on ``column``."""

    name: str
    column: str
    violation: Column


def nan_rules(panel: DataFrame) -> list[Rule]:
    """A2. No NaN in float columns; nulls pass."""
    names = S.select_names(panel, types=[T.FloatType, T.DoubleType])
    return [Rule("not_nan", c, F.isnan(F.col(c))) for c in names]


def null_rules(panel: DataFrame) -> list[Rule]:
    """A3. Keys, split label and features are never null."""
    names = [S.ERA, S.DATA_TYPE, S.ID, *S.PanelColumns.of(panel).features]
    return [Rule("not_null", c, F.col(c).isNull()) for c in names if c in panel.columns]


def window_rules(panel: DataFrame, eras: Mapping[str, int]) -> list[Rule]:
    """A4. Columns that must be present inside a range of eras and absent outside it."""
    columns = S.PanelColumns.of(panel)
    era = F.col(S.ERA)
    test = eras["test"]
    benchmark = (era >= eras["benchmark"]) & (era < test + S.BENCHMARK_TAIL) | (F.col(S.DATA_TYPE) == "live")
    windows: list[tuple[str, Column]] = [(c, benchmark) for c in columns.benchmarks]
    if columns.meta:
        windows.append((columns.meta, (era >= eras["metamodel"]) & (era < test)))
    windows += [(c, era < test) for c in S.select_names(panel, S.TARGET_PREFIX, "20")]
    windows += [(c, era < test - S.LONG_TARGET_LAG) for c in S.select_names(panel, S.TARGET_PREFIX, "60")]
    rules = []
    for column, inside in windows:
        rules.append(Rule("present_inside", column, inside & F.col(column).isNull()))
        rules.append(Rule("absent_outside", column, ~inside & F.col(column).isNotNull()))
    return rules


def count_violations(panel: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules in one pass: ``(rule, column, violations)``.

    Every rule is one conditional count in a single map-side aggregate; the one result row is then
    turned into one row per rule.
    """
    counts = panel.agg(*[F.count_if(r.violation).alias(f"r{i}") for i, r in enumerate(rules)])
    entries = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(f"r{i}").alias("violations")
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*entries)))


def check_report(panel: DataFrame, eras: Mapping[str, int]) -> DataFrame:
    """A5. Report of A2-A4 for a panel and its era catalogue."""
    return count_violations(panel, nan_rules(panel) + null_rules(panel) + window_rules(panel, eras))


def require_clean(report: DataFrame) -> None:
    """Raise when a rule was broken; the report has one row per rule and column."""
    broken = report.where(F.col("violations") > 0).orderBy("rule", "column").collect()
    if broken:
        detail = ", ".join(f"{r['rule']}({r['column']}): {r['violations']}" for r in broken)
        raise PanelCheckFailed(detail)


def row_count(df: DataFrame) -> DataFrame:
    """A6."""
    return df.agg(F.count(F.lit(1)).alias("rows"))
