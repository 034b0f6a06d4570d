"""Naming rules of the panel and the casts that follow from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names, labels, prefixes and defaults that the input files and their users rely on.
ID = "id"
ERA = "era"
DATA_TYPE = "data_type"
DATA_TYPES = ("train", "validation", "test", "live")
FEATURE_PREFIX = "feature"
TARGET_PREFIX = "target"
BENCHMARK_PREFIX = "v5_lgbm_"
BENCHMARK_START_COLUMN = "v5_lgbm_cyrusd20"
META_SUFFIX = "meta_model"
LIVE_LABEL = "X"
DEFAULT_FEATURE_SET = "small"
DEFAULT_TARGETS = ("target",)
FEATURE_LEVELS = 5
FIRST_ERA = 1
LONG_TARGET_LAG = 8
BENCHMARK_TAIL = 5
FILL_VALUE = 0.5

# Feature types a caller may ask for by name.
FEATURE_TYPES = {"Int8": T.ByteType(), "Float32": T.FloatType()}


@dataclass(frozen=True)
class PanelColumns:
    """Column names of a panel, found by prefix and suffix."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    benchmarks: tuple[str, ...]
    meta: str | None

    @classmethod
    def of(cls, df: DataFrame) -> PanelColumns:
        metas = select_names(df, suffix=META_SUFFIX)
        return cls(
            features=tuple(select_names(df, prefix=FEATURE_PREFIX)),
            targets=tuple(select_names(df, prefix=TARGET_PREFIX)),
            benchmarks=tuple(select_names(df, prefix=BENCHMARK_PREFIX)),
            meta=metas[0] if metas else None,
        )


def select_names(
    df: DataFrame,
    prefix: str = "",
    suffix: str = "",
    types: Iterable[type[T.DataType]] | None = None,
) -> list[str]:
    """Columns whose name has the prefix AND the suffix and whose type is one of ``types``."""
    allowed = tuple(types) if types is not None else None
    return [
        f.name
        for f in df.schema.fields
        if f.name.startswith(prefix)
        and f.name.endswith(suffix)
        and (allowed is None or isinstance(f.dataType, allowed))
    ]


def target_type_of(name: str) -> T.DataType | None:
    """Type a panel column must have, or None when the naming rules say nothing about it."""
    if name == ID or name == DATA_TYPE:
        return T.StringType()
    if name == ERA:
        return T.IntegerType()
    if name.startswith(FEATURE_PREFIX):
        return T.ByteType()
    if name.startswith((TARGET_PREFIX, BENCHMARK_PREFIX)) or name.endswith(META_SUFFIX):
        return T.FloatType()
    return None
