"""Stacking and left joins of panel parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.errors import SchemaMismatch


def stack_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """J1. UNION ALL of parts with exactly the same columns and types (no silent widening)."""
    first = {f.name: f.dataType for f in parts[0].schema.fields}
    for i, part in enumerate(parts[1:], start=1):
        other = {f.name: f.dataType for f in part.schema.fields}
        if other != first:
            differing = sorted(n for n in first.keys() | other.keys() if first.get(n) != other.get(n))
            raise SchemaMismatch(f"part {i} differs from part 0 in {differing}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def attach_left(panel: DataFrame, right: DataFrame, drop: Sequence[str], key: str = S.ID) -> DataFrame:
    """J2 / J3. Left equi-join by id without the right side's bookkeeping columns.

    Rows of the right side without an id can never match and are dropped before the shuffle. Left rows
    without an id stay, unmatched. Catalyst broadcasts the right side only when its size allows it.
    """
    kept = right.drop(*drop).where(F.col(key).isNotNull())
    return panel.join(kept, key, "left")


def join_parts(panel: Sequence[DataFrame], benchmark: Sequence[DataFrame], meta: DataFrame) -> DataFrame:
    """J1 -> J2 -> J3 over the seven raw parts."""
    joined = attach_left(stack_parts(panel), stack_parts(benchmark), [S.ERA])
    return attach_left(joined, meta, [S.ERA, S.DATA_TYPE])
