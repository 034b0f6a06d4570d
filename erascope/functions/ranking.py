"""Average ranks inside groups, safe for groups of any size.

Two exact plans give the same numbers:

* ``window``: one shuffle by the group key, then rank windows. Best while the largest group fits one task.
* ``prefix``: rows are counted per distinct value, distinct values are put into bins by a monotone
  function of the float32 value, and ranks are prefix sums over bins plus prefix sums inside a bin.
  A group of any size is spread over the cluster: there are at most ``BINS_PER_GROUP`` bins per group
  and ``VALUES_PER_BIN`` distinct values per bin, because values are ranked as float32. Ties collapse
  in the map-side combine, and the join back to the rows is left to AQE's skew-join splitting.

``auto`` measures the group sizes first and sends only the groups above ``HOT_GROUP_ROWS`` through
``prefix``; hot groups are marked by a join with the table of sizes. A null key is a group of its own in
both plans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erascope.functions.numeric import with_norm_ppf
from erascope.session import scratch_path

HOT_GROUP_ROWS = 8_000_000
BROADCAST_GROUPS = 100_000

# A float32 has 24 significant bits: 128 steps per power of two leave at most 2**16 values per bin;
# there are 277 powers of two (subnormals included) on each side of zero.
STEPS_PER_OCTAVE = 128
VALUES_PER_BIN = 2**16
BINS_PER_GROUP = 2 * 277 * STEPS_PER_OCTAVE + 3

STRATEGIES = ("auto", "window", "prefix")


def as_rankable(c: Column | str) -> Column:
    """float32 value that ranks are taken on; null becomes NaN, and NaN ranks last and ties with NaN."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("float"), F.lit(float("nan")).cast("float"))


def float_bin(x: Column) -> Column:
    """Monotone bin of a float32: octave and 1/128 steps inside it; own bins for 0, infinities and NaN."""
    wide = x.cast("double")
    size = F.abs(wide)
    octave = F.floor(F.log2(size)).cast("double")
    position = octave + size / F.pow(F.lit(2.0), octave) - 1.0
    step = F.floor((position + 150.0) * STEPS_PER_OCTAVE).cast("int")
    top = F.lit(BINS_PER_GROUP)
    return (
        F.when(F.isnan(wide), top + 1)
        .when(wide == 0, F.lit(0))
        .when(size == float("inf"), F.signum(wide).cast("int") * top)
        .otherwise(F.signum(wide).cast("int") * (step + 1))
    )


@dataclass(frozen=True)
class GroupProfile:
    """Sizes that decide the plan: computed from the group column(s) alone."""

    groups: int
    largest: int
    hot: int  # groups above the limit


def profile_groups(df: DataFrame, by: Sequence[str], limit: int = HOT_GROUP_ROWS) -> GroupProfile:
    """One job over the group columns; three numbers reach the driver."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"), F.count_if(F.col("n") > limit).alias("hot")
    ).first()
    return GroupProfile(top["groups"], top["largest"] or 0, top["hot"])


def per_group(
    df: DataFrame,
    by: Sequence[str],
    strategy: str,
    build: Callable[[DataFrame, str, bool], DataFrame],
    limit: int = HOT_GROUP_ROWS,
    narrow: bool = False,
) -> DataFrame:
    """Apply ``build(part, "window" | "prefix", small_stats)`` to all groups.

    With ``auto`` small groups take the window plan and hot groups the prefix plan; the results are
    stacked. ``small_stats`` tells ``build`` that one row per group is known to fit a broadcast.

    The prefix plan reads its input several times, so what it works on is written down once before that. A ``narrow``
    input, one of few columns, is written whole, apart for hot and other groups, so that what lies above it (a scan of a
    wide panel, a model) runs once and each plan reads its own files; of a wide one only the hot groups are written.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    if not by:
        return build(df, "prefix", True)
    if strategy != "auto":
        return build(written(df) if strategy == "prefix" else df, strategy, False)
    profile = profile_groups(df, by, limit)
    small = profile.groups <= BROADCAST_GROUPS
    if profile.hot == 0:
        return build(df, "window", small)
    if profile.hot == profile.groups:
        return build(written(df), "prefix", small)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > limit).select(*by, F.lit(True).alias("_hot"))
    # there is one hot group per ``limit`` rows of the table at most; their number was measured
    marked = join_back(df, F.broadcast(hot) if profile.hot <= BROADCAST_GROUPS else hot, by, by)
    marked = marked.withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    if narrow:
        path = scratch_path(df.sparkSession, "rows")
        marked.write.partitionBy("_hot").parquet(path)
        cold_rows, hot_rows = (df.sparkSession.read.schema(df.schema).parquet(f"{path}/_hot={h}") for h in ("false", "true"))
    else:
        cold_rows, hot_rows = marked.where("NOT _hot").drop("_hot"), written(marked.where("_hot").drop("_hot"))
    return build(cold_rows, "window", small).unionByName(build(hot_rows, "prefix", small))


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def add_group_stats(
    df: DataFrame, stats: Mapping[str, Column], by: Sequence[str], how: str, small: bool = False
) -> DataFrame:
    """Add one aggregate value per group to every row.

    ``window`` reuses the group shuffle of the ranks. ``prefix`` aggregates map-side first and joins one
    row per group back: as a broadcast only when the number of groups was measured to be small.
    """
    if how == "window":
        over = Window.partitionBy(*by)
        return df.withColumns({name: agg.over(over) for name, agg in stats.items()})
    keys = list(by)
    if not keys:
        # one group: each value is a scalar subquery
        one = df.agg(*[agg.alias(name) for name, agg in stats.items()])
        return df.withColumns({name: one.select(name).scalar() for name in stats})
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return join_back(df, F.broadcast(table) if small else table, keys, keys)


def add_average_ranks(
    df: DataFrame, values: Mapping[str, str], by: Sequence[str], how: str, small: bool = False, size: str = "n"
) -> DataFrame:
    """Add the average rank of each column in ``values`` (output name -> float32 column) and the group size."""
    if how == "window":
        over = Window.partitionBy(*by)
        ranked = df if size in df.columns else df.withColumn(size, F.count(F.lit(1)).over(over))
        for name, value in values.items():
            ordered = over.orderBy(F.col(value))
            # peers share rank(); the default RANGE frame counts rows up to and including the peers
            below = F.rank().over(ordered)
            up_to = F.count(F.lit(1)).over(ordered)
            ranked = ranked.withColumn(name, (below + up_to) / 2.0)
        return ranked
    ranked = df
    for i, (name, value) in enumerate(values.items()):
        table = value_ranks(df, value, by, name, size)
        ranked = join_back(ranked, table if i == 0 else table.drop(size), [*by, value], by)
    return ranked


def value_ranks(df: DataFrame, value: str, by: Sequence[str], rank: str = "rank", size: str = "n") -> DataFrame:
    """One row per distinct (group, value): its average rank in the group and the group size."""
    keys = list(by)
    group = [F.col(k) for k in keys] or [F.lit(0)]
    counts = (
        df.groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_bin", float_bin(F.col(value)))
    )
    # at most BINS_PER_GROUP rows per group from here on
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_count").alias("_bin_count"))
    everything = Window.partitionBy(*group)
    before_bin = everything.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_bin_count").over(before_bin), F.lit(0)).alias("_before_bin"),
        F.sum("_bin_count").over(everything).alias(size),
    )
    # at most VALUES_PER_BIN rows per partition
    before_value = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_before", F.coalesce(F.sum("_count").over(before_value), F.lit(0)))
    joined = join_back(inside, bins, [*keys, "_bin"], keys)
    return joined.select(
        *keys,
        value,
        (F.col("_before_bin") + F.col("_before") + (F.col("_count") + 1) / 2.0).alias(rank),
        size,
    )


def add_normal_scores(
    df: DataFrame, values: Mapping[str, str], by: Sequence[str], how: str, small: bool = False
) -> DataFrame:
    """Add the normal score of the average rank of each float32 column in ``values`` (output name -> column).

    Under ``prefix`` the scores are computed once per distinct value and joined to the rows. Columns are
    handled one after the other: the polynomials of two columns in one projection would make a method
    that the JVM does not compile.
    """
    for out, value in values.items():
        if how == "window":
            ranked = add_average_ranks(df, {"_rank": value}, by, how, small, size="_n")
            df = _scored(ranked, out).drop("_rank")
        else:
            table = _scored(value_ranks(df, value, by, "_rank", "_n"), out)
            df = join_back(df, table.drop("_n", "_rank"), [*by, value], by)
    return df.drop("_n")


def _scored(ranked: DataFrame, out: str) -> DataFrame:
    return with_norm_ppf(ranked, {out: (F.col("_rank") - 0.5) / F.col("_n")})


def join_back(rows: DataFrame, table: DataFrame, keys: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Add the non-key columns of ``table`` (unique on ``keys``) to every row; nulls meet in ``nullable`` keys."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = table.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in table.columns if c not in names])
    equal = [F.col(k).eqNullSafe(F.col(n)) if k in nullable else F.col(k) == F.col(n) for k, n in names.items()]
    return rows.join(other, reduce(lambda a, b: a & b, equal), "left").drop(*names.values())

