"""Mutual information from contingency counts (F1-F3). Natural logarithm; zero cells contribute nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _total(*keys: str) -> Column:
    """Sum of the counts over the rows that share ``keys``."""
    return F.sum("n").over(Window.partitionBy(*keys)).cast("double")


def _weighted_log(ratio: Column) -> Column:
    return F.sum(F.col("n") / F.col("_n") * F.log(ratio))


def mi_with_target(counts: DataFrame) -> DataFrame:
    """F1. ``(f, mi)`` from ``(f, x, y, n)``."""
    rows = (
        counts.withColumn("_n", _total("f")).withColumn("_x", _total("f", "x")).withColumn("_y", _total("f", "y"))
    )
    ratio = F.col("n") * F.col("_n") / (F.col("_x") * F.col("_y"))
    return rows.groupBy("f").agg(_weighted_log(ratio).alias("mi"))


def mi_of_pairs(counts: DataFrame) -> DataFrame:
    """F2. ``(f1, f2, mi)`` from ``(f1, f2, u, v, n)``; on the diagonal it is the entropy."""
    pair = ("f1", "f2")
    rows = (
        counts.withColumn("_n", _total(*pair))
        .withColumn("_u", _total(*pair, "u"))
        .withColumn("_v", _total(*pair, "v"))
    )
    ratio = F.col("n") * F.col("_n") / (F.col("_u") * F.col("_v"))
    return rows.groupBy(*pair).agg(_weighted_log(ratio).alias("mi"))


def cmi_of_pairs(counts: DataFrame) -> DataFrame:
    """F3. ``(f1, f2, cmi)`` from ``(f1, f2, u, v, y, n)``: information of the pair given the target."""
    return pair_information(counts).select("f1", "f2", "cmi")


def information_between(counts: DataFrame) -> DataFrame:
    """``(f1, f2, mi, cmi)`` from ``(f1, f2, y, cells)``, whose ``cells`` count the values ``(u, v)`` of a pair in order.

    A pair is one row of nested arrays, at most ``levels ** 3`` numbers; its sums are taken inside the row.
    """
    cells = F.transform("classes", lambda c: c.cast("array<double>"))
    width = F.sqrt(F.size(F.col("classes")[0])).cast("int")
    rows = counts.groupBy("f1", "f2").agg(F.collect_list("cells").alias("classes")).select("f1", "f2", cells.alias("classes"), width.alias("w"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def added(tables: Column) -> Column:
        return F.aggregate(tables, F.array_repeat(F.lit(0.0), F.size(F.col("classes")[0])), lambda a, t: F.zip_with(a, t, lambda x, y: x + y))

    def information(table: Column, w: Column) -> Column:
        """Sum of n log(n * all / (n of u * n of v)) over a table of counts."""
        places = F.sequence(F.lit(0), w - 1)
        of_u = F.transform(places, lambda u: total(F.slice(table, u * w + 1, w)))
        of_v = F.transform(places, lambda v: total(F.filter(table, lambda _, i: i % w == v)))
        every = total(table)
        terms = F.transform(
            table, lambda n, i: F.when(n > 0, n * F.log(n * every / (F.get(of_u, F.floor(i / w).cast("int")) * F.get(of_v, i % w)))).otherwise(0.0)
        )
        return total(terms)

    n = total(F.col("all"))
    summed = rows.withColumn("all", added(F.col("classes")))
    given = F.aggregate("classes", F.lit(0.0), lambda a, t: a + information(t, F.col("w")))
    return summed.select("f1", "f2", (information(F.col("all"), F.col("w")) / n).alias("mi"), (given / n).alias("cmi"))


def pair_information(counts: DataFrame) -> DataFrame:
    """F1-F3 in one pass over pair counts: ``(f1, f2, mi, cmi, relevance)``.

    ``relevance`` is the information of ``f1`` about the target. All marginals of a pair lie inside its
    own at most ``levels ** 3`` rows, so one shuffle by pair serves every sum.
    """
    pair = ("f1", "f2")
    rows = (
        counts.withColumn("_n", _total(*pair))
        .withColumn("_y", _total(*pair, "y"))
        .withColumn("_u", _total(*pair, "u"))
        .withColumn("_uy", _total(*pair, "u", "y"))
        .withColumn("_v", _total(*pair, "v"))
        .withColumn("_vy", _total(*pair, "v", "y"))
        .withColumn("_uv", _total(*pair, "u", "v"))
    )
    n = F.col("_n")
    return rows.groupBy(*pair).agg(
        _weighted_log(F.col("_uv") * n / (F.col("_u") * F.col("_v"))).alias("mi"),
        _weighted_log(F.col("_y") * F.col("n") / (F.col("_uy") * F.col("_vy"))).alias("cmi"),
        _weighted_log(F.col("_uy") * n / (F.col("_u") * F.col("_y"))).alias("relevance"),
    )
