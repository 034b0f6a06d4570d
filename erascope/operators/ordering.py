"""Greedy feature orders from information tables.

The input is the pair table of ``information.pair_information`` (``f1 <= f2``). Its size is that of the
feature list squared, not of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erascope.session import shared_dir

# Names of the criteria; the last one is the default.
CRITERIA = ("CIFE", "JMI", "CMIM", "JMIM", "DMIM")
DEFAULT_CRITERION = "DMIM"

# Longest feature list whose pair table (125,000 rows) is ordered in one task per criterion.
DENSE = 500


def greedy_order(
    pairs: DataFrame, criteria: Sequence[str] = CRITERIA, top_k: int | None = None
) -> DataFrame:
    """F9. ``(method, pos, f, objective)``; ties go to the lowest position.

    Up to ``DENSE`` features a task per criterion holds the pair table; longer lists take one small job per pick, and no
    task holds more than a part of it. ``lazy_ordering`` needs no pair table at all. All give the same order.
    """
    check_criteria(criteria)
    last = pairs.agg(F.max("f2")).first()[0]
    if last is not None and last >= DENSE:
        orders = [greedy_order_steps(pairs, c, top_k or last + 1) for c in criteria]
        return reduce(lambda a, b: a.unionByName(b), orders)
    per_method = pairs.select(
        F.explode(F.array(*[F.lit(c) for c in criteria])).alias("method"), "f1", "f2", "mi", "cmi", "relevance"
    )
    return per_method.groupBy("method").applyInPandas(
        _dense_greedy(top_k), "method string, pos int, f int, objective double"
    )


def greedy_order_steps(pairs: DataFrame, criterion: str = DEFAULT_CRITERION, top_k: int = 100) -> DataFrame:
    """F9 for long feature lists: one small job per pick, no task ever holds the pair table.

    Each step reads the pair rows of the feature picked last and updates one row per candidate.
    """
    check_criteria([criterion])
    spark = pairs.sparkSession
    shared_dir(spark)  # where the state of every step is kept
    state = pairs.where(F.col("f1") == F.col("f2")).select(
        F.col("f1").alias("f"), "relevance", F.col("relevance").alias("objective"),
        F.lit(0.0).alias("a"), F.lit(0.0).alias("b"),
    ).checkpoint()
    picks: list[tuple[str, int, int, float]] = []
    while len(picks) < top_k:
        best = state.agg(
            F.max_by(F.struct("f", "relevance", "objective"), F.struct("objective", -F.col("f"))).alias("best")
        ).first()["best"]
        if best is None:
            break
        picks.append((criterion, len(picks), best["f"], best["objective"]))
        chosen = F.lit(best["f"])
        row = pairs.where((F.col("f1") == chosen) | (F.col("f2") == chosen)).select(
            F.when(F.col("f1") == chosen, F.col("f2")).otherwise(F.col("f1")).alias("f"), "mi", "cmi"
        )
        state = _advance(
            state.where(F.col("f") != chosen).join(row, "f"), criterion, len(picks), best["relevance"]
        ).checkpoint()
    return spark.createDataFrame(picks, "method string, pos int, f int, objective double")


def named_order(order: DataFrame, features: Sequence[str]) -> DataFrame:
    """T3. Positions replaced by names: ``(method, pos, feature)``."""
    names = F.array(*[F.lit(c) for c in features])
    return order.select("method", "pos", F.element_at(names, F.col("f") + 1).alias("feature"))


def check_criteria(criteria: Sequence[str]) -> None:
    unknown = [c for c in criteria if c not in CRITERIA]
    if unknown:
        raise ValueError(f"unknown criteria {unknown}; known are {CRITERIA}")


def _advance(state: DataFrame, criterion: str, picked: int, relevance: float) -> DataFrame:
    """Update the running sums or maxima (a, b) of every candidate and its objective."""
    gain = F.col("mi") - F.col("cmi")
    first = picked == 1

    def running_max(name: str, value):
        return value if first else F.greatest(F.col(name), value)

    b = F.col("b")
    if criterion in ("CIFE", "JMI"):
        a = F.col("a") + gain
        objective = F.col("relevance") - (a if criterion == "CIFE" else a / picked)
    elif criterion == "CMIM":
        a = running_max("a", gain)
        objective = F.col("relevance") - a
    elif criterion == "JMIM":
        a = running_max("a", gain - relevance)
        objective = F.col("relevance") - a
    else:
        a, b = running_max("a", F.col("mi")), running_max("b", F.col("cmi"))
        objective = F.col("relevance") - a + b
    return state.select("f", "relevance", objective.alias("objective"), a.alias("a"), b.alias("b"))


def _dense_greedy(top_k: int | None):
    def run(key, pdf):
        import numpy as np
        import pandas as pd

        method = key[0]
        i, j = pdf["f1"].to_numpy(), pdf["f2"].to_numpy()
        size = int(j.max()) + 1
        shared = np.zeros((size, size))
        given = np.zeros((size, size))
        shared[i, j] = shared[j, i] = pdf["mi"].to_numpy()
        given[i, j] = given[j, i] = pdf["cmi"].to_numpy()
        relevance = np.zeros(size)
        diagonal = pdf[pdf["f1"] == pdf["f2"]]
        relevance[diagonal["f1"].to_numpy()] = diagonal["relevance"].to_numpy()

        open_ = np.ones(size, dtype=bool)
        total = np.zeros(size)
        top_a = np.full(size, -np.inf)
        top_b = np.full(size, -np.inf)
        objective = relevance.copy()
        picks, values = [], []
        for step in range(1, min(top_k or size, size) + 1):
            best = int(np.argmax(np.where(open_, objective, -np.inf)))
            open_[best] = False
            picks.append(best)
            values.append(float(objective[best]))
            gain = shared[best] - given[best]
            total += gain
            if method == "CIFE":
                objective = relevance - total
            elif method == "JMI":
                objective = relevance - total / step
            elif method == "DMIM":
                top_a = np.maximum(top_a, shared[best])
                top_b = np.maximum(top_b, given[best])
                objective = relevance - top_a + top_b
            else:
                top_a = np.maximum(top_a, gain - relevance[best] if method == "JMIM" else gain)
                objective = relevance - top_a
        return pd.DataFrame({"method": method, "pos": range(len(picks)), "f": picks, "objective": values})

    return run
