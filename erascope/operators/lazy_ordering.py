"""Greedy feature orders without a table of all pairs (F9, F10 for long lists).

An objective needs only the information between a candidate and the features picked so far. So each pick is counted
against candidates, and not all pairs beforehand: ``picks x features`` pair counts instead of half the square.
For the criteria with running maxima most of these are not needed either: what a candidate had when it was last
counted bounds what it can have now, so only candidates whose bound reaches the best objective are counted
against the picks they have not met. The state is one row of numbers per feature and lives on the driver; the
counts of a step are one aggregate over the rows, summed by Spark. Where only few tuples of values are possible the rows
are counted per tuple once, and the steps read the tuples.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.operators.counts import checked_class, count_pairs_between, count_tuples, count_with_target, few_tuples
from erascope.operators.information import information_between, mi_with_target
from erascope.operators.ordering import DEFAULT_CRITERION, check_criteria
from erascope.session import scratch_path

# Candidates that are counted first at every step, best bounds first.
FIRST = 32
# Bounds are sums in another order than the objectives they bound.
SLACK = 1e-9
SUMS = ("CIFE", "JMI")
# Column of a table of tuples that says how many rows have them.
WEIGHT = "_n"


@dataclass
class State:
    """Per feature: relevance, information left given the target, running sums or maxima, and picks met so far."""

    criterion: str
    relevance: np.ndarray
    entropy: np.ndarray  # of the feature given the target: the information with any other given it is not larger
    a: np.ndarray
    b: np.ndarray
    met: np.ndarray
    open: np.ndarray

    @staticmethod
    def start(criterion: str, relevance: np.ndarray, entropy: np.ndarray) -> State:
        size = len(relevance)
        low = 0.0 if criterion in SUMS else -np.inf
        return State(criterion, relevance, entropy, np.full(size, low), np.full(size, low), np.zeros(size, int), np.ones(size, bool))

    def meet(self, f: int, picks: Sequence[int], mi: np.ndarray, cmi: np.ndarray) -> None:
        """Take in the information of ``f`` with the picks it had not met, in their order."""
        for s, shared, given in zip(picks, mi, cmi, strict=True):
            gain = shared - given
            if self.criterion in SUMS:
                self.a[f] += gain
            elif self.criterion == "CMIM":
                self.a[f] = max(self.a[f], gain)
            elif self.criterion == "JMIM":
                self.a[f] = max(self.a[f], gain - self.relevance[s])
            else:
                self.a[f], self.b[f] = max(self.a[f], shared), max(self.b[f], given)
        self.met[f] += len(picks)

    def objective(self, f: np.ndarray) -> np.ndarray:
        """Objectives of candidates that have met at least one pick, exact if they have met all."""
        if self.criterion == "CIFE":
            return self.relevance[f] - self.a[f]
        if self.criterion == "JMI":
            return self.relevance[f] - self.a[f] / np.maximum(self.met[f], 1)
        if self.criterion == "DMIM":
            return self.relevance[f] - self.a[f] + self.b[f]
        return self.relevance[f] - self.a[f]

    def bounds(self, picks: Sequence[int]) -> np.ndarray:
        """What the objective of each feature is at most, given the picks; infinite where it has met none."""
        every = np.arange(len(self.relevance))
        none = self.met == 0
        if not picks:
            return self.relevance
        with np.errstate(invalid="ignore"):
            bound = self.objective(every)
            if self.criterion == "DMIM":
                # a pick not met yet may share as much given the target as either feature holds
                largest = np.array([max((self.entropy[s] for s in picks[m:]), default=-np.inf) for m in range(len(picks) + 1)])
                given = np.maximum(self.b, np.minimum(self.entropy, largest[self.met]))
                bound = self.relevance - self.a + given
        bound[none | (np.isin(self.criterion, SUMS) & (self.met < len(picks)))] = np.inf
        return bound


def entropy_given_target(counts: DataFrame) -> DataFrame:
    """``(f, h)`` from ``(f, x, y, n)``: entropy of each feature given the target."""
    totals = counts.groupBy("f", "y").agg(F.sum("n").alias("_y"))
    n = counts.groupBy("f").agg(F.sum("n").alias("_n"))
    share = F.col("n") / F.col("_n")
    return counts.join(totals, ["f", "y"]).join(n, "f").groupBy("f").agg(F.sum(-share * F.log(F.col("n") / F.col("_y"))).alias("h"))


def lazy_greedy_order(
    df: DataFrame, features: Sequence[str], code: Column, criterion: str = DEFAULT_CRITERION, top_k: int | None = None,
    levels: int = S.FEATURE_LEVELS, first: int = FIRST,
) -> DataFrame:
    """F9. ``(method, pos, f, objective)``: the order that ``ordering.greedy_order`` gives, counted as needed; see ``lazy_greedy_orders``."""
    return lazy_greedy_orders(df, features, code, [criterion], top_k, levels, first)


def lazy_greedy_orders(
    df: DataFrame, features: Sequence[str], code: Column, criteria: Sequence[str], top_k: int | None = None,
    levels: int = S.FEATURE_LEVELS, first: int = FIRST,
) -> DataFrame:
    """F9. ``(method, pos, f, objective)`` for each criterion.

    ``df`` is read once if few tuples of values are possible. Else it is read once per step, only the columns that are
    counted; pass something that is cheap to read again, such as a table. Ties go to the lowest position.
    """
    check_criteria(criteria)
    names, weight = list(features), None
    if few_tuples(names, levels):
        path, weight = scratch_path(df.sparkSession, "feature-tuples"), WEIGHT
        count_tuples(df, names, code, levels).write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
    else:
        rows = df.select(checked_class(code, levels).alias("_y"), *dict.fromkeys(names)).where(F.col("_y").isNotNull())
    singles = count_with_target(rows, names, F.col("_y"), levels, weight)
    relevance, entropy = np.zeros(len(names)), np.zeros(len(names))
    found = mi_with_target(singles).join(entropy_given_target(singles), "f").collect()
    for r in found:
        relevance[r["f"]], entropy[r["f"]] = r["mi"], r["h"]
    # without rows there is nothing to order
    ordered = [(c, *at) for c in criteria if found for at in _order(rows, names, State.start(c, relevance, entropy), top_k, levels, first)]
    return df.sparkSession.createDataFrame(ordered, "method string, pos int, f int, objective double")


def _order(rows: DataFrame, names: list[str], state: State, top_k: int | None, levels: int, first: int) -> list[tuple[int, int, float]]:
    """Position, feature and objective of every pick."""
    picks: list[int] = []
    values: list[float] = []
    limit = min(top_k or len(names), len(names))
    while len(picks) < limit and state.open.any():
        best = _next_pick(rows, names, state, picks, levels, first)
        values.append(float((state.objective if picks else state.relevance.__getitem__)(np.array([best]))[0]))
        picks.append(best)
        state.open[best] = False
    return [(i, f, v) for i, (f, v) in enumerate(zip(picks, values, strict=True))]


def _next_pick(rows: DataFrame, names: list[str], state: State, picks: list[int], levels: int, first: int) -> int:
    """The candidate with the largest objective: a few with the best bounds first, then all whose bound reaches theirs."""
    if not picks:
        return int(np.argmax(np.where(state.open, state.relevance, -np.inf)))
    for size in (first, None):
        bounds = np.where(state.open, state.bounds(picks), -np.inf)
        behind = state.open & (state.met < len(picks))
        exact = state.open & ~behind
        reached = state.objective(np.flatnonzero(exact)).max() - SLACK if exact.any() else -np.inf
        wanted = np.flatnonzero(behind & (bounds >= reached))
        if size is not None and state.criterion not in SUMS:
            wanted = wanted[np.lexsort((wanted, -state.relevance[wanted], -bounds[wanted]))][:size]
        if len(wanted):
            _count(rows, names, state, picks, wanted.tolist(), levels)
    done = np.flatnonzero(state.open & (state.met == len(picks)))
    return int(done[np.argmax(state.objective(done))])


def _count(rows: DataFrame, names: list[str], state: State, picks: list[int], wanted: list[int], levels: int) -> None:
    """Count the candidates against the picks that some of them have not met, and bring those up to date."""
    oldest = min(int(state.met[f]) for f in wanted)
    counted = count_pairs_between(rows, names, wanted, picks[oldest:], levels, WEIGHT if WEIGHT in rows.columns and WEIGHT not in names else None)
    place = {s: i for i, s in enumerate(picks[oldest:])}
    mi, cmi = (np.zeros((len(names), len(place))) for _ in range(2))
    for r in information_between(counted).collect():
        mi[r["f1"], place[r["f2"]]], cmi[r["f1"], place[r["f2"]]] = r["mi"], r["cmi"]
    for f in wanted:
        since = int(state.met[f])
        state.meet(f, picks[since:], mi[f, since - oldest :], cmi[f, since - oldest :])
