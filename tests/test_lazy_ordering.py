"""Orders counted as needed against the orders of the whole pair table."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from erascope.operators import lazy_ordering as L
from erascope.operators.counts import count_pairs_between, count_pairs_with_target
from erascope.operators.information import information_between, pair_information
from erascope.operators.ordering import CRITERIA, greedy_order
from erascope.operators.projection import target_code
from erascope.workloads.tables import event_panel


@pytest.fixture(scope="module")
def wide(spark):
    """Forty features: noisy copies of five of the panel, so that many candidates share information."""
    panel = event_panel(spark, SMALL)
    number = F.col("id").cast("long")
    names, columns = [], []
    for i in range(40):
        base = F.col(f"feature_{'abcde'[i % 5]}").cast("int")
        noise = F.pmod(F.hash(number, F.lit(i)), F.lit(5))
        columns.append(F.when(F.pmod(F.hash(number, F.lit(100 + i)), F.lit(3 + i // 5)) == 0, noise).otherwise(F.pmod(base + (F.col("target") * 4).cast("int") * int(i % 3 == 0), F.lit(5))).cast("tinyint").alias(f"x{i}"))
        names.append(f"x{i}")
    rows = panel.select("target", *columns)
    return rows, names


@pytest.fixture(scope="module")
def whole(wide):
    rows, names = wide
    return pair_information(count_pairs_with_target(rows, names, target_code("target"), method="tiles")).toPandas()


@pytest.mark.parametrize("criterion", CRITERIA)
def test_same_order_as_from_the_whole_table(spark, wide, whole, criterion, monkeypatch):
    rows, names = wide
    want = greedy_order(spark.createDataFrame(whole), [criterion], top_k=8).orderBy("pos").toPandas()
    counted = []
    count = L._count
    monkeypatch.setattr(L, "_count", lambda r, n, s, picks, wanted, levels: counted.append(sum(len(picks) - s.met[f] for f in wanted)) or count(r, n, s, picks, wanted, levels))
    got = L.lazy_greedy_order(rows, names, target_code("target"), criterion, top_k=8, first=4).orderBy("pos").toPandas()
    assert got["f"].tolist() == want["f"].tolist()
    np.testing.assert_allclose(got["objective"], want["objective"], atol=1e-9)
    assert sum(counted) <= 7 * 40
    if criterion in ("CMIM", "JMIM"):
        assert sum(counted) < 7 * 40 * 0.8  # candidates that cannot win are not counted


def test_information_between(spark, wide, whole):
    rows, names = wide
    coded = rows.select(target_code("target").alias("_y"), *names)
    found = information_between(count_pairs_between(coded, names, [0, 7, 30], [2, 7])).collect()
    want = {(r.f1, r.f2): (r.mi, r.cmi) for r in whole.itertuples()}
    assert {(r["f1"], r["f2"]) for r in found} == {(a, b) for a in (0, 7, 30) for b in (2, 7)}
    for r in found:
        mi, cmi = want[min(r["f1"], r["f2"]), max(r["f1"], r["f2"])]
        assert (r["mi"], r["cmi"]) == pytest.approx((mi, cmi), abs=1e-12)


def test_odd_inputs(spark, wide):
    rows, names = wide
    none = L.lazy_greedy_order(rows.limit(0), names[:3], target_code("target"), "CMIM")
    assert none.collect() == [] and none.columns == ["method", "pos", "f", "objective"]
    same = rows.select("target", F.col("x1").alias("a"), F.col("x1").alias("b"), F.col("x1").alias("c"))
    assert [r["f"] for r in L.lazy_greedy_order(same, ["a", "b", "c"], target_code("target"), "JMIM").orderBy("pos").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="unknown criteria"):
        L.lazy_greedy_order(rows, names, target_code("target"), "MAX")
    with pytest.raises(Exception, match="out of range"):
        L.lazy_greedy_order(rows.withColumn("x0", F.lit(7)), names[:3], target_code("target"))


def test_long_lists_take_other_ways_to_the_same_order(spark, wide, whole, monkeypatch):
    from erascope.operators import ordering
    from erascope.plans import feature_ranking

    rows, names = wide
    some = names[:9]
    pairs = spark.createDataFrame(whole[(whole["f1"] < 9) & (whole["f2"] < 9)])
    want = greedy_order(pairs, ["JMIM"], top_k=4).orderBy("pos").toPandas()["f"].tolist()
    monkeypatch.setattr(ordering, "DENSE", 3)
    assert greedy_order(pairs, ["JMIM"], top_k=4).orderBy("pos").toPandas()["f"].tolist() == want
    monkeypatch.setattr(feature_ranking, "DENSE", 3)
    panel = rows.withColumn("era", F.lit(1))
    order = feature_ranking.rank_features(panel, some, era_1=5, criteria=["JMIM"], top_k=4).orderBy("pos")
    assert [r["feature"] for r in order.collect()] == [some[f] for f in want]


def test_rows_are_read_once_where_few_tuples_are_possible(spark, wide, whole):
    """All criteria together read the rows once, and the orders are those of the whole table."""
    rows, names = wide
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    some = names[:5]
    got = L.lazy_greedy_orders(rows.mapInArrow(seen, rows.schema), some, target_code("target"), ["CMIM", "JMIM", "DMIM"], first=2)
    assert reads.value == rows.count()
    pairs = spark.createDataFrame(whole[(whole["f1"] < 5) & (whole["f2"] < 5)])
    want = greedy_order(pairs, ["CMIM", "JMIM", "DMIM"])
    key = ["method", "pos", "f"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
