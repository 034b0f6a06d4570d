import numpy as np
import pandas as pd
import pytest
import reference_math as R
from pyspark.sql import functions as F

from erascope.operators.counts import (
    count_pairs,
    count_pairs_with_target,
    count_values,
    count_with_target,
    mirrored,
    pair_counts_of,
    target_counts_of,
)
from erascope.operators.information import cmi_of_pairs, mi_of_pairs, mi_with_target, pair_information
from erascope.operators.ordering import CRITERIA, greedy_order, greedy_order_steps, named_order
from erascope.operators.projection import target_code
from erascope.plans import feature_ranking

NAMES = [f"feature_{i}" for i in range(4)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 5, (400, 4))
    x[:, 3] = np.where(rng.random(400) < 0.6, x[:, 0], x[:, 3])
    y = np.where(rng.random(400) < 0.5, x[:, 1], rng.integers(0, 5, 400))
    pdf = pd.DataFrame(x.astype("int8"), columns=NAMES).assign(target=(y / 4).astype("float32"), era=np.int32(1))
    return x, y, spark.createDataFrame(pdf)


def as_set(df, columns):
    return {tuple(int(v) for v in r) for r in df.select(*columns).collect()}


FULL = ["f1", "f2", "u", "v", "y", "n"]


def test_pair_counts_by_every_method(panel):
    x, y, df = panel
    want = set()
    for a in range(4):
        for b in range(4):
            for u in range(5):
                for v in range(5):
                    for k in range(5):
                        n = int(((x[:, a] == u) & (x[:, b] == v) & (y == k)).sum())
                        if n:
                            want.add((a, b, u, v, k, n))
    code = target_code("target")
    for options in ({"method": "tuples"}, {"method": "tiles"}, {"method": "tiles", "tile": 1},
                    {"method": "tiles", "tile": 3, "max_tasks": 1}, {}):
        got = mirrored(count_pairs_with_target(df, NAMES, code, **options))
        assert as_set(got, FULL) == want, options


def test_marginals_agree(panel):
    _, _, df = panel
    code = target_code("target")
    pairs = count_pairs_with_target(df, NAMES, code)
    assert as_set(target_counts_of(pairs), ["f", "x", "y", "n"]) == as_set(
        count_with_target(df, NAMES, code), ["f", "x", "y", "n"]
    )
    cells = ["f1", "f2", "u", "v", "n"]
    assert as_set(pair_counts_of(pairs), cells) == as_set(count_pairs(df, NAMES), cells)
    totals = count_values(df, NAMES).groupBy("f").agg(F.sum("n").alias("n"))
    assert as_set(totals, ["n"]) == {(400,)}


def test_values_out_of_range_fail(panel):
    _, _, df = panel
    bad = df.withColumn("feature_1", F.when(F.col("feature_1") == 4, F.lit(5)).otherwise(F.col("feature_1")).cast("tinyint"))
    for method in ("tuples", "tiles"):
        with pytest.raises(Exception, match="out of range"):
            count_pairs_with_target(bad, NAMES, target_code("target"), method=method).collect()
    with pytest.raises(Exception, match="out of range"):
        count_values(bad, NAMES).collect()


def test_rows_without_a_class_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan"))], "feature_a tinyint, target float")
    for method in ("tuples", "tiles"):
        got = count_pairs_with_target(df, ["feature_a"], target_code("target"), method=method).collect()
        assert [(r["u"], r["y"], r["n"]) for r in got] == [(1, 2, 1)]


def test_information(panel):
    x, y, df = panel
    mi, cmi, rel = R.information(x, y)
    pairs = mirrored(count_pairs_with_target(df, NAMES, target_code("target")))
    got = pair_information(pairs).toPandas()
    for r in got.itertuples():
        assert abs(r.mi - mi[r.f1, r.f2]) < 1e-9
        assert abs(r.cmi - cmi[r.f1, r.f2]) < 1e-9
        assert abs(r.relevance - rel[r.f1]) < 1e-9
    alone = mi_with_target(count_with_target(df, NAMES, target_code("target"))).toPandas()
    assert np.allclose(alone.sort_values("f")["mi"], rel)
    assert {r["f1"] for r in mi_of_pairs(count_pairs(df, NAMES)).collect()} == {0, 1, 2, 3}
    assert cmi_of_pairs(pairs).count() == 16


def test_greedy_orders_against_brute_force(spark):
    rng = np.random.default_rng(5)
    size = 9
    raw = rng.random((size, size))
    mi, cmi = (raw + raw.T) / 2, (raw.T * raw) ** 0.5
    rel = rng.random(size)
    rows = [(i, j, float(mi[i, j]), float(cmi[i, j]), float(rel[i])) for i in range(size) for j in range(i, size)]
    pairs = spark.createDataFrame(rows, "f1 int, f2 int, mi double, cmi double, relevance double").cache()
    dense = greedy_order(pairs).toPandas()
    for method in CRITERIA:
        want = R.greedy(mi, cmi, rel, method)
        got = dense[dense["method"] == method].sort_values("pos")["f"].tolist()
        assert got == want, method
    for method in ("CIFE", "JMIM", "DMIM"):
        steps = [r["f"] for r in greedy_order_steps(pairs, method, top_k=4).collect()]
        assert steps == R.greedy(mi, cmi, rel, method)[:4]
    assert greedy_order(pairs, ["JMI"], top_k=3).count() == 3
    with pytest.raises(ValueError):
        greedy_order(pairs, ["XYZ"])


def test_both_greedy_forms_agree(spark, panel):
    x, y, df = panel
    pairs = pair_information(count_pairs_with_target(df, NAMES, target_code("target"))).cache()
    dense = greedy_order(pairs, ["DMIM"]).orderBy("pos").toPandas()
    steps = greedy_order_steps(pairs, "DMIM").orderBy("pos").toPandas()
    assert dense["f"].tolist() == steps["f"].tolist()
    assert np.allclose(dense["objective"], steps["objective"])


@pytest.mark.parametrize("method", ["tuples", "tiles"])
def test_class_out_of_range_fails_in_every_form(spark, method):
    df = spark.createDataFrame([(1, 2, 2.0), (0, 1, 0.5), (0, 1, None)], "a int, b int, target double")
    code = target_code("target")
    with pytest.raises(Exception, match="target class out of range"):
        count_pairs_with_target(df, ["a", "b"], code, method=method).collect()
    with pytest.raises(Exception, match="target class out of range"):
        count_with_target(df, ["a", "b"], code).collect()
    good = df.where("target IS NULL OR target < 1")
    assert sum(r["n"] for r in count_pairs_with_target(good, ["a", "b"], code, method=method).collect()) == 3


def test_tiles_do_not_depend_on_batches(spark, panel, monkeypatch):
    from erascope.operators import counts

    _, _, df = panel
    want = sorted(map(tuple, count_pairs_with_target(df, NAMES, target_code("target"), method="tuples").collect()))
    monkeypatch.setattr(counts, "PIECE", 3)
    got = count_pairs_with_target(df, NAMES, target_code("target"), method="tiles", tile=2)
    assert sorted(map(tuple, got.collect())) == want


def test_ranking_job(panel):
    _, _, df = panel
    order = feature_ranking.rank_features(df, NAMES, era_1=2).toPandas()
    assert set(order["method"]) == set(CRITERIA)
    assert all(sorted(g["feature"]) == NAMES for _, g in order.groupby("method"))
    assert named_order(greedy_order(pair_information(count_pairs_with_target(df, NAMES, target_code("target")))), NAMES).count() == 20
