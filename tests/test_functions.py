import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reference_math import normal_scores, ppf

from erascope.functions.numeric import norm_ppf, safe_div, signed_power, with_norm_ppf
from erascope.functions.ranking import BINS_PER_GROUP, VALUES_PER_BIN, as_rankable, float_bin, profile_groups
from erascope.operators import eras as E


def test_ppf_both_forms(spark):
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 2001), [1e-15, 1e-12, 0.075, 0.925, 0.5]])
    df = spark.createDataFrame(pd.DataFrame({"p": p}))
    got = with_norm_ppf(df, {"q": F.col("p")}).withColumn("c", norm_ppf(F.col("p"))).toPandas()
    want = ppf(got["p"])
    assert np.abs(got["q"] - want).max() < 1e-14 * 1e2
    assert np.array_equal(got["q"], got["c"])


def test_safe_div_and_power(spark):
    row = spark.range(1).select(
        safe_div(F.lit(0.0), F.lit(0.0)).alias("a"), safe_div(F.lit(1.0), F.lit(4.0)).alias("b"),
        signed_power(F.lit(-4.0)).alias("c"), signed_power(F.lit(float("nan"))).alias("d"),
    ).first()
    assert np.isnan(row["a"]) and row["b"] == 0.25 and row["c"] == -8.0 and np.isnan(row["d"])


def test_float_bins_are_monotone_and_small(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**32, 50_000, dtype=np.uint64).astype(np.uint32).view(np.float32)
    powers = np.array([2.0**e for e in range(-149, 128)], dtype=np.float32)
    edges = np.concatenate([powers, np.nextafter(powers, np.float32(0)), np.nextafter(powers, np.float32(np.inf))])
    x = np.concatenate([bits[~np.isnan(bits)], edges, -edges, np.float32([0, np.inf, -np.inf])])
    x = np.unique(x).astype(np.float32)
    one_octave = np.arange(2**23, dtype=np.uint32)[::64] + np.float32(1).view(np.uint32)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "x": x}))
    bins = df.select("i", float_bin(F.col("x").cast("float")).alias("b")).orderBy("i").toPandas()["b"].to_numpy()
    assert (np.diff(bins) >= 0).all()
    assert np.abs(bins).max() <= BINS_PER_GROUP
    dense = spark.createDataFrame(pd.DataFrame({"x": one_octave.view(np.float32)}))
    largest = dense.groupBy(float_bin(F.col("x").cast("float"))).count().agg(F.max("count")).first()[0]
    assert largest * 64 <= VALUES_PER_BIN


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.integers(1, 3),
            st.one_of(st.none(), st.just(float("nan")), st.sampled_from([0.0, -0.0, 1.5, -2.0]),
                      st.floats(width=32, allow_nan=False)),
        ),
        min_size=1, max_size=40,
    )
)
def test_rank_plans_agree_with_pandas(spark, rows):
    df = spark.createDataFrame([(i, e, v) for i, (e, v) in enumerate(rows)], "i int, era int, v double")
    frames = [
        E.average_rank(df, {"r": "v"}, strategy=s).select("i", "r").toPandas().set_index("i")["r"].sort_index()
        for s in ("window", "prefix")
    ]
    pdf = pd.DataFrame(rows, columns=["era", "v"])
    # NaN and null are one value above everything else
    values = np.array([np.nan if v is None else v for v in pdf["v"]], dtype=np.float32)
    key = pd.DataFrame({"nan": np.isnan(values), "v": np.nan_to_num(values, nan=0, posinf=np.inf, neginf=-np.inf) + 0.0})
    want = []
    for i in range(len(pdf)):
        same = pdf["era"] == pdf["era"][i]
        less = same & ((key["nan"] < key["nan"][i]) | ((key["nan"] == key["nan"][i]) & (key["v"] < key["v"][i])))
        equal = same & (key["nan"] == key["nan"][i]) & (key["v"] == key["v"][i])
        want.append(less.sum() + (equal.sum() + 1) / 2)
    for got in frames:
        assert got.tolist() == want


def test_hot_split_equals_one_plan(spark):
    rng = np.random.default_rng(3)
    # one era holds most rows, one value a third of them
    era = np.where(rng.random(3000) < 0.7, 1, rng.integers(2, 9, 3000))
    v = np.where(rng.random(3000) < 0.33, 0.5, rng.normal(size=3000).round(2))
    df = spark.createDataFrame(pd.DataFrame({"i": range(3000), "era": era.astype("int32"), "v": v}))
    assert profile_groups(df, ["era"], 1000).hot == 1
    split = E.gaussianize(df, {"g": "v"}, hot_rows=1000).toPandas().set_index("i").sort_index()
    plain = E.gaussianize(df, {"g": "v"}, strategy="window").toPandas().set_index("i").sort_index()
    assert np.allclose(split["g"], plain["g"], atol=1e-12)
    one = v[era == 1]
    assert np.allclose(split["g"][split["era"] == 1], normal_scores(one), atol=1e-9)


def test_whole_table_rank_needs_no_unpartitioned_window(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 / 3).alias("v"))
    got = E.gaussianize(df, {"g": "v"}, by=()).toPandas().sort_values("id")
    assert np.allclose(got["g"], normal_scores(got["v"]), atol=1e-9)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        E.average_rank(spark.range(3).withColumn("era", F.lit(1)), {"r": "id"}, strategy="fast")


def test_rankable_keeps_float32_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0 + 1e-12)], "era int, v double")
    assert df.select(as_rankable("v").alias("x")).distinct().count() == 1


def test_transforms(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 0.0), (2, 5.0, 0.0)], "era int, a double, m double")
    for how in ("window", "prefix"):
        c = E.center(df, {"c": "a"}, strategy=how).orderBy("era", "a").toPandas()
        assert c["c"].tolist() == [-1.0, 1.0, 0.0, 0.0]
        z = E.standardize(df, {"z": "a"}, strategy=how).orderBy("era", "a").toPandas()["z"]
        assert z.tolist()[:2] == [1.0, 3.0] and z[2:].isna().all()
        o = E.orthogonal_projection(df, "m", "a", "o", strategy=how).orderBy("era", "a").toPandas()["o"]
        assert np.allclose(o[:2], [1 - 2 * 14 / 20, 3 - 4 * 14 / 20]) and o[2:].isna().all()
