import itertools
from functools import partial

import numpy as np
import pandas as pd
import pytest
import reference_math as R
from conftest import SMALL
from pyspark.sql import functions as F

from erascope.operators import eras as E
from erascope.operators import scores as M
from erascope.plans.training import evaluate_predictions
from erascope.workloads.tables import event_panel

SEEDS = 100


def arrays(seed, n=100, eras=10):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "seed": seed,
            "row": range(n),
            "target": rng.choice([0, 0.25, 0.5, 0.75, 1], n).astype("float32"),
            "preds": rng.normal(size=n).astype("float32"),
            "other": rng.normal(size=n).astype("float32"),
            "meta": rng.normal(size=n).astype("float32"),
            "era": rng.integers(0, eras, n).astype("int32"),
        }
    )


@pytest.fixture(scope="module")
def many(spark):
    pdf = pd.concat([arrays(s) for s in range(SEEDS)], ignore_index=True)
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("strategy", ["window", "prefix"])
def test_scores_of_100_seeds(many, strategy):
    pdf, df = many
    # every seed is one group, so the grouped scores are the scores without eras
    got = M.era_scores(df, "preds", era="seed", strategy=strategy).toPandas().set_index("seed")
    for seed, g in pdf.groupby("seed"):
        t, p, m = (g[c].to_numpy("float64") for c in ("target", "preds", "meta"))
        assert abs(got["corr"][seed] - R.corr(t, p)) < 1e-6
        assert abs(got["mmc"][seed] - R.mmc(t, p, m)) < 1e-6
        assert abs(got["payoff"][seed] - R.payoff(t, p, m)) < 1e-6


def test_one_era_equals_no_era(spark):
    df = spark.createDataFrame(arrays(5)).withColumn("era", F.lit(1))
    per_era = M.era_scores(df, "preds").first()
    whole = M.global_scores(df, "preds").first()
    for c in M.METRICS:
        assert abs(per_era[c] - whole[c]) < 1e-9
    assert abs(M.annual_return(df, "preds", era=None).first()[0] - whole["payoff"]) < 1e-12


def test_no_era_takes_one_column(spark):
    with pytest.raises(ValueError):
        M.global_scores(spark.createDataFrame(arrays(1)), ["preds", "other"])


@pytest.mark.parametrize("strategy", ["window", "prefix"])
def test_ensemble_scores(spark, strategy):
    pdf = arrays(11, n=200, eras=4)
    got = M.era_scores(spark.createDataFrame(pdf), ["preds", "other"], strategy=strategy).toPandas().set_index("era")
    for era, g in pdf.groupby("era"):
        t, m = g["target"].to_numpy("float64"), g["meta"].to_numpy("float64")
        e = R.ensemble([g["preds"], g["other"]])
        assert abs(got["corr"][era] - R.corr(t, e)) < 1e-6
        assert abs(got["mmc"][era] - R.mmc(t, e, m)) < 1e-6


def test_ensemble_of_one_column_keeps_its_scores(spark):
    df = spark.createDataFrame(arrays(2))
    single = E.ensemble(df, ["preds"]).toPandas()
    plain = E.gaussianize(df, {"g": "preds"}).toPandas()
    merged = single.merge(plain, on="row")
    assert np.allclose(merged["ensemble"], merged["g"], atol=1e-12)


def edge_frame(spark):
    rows = []
    for i in range(8):
        t, p = (i % 5) / 4, float(i * 7 % 11)
        rows.append((1, t, p, float("nan")))  # no meta in this era
        rows.append((2, t, 3.0, float(i)))  # constant predictions
        rows.append((4, 0.5, p, float(i)))  # constant target
        rows.append((5, t, p, None if i == 3 else float(i)))  # one missing meta value
        rows.append((6, float("nan") if i == 2 else t, p, float(i)))  # a missing target
    rows.append((3, 0.25, 1.0, 2.0))  # a single row
    return spark.createDataFrame(rows, "era int, target double, preds double, meta double")


@pytest.mark.parametrize("strategy", ["window", "prefix"])
def test_edge_eras(spark, strategy):
    got = M.era_scores(edge_frame(spark), "preds", strategy=strategy).toPandas().set_index("era")
    nan = np.isnan
    assert not nan(got["corr"][1]) and nan(got["mmc"][1]) and nan(got["payoff"][1])
    assert nan(got["corr"][2]) and abs(got["mmc"][2]) < 1e-12
    assert nan(got["corr"][3]) and nan(got["mmc"][3])
    assert nan(got["corr"][4]) and abs(got["mmc"][4]) < 1e-12
    assert not nan(got["mmc"][5])
    assert nan(got["corr"][6]) and nan(got["mmc"][6])
    total = M.score_summary(M.era_scores(edge_frame(spark), "preds", strategy=strategy)).first()
    assert all(nan(total[c]) for c in (*M.METRICS, "annual_return"))


def test_missing_meta_is_allowed_for_corr(spark):
    df = spark.createDataFrame(arrays(4)).drop("meta")
    assert not np.isnan(M.corr(df, "preds").first()[0])
    scores = M.era_scores(df, "preds", meta=None).toPandas()
    assert scores["mmc"].isna().all() and not scores["corr"].isna().any()


def test_annual_return_rules(spark):
    def of(values):
        df = spark.createDataFrame([(float(v),) for v in values], "payoff double")
        return df.agg(M.annualized_return("payoff")).first()[0]

    assert abs(of([0.01] * 3) - (1.001**260 - 1)) < 1e-9
    assert np.isnan(of([0.1, -11])) and of([0.1, -10]) == -1.0 and np.isnan(of([0.1, float("nan")]))
    payoffs = np.random.default_rng(0).normal(0, 0.1, 260)
    assert abs(of(payoffs) - (np.prod(1 + 0.1 * payoffs) - 1)) < 1e-9


def test_equal_eras_have_the_closed_form(spark):
    pdf = arrays(8, n=30)
    tiled = pd.concat([pdf.assign(era=np.int32(k)) for k in range(260)], ignore_index=True)
    one = R.payoff(*(pdf[c].to_numpy("float64") for c in ("target", "preds", "meta")))
    got = M.annual_return(spark.createDataFrame(tiled), "preds").first()[0]
    assert abs(got - ((1 + 0.1 * one) ** 260 - 1)) < 1e-5 * abs(got)


@pytest.mark.parametrize("strategy", ["window", "prefix"])
def test_vectors_reproduce_the_scores(many, strategy):
    pdf, df = many
    part = df.where("seed < 20")
    rows = M.mmc_vector(M.corr_vector(part, era="seed", strategy=strategy), era="seed", strategy=strategy)
    rows = E.gaussianize(rows, {"g": "preds"}, by=("seed",))
    g = F.col("g")
    sums = rows.groupBy("seed").agg(
        F.sum(F.col("corr_vector") * F.signum(g) * F.pow(F.abs(g), F.lit(1.5))).alias("corr"),
        F.sum(F.col("mmc_vector") * g).alias("mmc"),
    ).toPandas().set_index("seed")
    scores = M.era_scores(part, "preds", era="seed").toPandas().set_index("seed")
    assert np.allclose(sums["corr"], scores["corr"].loc[sums.index], atol=1e-9)
    assert np.allclose(sums["mmc"], scores["mmc"].loc[sums.index], atol=1e-9)


def test_payoff_vector_is_a_good_lower_bound(spark):
    rng = np.random.default_rng(6)
    n = 7
    pdf = pd.DataFrame({"era": 1, "target": rng.permutation(n) / n, "meta": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    got = M.era_scores(M.payoff_vector(df), "payoff_vector").first()["payoff"]
    t, m = pdf["target"].to_numpy(), pdf["meta"].to_numpy()
    every = [R.payoff(t, np.array(p, dtype=float), m) for p in itertools.permutations(range(n))]
    assert np.quantile(every, 0.99) <= got <= max(every) + 1e-9


def test_user_scores(spark):
    def spread(t, p, m):
        return F.max(p) - F.min(p)

    def spread_arrays(t, p, m):
        return p.max() - p.min()

    df = spark.createDataFrame(arrays(9))
    a = M.erawise(df, spread, "preds").toPandas().set_index("era").sort_index()
    b = M.erawise_pandas(df, partial(spread_arrays), "preds").toPandas().set_index("era").sort_index()
    assert list(a.columns) == ["spread"] and list(b.columns) == ["spread_arrays"]
    assert np.allclose(a["spread"], b["spread_arrays"])
    with pytest.raises(ValueError, match="erawise"):
        M.erawise_pandas(df, spread_arrays, "preds", max_era_rows=3)


def test_user_scores_get_the_meta_model_as_given(spark):
    df = spark.createDataFrame(arrays(9)).withColumn("meta", F.col("meta") * 3.0 + 1.0)
    a = M.erawise(df, lambda t, p, m: F.avg(m), "preds", name="s").orderBy("era").toPandas()
    b = M.erawise_pandas(df, lambda t, p, m: m.mean(), "preds", name="s").orderBy("era").toPandas()
    want = df.groupBy("era").agg(F.avg("meta").alias("s")).orderBy("era").toPandas()
    assert np.allclose(a["s"], want["s"]) and np.allclose(b["s"], want["s"])


def test_user_score_with_its_own_aggregate(spark):
    df = spark.createDataFrame(arrays(9)).withColumn("prediction", F.col("preds"))
    columns, both = M.UserScore(lambda t, p, m: F.avg(p * t), F.max), M.UserScore(lambda t, p, m: (p * t).mean(), F.max, arrays=True)
    per_era = M.erawise(df, lambda t, p, m: F.avg(p * t), "preds", name="s").toPandas()["s"]
    for user in (columns, both):
        got = evaluate_predictions(df, "val", metrics=["corr", user]).toPandas().set_index("metric")["value"]
        assert abs(got["<lambda>"] - per_era.max()) < 1e-12


@pytest.mark.parametrize("hot", [1, 2, 3, 4])
def test_rows_without_a_group_rank_alike_in_every_plan(spark, hot):
    rows = [(None, 1.0), (None, 3.0), (None, 2.0), (1, 5.0), (1, 5.0), (2, None)]
    df = spark.createDataFrame(rows, "era int, v double")
    want = sorted(map(tuple, E.average_rank(df, {"r": "v"}, strategy="window").select("era", "v", "r").collect()), key=repr)
    for options in ({"strategy": "prefix"}, {"hot_rows": hot}):
        got = E.average_rank(df, {"r": "v"}, **options).select("era", "v", "r").collect()
        assert sorted(map(tuple, got), key=repr) == want
        for fn in (E.center, E.gaussianize, E.standardize):
            a = sorted(map(tuple, fn(df, {"r": "v"}, **options).select("era", "v", F.round("r", 9)).collect()), key=repr)
            b = sorted(map(tuple, fn(df, {"r": "v"}, strategy="window").select("era", "v", F.round("r", 9)).collect()), key=repr)
            assert repr(a) == repr(b)
    weighted = M.corr_vector(df.withColumn("target", F.col("v")), strategy="prefix")
    again = M.corr_vector(df.withColumn("target", F.col("v")), strategy="window")
    key = lambda rows: sorted((r["era"] or 0, r["v"] or 0, repr(round(r["corr_vector"], 9))) for r in rows)
    assert key(weighted.collect()) == key(again.collect())


def test_monotone_transform_keeps_corr(spark):
    df = spark.createDataFrame(arrays(12)).withColumn("moved", F.exp(F.col("preds") * 2.0))
    a, b = (M.corr(df, c).first()[0] for c in ("preds", "moved"))
    assert abs(a - b) < 1e-12


def test_rows_without_an_era_take_no_part(spark):
    df = spark.createDataFrame(arrays(13))
    extra = df.limit(5).withColumn("era", F.lit(None).cast("int"))
    for how in ("window", "prefix"):
        a = M.era_scores(df.unionByName(extra), "preds", strategy=how).orderBy("era").toPandas()
        b = M.era_scores(df, "preds", strategy=how).orderBy("era").toPandas()
        # sums of doubles may differ in the last bit, as their order is open
        pd.testing.assert_frame_equal(a, b, rtol=1e-12, atol=1e-12)


def test_mergeable_user_score_of_a_hot_era(spark):
    """An era with a third of the rows: it comes in batches, is added up in parts, and the score is erawise's."""
    from erascope.workloads.queries import pearson_in_parts

    panel = event_panel(spark, SMALL).withColumn("era", F.when(F.col("era") <= 10, 1).otherwise(F.col("era"))).repartition(12)
    score = pearson_in_parts()
    want = {r["era"]: r["c"] for r in M.erawise(panel, lambda t, p, m: F.corr(t, p), "preds_0", name="c").collect()}
    calls = spark.sparkContext.accumulator(0)

    def add(state, t, p, m):
        assert len(t) <= 50
        calls.add(1)
        return score.add(state, t, p, m)

    counted = M.MergeableScore(score.start, add, score.merge, score.finish, "pearson")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    for strategy, hot in (("auto", 50), ("prefix", 50), ("window", 8_000_000)):
        got = {r["era"]: r["pearson"] for r in M.erawise_mergeable(panel, counted, "preds_0", strategy=strategy, hot_rows=hot).collect()}
        assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    assert calls.value > 3 * len(want) + 10
    value = M.UserScore(counted).value(panel, "preds_0").first()["value"]
    assert abs(value - sum(want.values()) / len(want)) < 1e-9
    assert M.erawise_mergeable(panel.limit(0), counted, "preds_0").collect() == []
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
