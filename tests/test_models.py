import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from erascope.errors import NotTrained, SingularSystem
from erascope.operators.gram import ONE, gram, to_matrix
from erascope.operators.linear import LeastSquares, LinearModel, fit_ols
from erascope.operators.selection import (
    AttributionStrategy,
    FunctionStrategy,
    eliminate,
    select_features,
    selected_only,
    student_two_sided,
)
from erascope.plans.serving import predict_function, predict_with
from erascope.plans.training import (
    TREE_PRESETS,
    Module,
    PanelData,
    Trainer,
    boosted_trees,
    least_squares_module,
    populate_metrics,
    train,
)
from erascope.session import scratch_path
from erascope.sources.runs import RunStore, best_run, flatten, flatten_json, split_metric
from erascope.splits import EraRange, Splits
from erascope.workloads.tables import EVENT_FEATURES, event_panel

X = [f"x{i}" for i in range(5)]


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame(rng.normal(size=(100, 5)).astype("int8"), columns=X)
    pdf["y0"] = rng.random(100).astype("float32")
    pdf["y1"] = (pdf["x1"] * 2 - pdf["x3"] + rng.normal(size=100)).astype("float32")
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["expressions", "blocks"])
@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("targets", [["y0"], ["y0", "y1"]])
def test_ols_against_numpy(regression, method, intercept, targets):
    pdf, df = regression
    model = fit_ols(df, X, targets, intercept, method)
    a = pdf[X].to_numpy("float64")
    a = np.column_stack([np.ones(100), a]) if intercept else a
    want = np.linalg.lstsq(a, pdf[targets].to_numpy("float64"), rcond=None)[0]
    got = np.array(model.coefficients).T
    assert np.allclose(got, want[1:] if intercept else want, atol=1e-10)
    assert np.allclose(model.intercepts, want[0] if intercept else 0.0, atol=1e-10)
    scored = model.transform(df).toPandas()
    names = ["prediction"] if len(targets) == 1 else [f"prediction_{t}" for t in targets]
    assert np.allclose(scored[names].to_numpy(), a @ want, atol=1e-9)


def test_gram_does_not_depend_on_blocks(regression, spark):
    pdf, df = regression
    columns = [ONE, *X, "y0"]
    a = np.column_stack([np.ones(100), pdf[X + ["y0"]].to_numpy("float64")])
    for part in (df, df.repartition(7)):
        for options in ({}, {"method": "blocks"}, {"method": "blocks", "max_tasks": 1}):
            assert np.allclose(to_matrix(gram(part, columns, **options), 7), a.T @ a, atol=1e-9)
    for method in ("expressions", "blocks"):
        with pytest.raises(Exception, match="missing value"):
            gram(df.withColumn("x0", F.lit(None).cast("double")), X, method).collect()
    with pytest.raises(ValueError):
        gram(df, X, "guess")


def test_ols_errors(regression, spark):
    _, df = regression
    with pytest.raises(SingularSystem):
        fit_ols(df.withColumn("twice", F.col("x0") * 2), ["x0", "twice"], ["y0"])
    model = fit_ols(df, X, ["y0"])
    with pytest.raises(ValueError, match="fitted on 5"):
        model.transform(df, ["x0"])
    path = scratch_path(spark, "model")
    both = fit_ols(df, X, ["y0", "y1"])
    both.save(spark, path)
    assert LinearModel.load(spark, path) == both


def brute_elimination(a, y, threshold):
    alive, dropped = list(range(a.shape[1])), []
    while alive:
        b = a[:, alive]
        beta = np.linalg.lstsq(b, y, rcond=None)[0]
        rest = y - b @ beta
        freedom = len(y) - len(alive)
        t = beta / np.sqrt(rest @ rest / freedom * np.diag(np.linalg.inv(b.T @ b)))
        if t.min() >= 0:
            p = [student_two_sided(v, freedom) for v in t]
            return dropped, [k for k, bt, pv in zip(alive, beta, p) if bt > 0 and pv < threshold], dict(zip(alive, t))
        dropped.append(alive.pop(int(np.argmin(t))))
    return dropped, [], {}


def test_elimination_against_direct_regressions(spark):
    rng = np.random.default_rng(3)
    n, k = 300, 8
    a = rng.normal(size=(n, k))
    y = a[:, 0] * 1.0 + a[:, 1] * 0.4 - a[:, 2] * 0.8 + a[:, 3] * 0.05 + rng.normal(size=n)
    names = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame(pd.DataFrame(a, columns=[f"attr_{c}" for c in names]).assign(target=y))
    report = eliminate(df, names).toPandas()
    dropped, kept, t = brute_elimination(a, y, 0.05)
    order = report[report["dropped_at"].notna()].sort_values("dropped_at")["pos"].tolist()
    assert order == dropped
    assert report[report["selected"]]["pos"].tolist() == kept and {0, 1} <= set(kept)
    for pos, value in t.items():
        assert abs(report.set_index("pos")["t_value"][pos] - value) < 1e-8
    assert [r["feature"] for r in selected_only(eliminate(df, names)).orderBy("pos").collect()] == [names[i] for i in kept]


def test_student_p_values():
    # table values: t for a two-sided 5% level
    for freedom, t in ((1, 12.706205), (5, 2.570582), (30, 2.042272), (1000, 1.962339)):
        assert abs(student_two_sided(t, freedom) - 0.05) < 1e-6
    assert student_two_sided(0.0, 9) == 1.0 and student_two_sided(-2.570582, 5) == student_two_sided(2.570582, 5)


def test_selection_strategies(spark):
    panel = event_panel(spark, SMALL)
    same = select_features(panel, EVENT_FEATURES).orderBy("pos").collect()
    assert [r["feature"] for r in same] == EVENT_FEATURES
    chosen = select_features(panel, EVENT_FEATURES, FunctionStrategy(lambda p, f: f[::-1][:2]))
    assert [r["feature"] for r in chosen.orderBy("pos").collect()] == ["feature_e", "feature_d"]
    report = AttributionStrategy(EraRange(1, 27), 8, 2).report(panel, EVENT_FEATURES)
    assert report.count() == 5


@pytest.fixture(scope="module")
def data(spark):
    panel = event_panel(spark, SMALL).withColumnRenamed("meta", "x_meta_model").cache()
    return PanelData(panel, EVENT_FEATURES, splits=Splits(EraRange(1, 17), EraRange(18, 26), EraRange(26, 31)))


def test_untrained_models_are_refused(spark, data):
    module = least_squares_module(data)
    with pytest.raises(NotTrained):
        module.predict(data.panel)
    with pytest.raises(NotTrained):
        module.save(spark, scratch_path(spark, "m"))
    with pytest.raises(NotTrained):
        predict_function(None, EVENT_FEATURES)
    trainer = Trainer(RunStore(spark, scratch_path(spark, "runs")), "r", scratch_path(spark, "m"))
    with pytest.raises(ValueError):
        trainer.validate(data)
    with pytest.raises(NotTrained):
        trainer.test(data, module)


def test_training_job(spark, data):
    store = RunStore(spark, scratch_path(spark, "runs"))
    trainer = Trainer(store, "run-a", scratch_path(spark, "model"))

    def mean_prediction(t, p, m):
        return F.avg(p)

    module = least_squares_module(data, ["corr", "payoff", mean_prediction])
    output = train(data, module, trainer, "val/Payoff")
    rows = {(r["split"], r["metric"]): r["value"] for r in output.record.collect()}
    assert set(rows) == {(s, m) for s in ("val", "test") for m in ("corr", "payoff", "mean_prediction")}
    assert output.val_score == rows["val", "payoff"] and output.test_score == rows["test", "payoff"]
    # stored metrics win over any module
    cached = {r["metric"]: r["value"] for r in trainer.validate(data).collect()}
    assert cached["payoff"] == output.val_score
    reloaded = Module.load(spark, trainer.model_dir, ["payoff"])
    assert abs(reloaded.validate(data).first()["value"] - output.val_score) < 1e-9
    other = Trainer(RunStore(spark, scratch_path(spark, "runs")), "run-b", "")
    assert abs(other.validate(data, None, trainer.model_dir).where("metric = 'payoff'").first()["value"] - output.val_score) < 1e-9
    assert store.best_run("val/Payoff").first()["run_id"] == "run-a"
    absent = train(data, least_squares_module(data, ["corr"]), Trainer(store, "run-c", scratch_path(spark, "m")), "mmc")
    assert absent.val_score is None and absent.test_score is None


def test_a_split_can_be_turned_off(spark, data):
    off = PanelData(data.panel, EVENT_FEATURES, splits=data.splits, limits={"test": 0.0, "val": 0.5})
    module = least_squares_module(off, ["corr"]).train(off.train_dataset())
    assert [r["split"] for r in populate_metrics(module, off).collect()] == ["val"]
    assert 0 < off.val_dataset().count() < data.val_dataset().count()
    trainer = Trainer(RunStore(spark, scratch_path(spark, "runs")), "r", "")
    assert trainer.test(off, module).count() == 0


def test_only_training_uses_extra_targets(data):
    extra = PanelData(data.panel.withColumn("target_b", F.col("target")), ["feature_a"], targets=["target", "target_b"])
    assert "target_b" in extra.train_dataset().columns and "target_b" not in extra.val_dataset().columns


def test_boosted_trees_round_trip(spark, data):
    assert TREE_PRESETS["deep"] == {"maxIter": 30000, "stepSize": 0.001, "maxDepth": 10}
    module = Module(boosted_trees(EVENT_FEATURES, maxIter=2), ["corr"]).train(data.train_dataset())
    path = scratch_path(spark, "trees")
    module.save(spark, path)
    a = module.predict(data.val_dataset()).agg(F.sum("prediction")).first()[0]
    b = Module.load(spark, path).predict(data.val_dataset()).agg(F.sum("prediction")).first()[0]
    assert a == b


def test_live_and_user_predictions(spark, data):
    model = LeastSquares(tuple(EVENT_FEATURES)).fit(data.train_dataset())
    predict = predict_function(model, EVENT_FEATURES)
    live = data.panel.where("era = 30")
    got = predict(live, live.select("id"))
    assert got.columns == ["id", "prediction"] and got.count() == live.count()

    class Scorer:
        def predict(self, x):
            return x @ np.array(model.coefficients[0]) + model.intercepts[0]

    a = predict_with(live, Scorer(), EVENT_FEATURES).toPandas().set_index("id").sort_index()
    b = got.toPandas().set_index("id").sort_index()
    assert np.allclose(a["prediction"], b["prediction"])


def test_best_run_rules(spark):
    rows = [("a", "val", "Corr", 0.1), ("b", "val", "corr", float("nan")), ("c", "test", "corr", 9.0), ("d", "val", "corr", 0.1)]
    table = spark.createDataFrame(rows, "run_id string, split string, metric string, value double")
    assert best_run(table, "val/CORR").first()["run_id"] == "a"
    assert best_run(table, "corr", "max").first()["run_id"] == "c"
    assert best_run(table, "val/corr", "min").first()["run_id"] == "a"
    assert best_run(table, "mmc").count() == 0
    assert split_metric("val/Payoff") == ("val", "payoff") and split_metric("corr") == (None, "corr")


def test_flatten_parameters(spark):
    params = {"a": 1, "b": {"c": [1, {"d": None}], "e": [[2, 3]]}}
    assert flatten(params) == {"a": 1, "b.c.0": 1, "b.c.1.d": None, "b.e.0.0": 2, "b.e.0.1": 3}
    store = RunStore(spark, scratch_path(spark, "runs"))
    assert store.params().count() == 0
    store.log_params("r", params)
    assert {(r["key"], r["value"]) for r in store.params("r").collect()} == {
        ("a", "1"), ("b.c.0", "1"), ("b.c.1.d", None), ("b.e.0.0", "2"), ("b.e.0.1", "3")
    }
    docs = spark.createDataFrame(
        [("x", '{"a": 1, "b": {"c": [1, {"d": null}], "e": [[2, 3]]}}'), ("y", '{"a": {"q": "t"}}')], "run string, doc string"
    )
    got = {(r["run_id"], r["key"], r["value"]) for r in flatten_json(docs, "run", "doc").collect()}
    assert got == {
        ("x", "a", "1"), ("x", "b.c.0", "1"), ("x", "b.c.1.d", None), ("x", "b.e.0.0", "2"), ("x", "b.e.0.1", "3"),
        ("y", "a.q", "t"),
    }


def test_prediction_from_thousands_of_features(spark):
    from erascope.operators.linear import LinearModel

    names = [f"x{i}" for i in range(3000)]
    model = LinearModel(tuple(names), ("target",), (tuple(float(i % 7 - 3) for i in range(3000)),), (0.5,))
    df = spark.range(3).select("id", *[(F.col("id") * i % 5).alias(n) for i, n in enumerate(names)])
    got = {r["id"]: r["prediction"] for r in model.transform(df).select("id", "prediction").collect()}
    assert got == {k: 0.5 + sum((i % 7 - 3) * (k * i % 5) for i in range(3000)) for k in range(3)}


def test_elimination_by_downdating_matches_fresh_fits():
    from erascope.operators import selection

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 90))
    y = x[:, :20] @ rng.normal(size=20) + rng.normal(size=400)
    full = np.column_stack([np.ones(400), x, y])
    rows = selection.eliminate_on_products(full.T @ full, [f"f{i}" for i in range(90)], 0.05)
    alive, dropped = list(range(90)), {}
    while True:
        a = x[:, alive]
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        rest = y - a @ beta
        t = beta / np.sqrt(rest @ rest / (400 - len(alive)) * np.diag(np.linalg.inv(a.T @ a)))
        if t.min() >= 0:
            break
        dropped[alive.pop(int(t.argmin()))] = len(dropped) + 1
    assert {r[0]: r[6] for r in rows if r[6]} == dropped and len(dropped) > 30
    kept = {r[0]: r for r in rows if r[6] is None}
    assert all(abs(kept[k][3] - v) < 1e-6 for k, v in zip(alive, t, strict=True))


def test_p_values_of_large_samples():
    from erascope.operators.selection import student_two_sided

    normal = 0.31731050786291415  # two-sided p-value of one standard deviation
    for rows in (1e8, 1e10, 1e12, 1e15):
        assert abs(student_two_sided(1.0, rows) - normal) < 1e-8
    assert student_two_sided(0.0, 10) == 1.0 and abs(student_two_sided(2.228138852, 10) - 0.05) < 1e-8


def test_other_attributions_and_starting_features(spark):
    from erascope.operators.selection import AttributionStrategy
    from erascope.splits import EraRange

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"era": np.repeat(range(1, 21), 20), "a": rng.normal(size=400), "b": rng.normal(size=400), "c": rng.normal(size=400)})
    pdf["target"] = pdf["a"] + 0.1 * rng.normal(size=400)
    seen = []

    def attribute(train, validation, features):
        seen.append(list(features))
        return validation.select("target", *[F.col(f).alias(f"attr_{f}") for f in features])

    strategy = AttributionStrategy(EraRange(1, 21), 5, embargo=2, attribute=attribute, starting_features=["a", "b"])
    assert [r["feature"] for r in strategy.select(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()][:1] == ["a"]
    assert seen == [["a", "b"]]


def test_second_fit_replaces_the_scores_of_the_first(spark, tmp_path):
    from erascope.sources.runs import RunStore

    store = RunStore(spark, str(tmp_path))
    rows = lambda v: spark.createDataFrame([("val", "corr", v)], "split string, metric string, value double")
    store.log_metrics("r", rows(1.0))
    store.log_metrics("r", rows(2.0), new_attempt=True)
    store.log_metrics("r", rows(3.0).withColumn("metric", F.lit("mmc")))
    store.log_metrics("q", rows(4.0))
    got = sorted(tuple(r) for r in store.metrics().collect())
    assert got == [("q", "val", "corr", 4.0), ("r", "val", "corr", 2.0), ("r", "val", "mmc", 3.0)]


def test_gram_tiles_add_up_in_small_groups(spark, monkeypatch):
    """Bands narrower than the list, more partial tiles than one group adds up, and the matrix on the driver."""
    import numpy as np

    from erascope.operators import gram as G

    monkeypatch.setattr(G, "BAND", 3)
    monkeypatch.setattr(G, "FAN_IN", 2)
    names = [f"x{i}" for i in range(8)]
    values = np.random.default_rng(2).normal(size=(500, 8))
    df = spark.createDataFrame(values.tolist(), ", ".join(f"{c} double" for c in names)).repartition(7)
    columns = [G.ONE, *names]
    full = np.hstack([np.ones((500, 1)), values])
    tiles = G.gram_tiles(df, columns, max_tasks=7).collect()
    assert sorted((t["bi"], t["bj"]) for t in tiles) == [(i, j) for i in range(3) for j in range(i, 3)]
    np.testing.assert_allclose(G.gram_matrix(df, columns, "blocks"), full.T @ full, atol=1e-9)
    np.testing.assert_allclose(to_matrix(gram(df, columns, "blocks", max_tasks=5), 9), full.T @ full, atol=1e-9)
    assert not G.gram_matrix(df.limit(0), columns, "blocks").any()


def test_subsample_is_the_same_whatever_the_partitions(spark):
    from erascope.operators.projection import subsample

    df = spark.range(5000).selectExpr("cast(id as string) as id", "cast(id % 7 as int) as era")

    def drawn(rows, fraction):
        return {r["id"] for r in subsample(rows, fraction).collect()}

    assert drawn(df, 0.2) == drawn(df.repartition(9), 0.2) < drawn(df, 0.5)
    assert {r["era"] for r in subsample(df, 0.05).collect()} == set(range(7))
    assert subsample(df.drop("id"), 0.5).count() in (0, *range(5001))


def test_subsample_fraction_and_repeat(spark):
    from erascope.operators.projection import subsample

    df = spark.range(20_000)
    a, b = ({r["id"] for r in subsample(df, 0.3).collect()} for _ in range(2))
    assert a == b and abs(len(a) / 20_000 - 0.3) < 0.02 and subsample(df, 0).count() == 0


def test_text_that_looks_like_json_is_a_leaf(spark):
    import json

    from erascope.sources.runs import flatten, flatten_json

    documents = [
        {"a": "[1,2]", "b": [], "c": {}, "d": {"e": [1, {"f": "x"}], "g": None, "h": '{"k": 1}'}, "i": True},
        {"a": {"deep": [[1, 2], [3]]}, "b": "plain"},
    ]
    frame = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(documents)], "run string, doc string")
    got = {(r["run_id"], r["key"]): r["value"] for r in flatten_json(frame, "run", "doc").collect()}
    text = lambda v: None if v is None else json.dumps(v) if isinstance(v, bool) else str(v)
    assert got == {(str(i), k): text(v) for i, d in enumerate(documents) for k, v in flatten(d).items()}


def test_wide_prediction_is_one_arrow_function(spark):
    """Not an interpreted expression; terms in order, null where a feature is null, NaN where one is NaN."""
    from erascope.operators.linear import PLAIN_TERMS, LinearModel

    for size in (3, PLAIN_TERMS + 1, 70):
        weights = tuple(0.1 * (i + 1) for i in range(size))
        data = [[float(i * k % 7) / 3 for i in range(size)] for k in range(5)]
        data[3][1], data[4][2] = None, float("nan")
        names = [f"x{i}" for i in range(size)]
        rows = spark.createDataFrame([(k, *row) for k, row in enumerate(data)], "k int, " + ", ".join(f"{n} double" for n in names))
        scored = LinearModel(tuple(names), ("target",), (weights,), (0.25,)).transform(rows)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "zip_with" not in plan and ("ArrowEvalPython" in plan) == (size > PLAIN_TERMS)
        got = [r["prediction"] for r in scored.orderBy("k").collect()]
        for k in range(3):
            want = 0.25
            for x, b in zip(data[k], weights):
                want += x * b
            assert got[k] == want
        assert got[3] is None and got[4] != got[4]
