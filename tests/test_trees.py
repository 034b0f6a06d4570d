"""Boosted trees by histograms against a plain level-by-level grower over the rows."""

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL

from erascope.operators import trees as T
from erascope.plans.training import Module, PanelData, histogram_trees
from erascope.sources.files import child_names
from erascope.session import shared_dir
from erascope.workloads.tables import EVENT_FEATURES, LINE_FEATURES, event_panel, line_panel


def plain_trees(x, y, trees):
    """Predictions and splits of a grower that looks at all rows for every candidate."""
    base = y.mean()
    p = np.full(len(y), base)
    splits = {}
    for t in range(trees.rounds):
        node = np.zeros(len(y), int)
        for level in range(trees.depth):
            for k in [k for k in np.unique(node) if k >= 2**level - 1]:
                rows = node == k
                g, n = (y - p)[rows].sum(), rows.sum()
                best = None
                for f in trees.sampled(t):
                    for cut in range(trees.levels - 1):
                        left = rows & (x[:, f] <= cut)
                        if not 0 < left.sum() < n or not (rows & (x[:, f] == cut)).any():
                            continue
                        gl, nl = (y - p)[left].sum(), left.sum()
                        gain = round(gl**2 / (nl + 1) + (g - gl) ** 2 / (n - nl + 1) - g**2 / (n + 1), 9)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = (gain, f, cut)
                if best:
                    splits[t, int(k)] = best[1:]
                    node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
        for k in np.unique(node):
            rows = node == k
            p[rows] += trees.rate * (y - p)[rows].sum() / (rows.sum() + 1)
    return p, splits


def compare(spark, panel, features, trees):
    model = trees.fit(panel)
    scored = model.transform(panel).select(*features, "target", "prediction").toPandas()
    x, y = scored[list(features)].to_numpy(), scored["target"].to_numpy(float)
    p, splits = plain_trees(x, y, trees)
    found = {(t, int(k)): (int(tree.feature[k]), int(tree.threshold[k])) for t, tree in enumerate(model.trees) for k in np.flatnonzero(tree.feature >= 0)}
    assert found == splits and len(splits) > 3
    np.testing.assert_allclose(scored["prediction"], p, atol=1e-9)
    return model, scored


@pytest.mark.parametrize("write_every", [1, 3, 50])
def test_trees_match_a_plain_grower(spark, write_every):
    trees = T.HistogramTrees(EVENT_FEATURES, rounds=4, rate=0.3, depth=3, column_fraction=0.6, write_every=write_every)
    compare(spark, event_panel(spark, SMALL), EVENT_FEATURES, trees)


def test_rows_and_tuples_give_the_same_trees(spark, monkeypatch):
    trees = T.HistogramTrees(LINE_FEATURES, rounds=3, rate=0.5, depth=4, column_fraction=1.0, write_every=2)
    panel = line_panel(spark, SMALL)
    by_tuples, _ = compare(spark, panel, LINE_FEATURES, trees)
    monkeypatch.setattr(T, "MAX_TUPLES", 0)
    by_rows = trees.fit(panel.repartition(5))
    for a, b in zip(by_tuples.trees, by_rows.trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.rows.tolist() == b.rows.tolist()
        np.testing.assert_allclose(a.value, b.value, atol=1e-12)


def test_presets_and_columns():
    wide = [f"f{i}" for i in range(40)]
    for preset, (rounds, rate, depth) in {"small": (2000, 0.01, 5), "large": (20000, 0.001, 6), "deep": (30000, 0.001, 10)}.items():
        made = histogram_trees(wide, preset=preset)
        assert (made.rounds, made.rate, made.depth, made.column_fraction) == (rounds, rate, depth, 0.1)
        assert len(made.sampled(0)) == 4 and made.sampled(0) == made.sampled(0) and made.sampled(0) != made.sampled(1)
    assert len(T.HistogramTrees(["a", "b"]).sampled(3)) == 1


def test_module_trains_saves_and_loads(spark, tmp_path):
    data = PanelData(event_panel(spark, SMALL).withColumnRenamed("meta", "x_meta_model"), EVENT_FEATURES)
    module = Module(histogram_trees(EVENT_FEATURES, rounds=3, depth=2, column_fraction=1.0, rate=0.5), ["corr"])
    module.train(event_panel(spark, SMALL))
    rows = event_panel(spark, SMALL)
    before = module.predict(rows).agg({"prediction": "sum"}).first()[0]
    module.save(spark, str(tmp_path))
    again = Module.load(spark, str(tmp_path), ["corr"])
    assert isinstance(again.model, T.TreeModel) and again.model.features == tuple(EVENT_FEATURES)
    assert again.predict(rows).agg({"prediction": "sum"}).first()[0] == pytest.approx(before, abs=1e-12)
    assert data.feature_names == EVENT_FEATURES


def test_odd_rows(spark):
    schema = "a int, b int, target double"
    trees = T.HistogramTrees(["a", "b"], rounds=2, depth=2, column_fraction=1.0)
    empty = trees.fit(spark.createDataFrame([], schema))
    assert np.isnan(empty.base) and empty.trees == ()
    one = trees.fit(spark.createDataFrame([(1, 2, 0.5)], schema))
    assert one.base == 0.5 and [t.feature[0] for t in one.trees] == [-1, -1]
    assert one.transform(spark.createDataFrame([(4, 0, None)], schema)).first()["prediction"] == 0.5
    for bad in [(1, 2, None), (1, 2, float("nan")), (None, 2, 1.0), (5, 2, 1.0)]:
        with pytest.raises(Exception, match="missing value|out of range"):
            trees.fit(spark.createDataFrame([bad, (0, 0, 1.0)], schema))


def test_staging_is_removed(spark):
    before = [n for n in child_names(spark, shared_dir(spark)) if n.startswith("tree-rows")]
    T.HistogramTrees(EVENT_FEATURES, rounds=3, depth=1, column_fraction=1.0, write_every=1).fit(event_panel(spark, SMALL))
    assert [n for n in child_names(spark, shared_dir(spark)) if n.startswith("tree-rows")] == before


def test_apply_of_one_tree():
    tree = T.Tree.empty(2)
    tree.feature[[0, 2]], tree.threshold[[0, 2]] = [1, 0], [2, 0]
    tree.value[[1, 5, 6]] = [1.0, 2.0, 3.0]
    columns = {0: np.array([0, 0, 1]), 1: np.array([2, 3, 4])}
    assert tree.predict(columns, 3).tolist() == [1.0, 2.0, 3.0]
    assert pd.Series(tree.nodes(columns, 3, 1)).tolist() == [1, 2, 2]
