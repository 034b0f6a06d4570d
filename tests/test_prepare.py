import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.errors import PanelCheckFailed, SchemaMismatch
from erascope.operators import projection as P
from erascope.operators import quality as Q
from erascope.operators.joins import attach_left, stack_parts
from erascope.plans.prepare import build_panel, prepare_panel, rebuild_panel, scan_current
from erascope.session import scratch_path, shared_dir
from erascope.sources import catalogue as C
from erascope.sources import panel as IO
from erascope.sources.files import child_names
from erascope.splits import EraRange, Splits, resolve_range, walk_forward
from erascope.workloads.queries import lazy_parts
from erascope.workloads.tables import EVENT_FEATURES, event_panel, write_raw

ERAS = {"train": 1, "benchmark": 10, "validation": 16, "metamodel": 18, "test": 26, "live": 30}


@pytest.mark.parametrize(
    "sf, rows, present, gaps",
    [(SMALL, (520, 335, 105, 40), (692, 254), (78, 47)), (MEDIUM, (4985, 3354, 1332, 329), (7023, 2690), (759, 435))],
)
def test_build_against_known_counts(spark, sf, rows, present, gaps):
    panel = build_panel(lazy_parts(spark, sf)).cache()
    counts = {r["data_type"]: r["count"] for r in panel.groupBy("data_type").count().collect()}
    assert tuple(counts[t] for t in S.DATA_TYPES) == rows
    columns = S.PanelColumns.of(panel)
    got = panel.agg(F.count(columns.benchmarks[0]), F.count(columns.meta)).first()
    assert tuple(got) == present
    assert Q.eras_as_dict(Q.special_eras(panel)) == ERAS
    broken = {(r["rule"], r["column"]): r["violations"] for r in Q.check_report(panel, ERAS).where("violations > 0").collect()}
    assert broken == {
        ("present_inside", "target_jeremy_20"): gaps[0], ("present_inside", "target_jeremy_60"): gaps[1]
    }
    filled = P.fill_missing(panel, P.default_fill_rules(ERAS))
    assert Q.check_report(filled, ERAS).where("violations > 0").count() == 0
    with pytest.raises(PanelCheckFailed, match="target_jeremy_20"):
        Q.require_clean(Q.check_report(panel, ERAS))
    panel.unpersist()


def test_prepare_writes_once_and_versions(spark):
    raw, root = scratch_path(spark, "raw"), scratch_path(spark, "versions")
    write_raw(spark, SMALL, raw)
    first = rebuild_panel(spark, raw, root)
    assert IO.is_complete(spark, first)
    assert prepare_panel(spark, raw, first).where("violations > 0").count() == 0  # complete: nothing is rebuilt
    second = rebuild_panel(spark, raw, root)
    assert first != second and IO.current_version(spark, root) == second
    unpublished = IO.new_version(spark, root)
    prepare_panel(spark, raw, unpublished)
    assert IO.current_version(spark, root) == second
    panel = scan_current(spark, root)
    assert panel.count() == 1000 and dict(panel.dtypes)["feature_a"] == "tinyint" and dict(panel.dtypes)["era"] == "int"
    assert Q.eras_as_dict(C.read_eras(spark, second)) == ERAS
    assert C.feature_sets(spark, second)["all"] == EVENT_FEATURES
    plan = panel.where(EraRange(3, 5).contains()).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(era" in plan and "ReadSchema: struct<id:string>" in plan


def test_rebuild_writes_changed_eras_only(spark):
    raw, root = scratch_path(spark, "raw"), scratch_path(spark, "versions")
    write_raw(spark, SMALL, raw)
    first = rebuild_panel(spark, raw, root)
    before = sorted(map(tuple, scan_current(spark, root).select(*sorted(scan_current(spark, root).columns)).collect()), key=repr)
    # one row of one era changes in the raw part
    train = spark.read.parquet(f"{raw}/train.parquet")
    one = train.where("era = '0007'").agg(F.min("id")).first()[0]
    changed = train.withColumn("feature_a", F.when(F.col("id") == one, F.lit(4) - F.col("feature_a")).otherwise(F.col("feature_a")).cast("tinyint"))
    other = scratch_path(spark, "raw")
    write_raw(spark, SMALL, other)
    changed.write.mode("overwrite").parquet(f"{other}/train.parquet")
    second = rebuild_panel(spark, other, root)
    assert [n for n in child_names(spark, f"{second}/{IO.PANEL_FILE}") if n.startswith("era=")] == ["era=7"]
    assert IO.scan_panel(spark, second).count() == 1000
    assert IO.scan_panel(spark, second).where(F.col("id") == one).first()["feature_a"] == 4 - IO.scan_panel(spark, first).where(F.col("id") == one).first()["feature_a"]
    old = IO.scan_panel(spark, first)
    assert sorted(map(tuple, old.select(*sorted(old.columns)).collect()), key=repr) == before
    third = rebuild_panel(spark, other, root)
    assert not [n for n in child_names(spark, f"{third}/{IO.PANEL_FILE}") if n.startswith("era=")]
    assert IO.scan_panel(spark, third).exceptAll(IO.scan_panel(spark, second)).isEmpty()


def test_report_is_kept_and_staging_removed(spark):
    raw, data = scratch_path(spark, "raw"), scratch_path(spark, "panel")
    write_raw(spark, SMALL, raw)
    staged = [n for n in child_names(spark, shared_dir(spark)) if n.startswith("staging")]
    report = prepare_panel(spark, raw, data)
    assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString() and report.count() > 10
    assert [n for n in child_names(spark, shared_dir(spark)) if n.startswith("staging")] == staged
    assert Q.eras_as_dict(C.read_eras(spark, data)) == ERAS


def test_scan_current_without_a_version(spark):
    with pytest.raises(FileNotFoundError):
        scan_current(spark, scratch_path(spark, "none"))


def test_stacking_is_strict(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(1, "x")], "n bigint, s string")
    with pytest.raises(SchemaMismatch, match="n"):
        stack_parts([a, b])
    with pytest.raises(SchemaMismatch, match="s"):
        stack_parts([a, a.drop("s")])
    assert stack_parts([a, a.select("s", "n")]).count() == 2


def test_bucketed_parts_join_without_an_exchange(spark):
    from erascope.operators.joins import join_parts
    from erascope.sources.bucketed import bucket_parts

    parts = lazy_parts(spark, SMALL)
    tables = bucket_parts(parts, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tables.joined(spark)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        want = join_parts(parts.panel, parts.benchmark, parts.meta).select(*joined.columns)
        assert joined.exceptAll(want).isEmpty() and joined.count() == want.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_left_join_rules(spark):
    left = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "id string, era int")
    right = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2), (None, 1, 0.3)], "id string, era int, v double")
    got = attach_left(left, right, ["era"]).collect()
    assert sorted((r["id"] or "-", r["v"] or 0.0) for r in got) == [("-", 0.0), ("a", 0.1), ("a", 0.2), ("b", 0.0)]


def test_bad_values_fail(spark):
    bad = spark.createDataFrame([("a", "12x")], "id string, era string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        P.normalise_types(bad).collect()
    with pytest.raises(Exception, match="unknown data_type"):
        P.normalise_types(spark.createDataFrame([("a", "other")], "id string, data_type string")).collect()


def test_live_label_uses_numbers_not_text(spark):
    labels = spark.createDataFrame([("9",), ("10",), ("X",)], "era string")
    assert P.live_era(labels) == 11
    assert sorted(r["era"] for r in P.relabel_live(labels, 11).collect()) == [9, 10, 11]


def test_fill_touches_nulls_only(spark):
    df = spark.createDataFrame(
        [(1, None), (1, float("nan")), (5, None)], "era int, target_jeremy_20 float"
    )
    got = P.fill_missing(df, [P.FillRule("target_jeremy_20", 5)]).collect()
    values = [r["target_jeremy_20"] for r in got]
    assert values[0] == 0.5 and values[1] != values[1] and values[2] is None


def test_ranges_and_splits(spark):
    assert resolve_range(None, 9) == EraRange(1, 2) and resolve_range(3, None) == EraRange(1, 2)
    assert walk_forward(EraRange(1, 1125), 20) == (EraRange(1, 1097), EraRange(1105, 1125))
    default = Splits()
    assert (default.train.stop, default.validation, default.test) == (1125, EraRange(1133, 1176), EraRange(1133, 1176))
    df = spark.createDataFrame([(1,), (1128,), (1140,), (None,)], "era int")
    assert [r[0] for r in df.select(default.labels()).collect()] == [["train"], [], ["validation", "test"], []]


def test_resolvers():
    sets = {"small": ["a", "b", "c"], "big": ["d"]}
    assert P.resolve_features(None, sets) == ["a", "b", "c"]
    assert P.resolve_features("big", sets) == ["d"]
    assert P.resolve_features(iter(["x", "y"]), None, 1) == ["x"]
    with pytest.raises(KeyError):
        P.resolve_features("none", sets)
    assert P.resolve_targets([]) == ["target"] and P.resolve_targets(("u", "v")) == ["u", "v"]
    with pytest.raises(KeyError):
        P.feature_type("Int64")


def test_projection_reads_only_what_it_needs(spark):
    path = scratch_path(spark, "panel")
    event_panel(spark, SMALL).withColumnRenamed("meta", "x_meta_model").write.parquet(path)
    rows = P.project_panel(spark.read.parquet(path), 3, 5, ["feature_a"], features_dtype="Float32")
    assert [f"{n}:{t}" for n, t in rows.dtypes] == [
        "id:string", "era:int", "feature_a:float", "target:float", "x_meta_model:float"
    ]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(era), GreaterThanOrEqual(era,3), LessThan(era,5)]" in plan
    assert "ReadSchema: struct<id:string,era:int,target:float,x_meta_model:double,feature_a:tinyint>" in plan


def test_extra_sets_override(spark):
    path = scratch_path(spark, "sets")
    C.write_feature_sets(spark, path, {"small": ["a"], "other": ["z"]})
    order = spark.createDataFrame([("SMALL", 1, "c"), ("SMALL", 0, "b")], "method string, pos int, feature string")
    C.merge_feature_sets(order, path)
    C.merge_feature_sets(order.select(F.lit("JMI").alias("method"), "pos", "feature"), path)
    assert C.feature_sets(spark, path) == {"small": ["b", "c"], "other": ["z"], "jmi": ["b", "c"]}


def test_shared_dir_follows_the_session(spark):
    folder = shared_dir(spark)
    assert scratch_path(spark, "x").startswith(folder) and shared_dir(spark).split("/")[-1] != ""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or configured.rstrip("/") == folder
    assert spark.sparkContext.getCheckpointDir() is not None
