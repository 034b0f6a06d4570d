"""The registered queries: each takes (spark, folder of the test tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope.functions.numeric import rounded, with_norm_ppf
from erascope.operators import eras as E
from erascope.operators import projection as P
from erascope.operators import quality as Q
from erascope.operators import scores as M
from erascope.operators.counts import (
    count_pairs,
    count_pairs_with_target,
    count_values,
    count_with_target,
    mirrored,
    pair_counts_of,
    target_counts_of,
)
from erascope.operators.gram import ONE, gram
from erascope.operators.information import cmi_of_pairs, mi_of_pairs, mi_with_target, pair_information
from erascope.operators.joins import attach_left, stack_parts
from erascope.operators.linear import LeastSquares, LinearModel, fit_ols
from erascope.operators.lazy_ordering import lazy_greedy_orders
from erascope.operators.ordering import greedy_order, greedy_order_steps, named_order
from erascope.operators.selection import (
    AttributionStrategy,
    FunctionStrategy,
    InformationStrategy,
    linear_attributions,
    select_features,
    selected_only,
)
from erascope.operators.trees import HistogramTrees
from erascope.plans.feature_ranking import rank_and_store, rank_features
from erascope.plans.prepare import build_panel, prepare_panel, rebuild_panel, scan_current
from erascope.plans.serving import live_predictions, predict_with
from erascope.plans.training import (
    Module,
    PanelData,
    Trainer,
    boosted_trees,
    histogram_trees,
    evaluate_predictions,
    least_squares_module,
    ml_linear,
    populate_metrics,
    train,
    train_output,
)
from erascope.session import scratch_path
from erascope.sources import catalogue as C
from erascope.sources import panel as S
from erascope.sources.bucketed import bucket_parts
from erascope.sources.runs import RunStore, best_run, flatten_json
from erascope.splits import EraRange, Splits, walk_forward
from erascope.streaming.counts import accumulate_pair_counts, accumulated_counts, pair_count_stream
from erascope.streaming.scores import EraScoreStream, metric_bundle
from erascope.workloads.tables import (
    WIDE,
    EVENT_FEATURES,
    LINE_FEATURES,
    META_COLUMN,
    event_panel,
    line_panel,
    raw_panel,
    raw_parts,
    write_raw,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPLITS = Splits(EraRange(1, 17), EraRange(18, 26), EraRange(26, 31))
TARGETS = ["target", "target_cyrusd_20", "target_cyrusd_60", "target_jeremy_20", "target_jeremy_60"]


def code():
    return P.target_code("target")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def totals(df: DataFrame, features: list[str]) -> DataFrame:
    """(pos, feature, total) of a feature list, in one aggregate."""
    sums = df.agg(*[F.sum(c).alias(c) for c in features])
    entries = [
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).alias("total"))
        for i, c in enumerate(features)
    ]
    return sums.select(F.inline(F.array(*entries)))


def era_digest(df: DataFrame) -> DataFrame:
    return df.groupBy("era").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("preds_0"), 4).alias("total"))


def raw_dir(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "raw")
    write_raw(spark, sf_dir, path)
    return path


def lazy_parts(spark: SparkSession, sf_dir: str) -> S.RawParts:
    parts = raw_parts(spark, sf_dir)
    return S.RawParts(
        [parts[n] for n in S.PANEL_PARTS], [parts[n] for n in S.BENCHMARK_PARTS], parts[S.META_PART]
    )


def panel_digest(df: DataFrame) -> DataFrame:
    cells = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in EVENT_FEATURES]]
    names = [(c, c) for c in TARGETS] + [("benchmark", "v5_lgbm_cyrusd20"), ("meta", META_COLUMN)]
    for name, column in names:
        total = F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0))
        cells += [F.count(column).alias(f"n_{name}"), rounded(total, 4).alias(f"s_{name}")]
    return df.groupBy("era", "data_type").agg(*cells)


# ---- sources and sinks


@query
def s1_panel_scan(spark, sf_dir):
    path = scratch_path(spark, "panel")
    S.write_panel(event_panel(spark, sf_dir).select("id", "era", "target", *EVENT_FEATURES), path)
    return S.scan_panel(spark, path)


@query
def s2_raw_scan(spark, sf_dir):
    raw = S.scan_raw(spark, raw_dir(spark, sf_dir))
    named = dict(zip([*S.PANEL_PARTS, *S.BENCHMARK_PARTS], [*raw.panel, *raw.benchmark]))
    named[S.META_PART] = raw.meta
    return union([df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n, df in named.items()])


@query
def s3_panel_sink(spark, sf_dir):
    path = scratch_path(spark, "panel")
    S.write_panel(event_panel(spark, sf_dir).select("id", "era", "target", *EVENT_FEATURES), path)
    return S.scan_panel(spark, path).groupBy("era").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("target").cast("double"))).alias("total")
    )


@query
def s4_feature_sets(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    path = scratch_path(spark, "sets")
    C.write_feature_sets(spark, path, {"all": EVENT_FEATURES, "small": EVENT_FEATURES[:3], "medium": ["feature_d"]})
    override = spark.createDataFrame(
        [("Medium", 0, "feature_e"), ("Medium", 1, "feature_b")], "method string, pos int, feature string"
    )
    C.merge_feature_sets(override, path)
    members = C.read_feature_sets(spark, path)
    return members.join(totals(panel, EVENT_FEATURES).drop("pos"), "feature").select(
        "set_name", "pos", "feature", "total"
    )


@query
def s5_ranked_sets(spark, sf_dir):
    path = scratch_path(spark, "sets")
    C.write_feature_sets(spark, path, {"small": EVENT_FEATURES})
    rank_and_store(event_panel(spark, sf_dir), path, features=EVENT_FEATURES, era_1=16)
    return C.read_feature_sets(spark, path).where(F.col("set_name") != "small")


@query
def s6_era_catalogue(spark, sf_dir):
    path = scratch_path(spark, "eras")
    C.write_eras(Q.special_eras(build_panel(lazy_parts(spark, sf_dir))), path)
    return C.read_eras(spark, path)


@query
def s7_completeness(spark, sf_dir):
    path = scratch_path(spark, "data")
    before = S.is_complete(spark, path)
    prepare_panel(spark, raw_dir(spark, sf_dir), path)
    after = S.is_complete(spark, path)
    rows = S.scan_panel(spark, path).agg(F.count(F.lit(1)).alias("n"))
    return union(
        [
            rows.select(F.lit(stage).alias("stage"), F.lit(state).alias("complete"), n.alias("n"))
            for stage, state, n in (("before", before, F.lit(0).cast("long")), ("after", after, F.col("n")))
        ]
    )


@query
def s8_versions(spark, sf_dir):
    raw, root = raw_dir(spark, sf_dir), scratch_path(spark, "versions")
    made = [rebuild_panel(spark, raw, root) for _ in range(2)]
    current = S.current_version(spark, root)
    counts = [
        S.scan_panel(spark, path).agg(
            F.lit(i).alias("version"), F.lit(path == current).alias("is_current"), F.count(F.lit(1)).alias("n")
        )
        for i, path in enumerate(made, start=1)
    ]
    assert scan_current(spark, root).columns
    return union(counts)


@query
def s9_selected_sink(spark, sf_dir):
    path = scratch_path(spark, "selected")
    C.write_selected(t1_first_n_features(spark, sf_dir), path)
    return C.read_selected(spark, path)


@query
def s10_metrics_sink(spark, sf_dir):
    store = RunStore(spark, scratch_path(spark, "runs"))
    panel = event_panel(spark, sf_dir)
    for split, eras in (("val", SPLITS.validation), ("test", SPLITS.test)):
        metrics = evaluate_predictions(panel.where(eras.contains()), split, preds="preds_0")
        store.log_metrics("value", metrics)
    return store.metrics().withColumn("value", rounded("value"))


@query
def s11_run_parameters(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    args = F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"))
    clock = F.array(
        F.hour("ts").cast("string"),
        F.to_json(F.struct(F.minute("ts").alias("minute"))),
    )
    # nested objects and lists, one document per run
    model = F.to_json(F.struct(F.col("event_type").alias("name"), args.alias("args")))
    document = F.concat(
        F.lit('{"model":'), model, F.lit(',"clock":['), clock[0], F.lit(","), clock[1], F.lit("]}")
    )
    flat = flatten_json(ev.select("event_id", document.alias("params")), "event_id", "params")
    store = RunStore(spark, scratch_path(spark, "runs"))
    store.append_params(flat)
    return store.params()


# ---- projections and filters


@query
def p1_era_range(spark, sf_dir):
    return era_digest(P.era_range(event_panel(spark, sf_dir), 5, 12))


@query
def p2_before_era(spark, sf_dir):
    return era_digest(P.before_era(event_panel(spark, sf_dir), 16))


@query
def p3_default_range(spark, sf_dir):
    return era_digest(P.era_range(event_panel(spark, sf_dir), None, 20))


@query
def p4_feature_resolver(spark, sf_dir):
    names = P.resolve_features("all", {"all": EVENT_FEATURES}, first_n=3)
    return totals(event_panel(spark, sf_dir), names)


@query
def p5_target_resolver(spark, sf_dir):
    rows = raw_panel(spark, sf_dir)
    asks = {"none": None, "two": ["target_cyrusd_60", "target_jeremy_20"]}
    return union(
        [
            rows.agg(
                F.lit(ask).alias("asked"), F.lit(t).alias("target"), F.count(t).alias("n"),
                rounded(F.sum(F.col(t).cast("double")), 4).alias("total"),
            )
            for ask, wanted in asks.items()
            for t in P.resolve_targets(wanted)
        ]
    )


@query
def p6_prefix_suffix(spark, sf_dir):
    from erascope.schema import select_names

    rows = raw_panel(spark, sf_dir)
    names = select_names(rows, "target", "20")
    counts = rows.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names]))
    )


@query
def p7_panel_projection(spark, sf_dir):
    panel = event_panel(spark, sf_dir).withColumnRenamed("meta", META_COLUMN)
    return P.project_panel(panel, 3, 9, EVENT_FEATURES)


@query
def p8_feature_dtype(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    return union(
        [
            panel.select(
                "id", F.lit(kind).alias("dtype"),
                F.col("feature_a").cast(P.feature_type(kind)).cast("double").alias("a"),
                F.col("feature_c").cast(P.feature_type(kind)).cast("double").alias("c"),
            )
            for kind in ("Int8", "Float32")
        ]
    )


@query
def p9_type_normalisation(spark, sf_dir):
    rows = raw_panel(spark, sf_dir)
    texts = rows.select(
        "id", F.col("_d").cast("string").alias("era"), "data_type",
        *[F.col(c).cast("string").alias(c) for c in EVENT_FEATURES],
        F.col("target").cast("double").alias("target"),
        F.when(F.col("_d") >= 10, F.col("_benchmark")).alias("v5_lgbm_cyrusd20"),
    )
    typed = P.normalise_types(texts)
    zero = F.lit(0.0)
    return typed.groupBy("era", "data_type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in EVENT_FEATURES],
        rounded(F.coalesce(F.sum(F.col("target").cast("double")), zero), 4).alias("target"),
        rounded(F.coalesce(F.sum(F.col("v5_lgbm_cyrusd20").cast("double")), zero), 4).alias("benchmark"),
    )


@query
def p10_live_relabel(spark, sf_dir):
    rows = raw_panel(spark, sf_dir).select("id", "era", "data_type")
    return P.relabel_live(rows, P.live_era(rows)).groupBy("era", "data_type").agg(F.count(F.lit(1)).alias("n"))


@query
def p11_conditional_fill(spark, sf_dir):
    rows = raw_panel(spark, sf_dir).withColumn("era", F.col("_d"))
    filled = P.fill_missing(rows, P.default_fill_rules({"test": 26}))
    cells = []
    for c in TARGETS[3:]:
        total = F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
        cells += [F.count(c).alias(f"n_{c}"), rounded(total, 4).alias(f"s_{c}")]
    return filled.groupBy("era").agg(*cells)


@query
def p12_target_code(spark, sf_dir):
    return event_panel(spark, sf_dir).groupBy(code().alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query
def p13_split_assignment(spark, sf_dir):
    label = F.coalesce(SPLITS.label(), F.lit("none")).alias("split")
    # eras are counted on the per-era table, not with a distinct aggregate over the rows
    per_era = event_panel(spark, sf_dir).groupBy("era").agg(F.count(F.lit(1)).alias("n"))
    return per_era.groupBy(label).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("eras"))


@query
def p14_walk_forward(spark, sf_dir):
    early, late = walk_forward(EraRange(1, 27), 8, 2)
    parts = P.split_rows(event_panel(spark, sf_dir), {"train": early, "validation": late})
    return union(
        [
            df.agg(F.lit(s).alias("split"), F.min("era").alias("first"), F.max("era").alias("last"),
                   F.count(F.lit(1)).alias("n"))
            for s, df in parts.items()
        ]
    )


@query
def p15_subsample(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    return union(
        [
            P.subsample(panel, fraction).agg(
                F.lit(str(fraction)).alias("fraction"), F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids")
            )
            for fraction in (None, 0.0, 0.05, 0.25)
        ]
    )


# ---- joins


@query
def j1_vertical_concat(spark, sf_dir):
    parts = lazy_parts(spark, sf_dir)
    return stack_parts(parts.panel).groupBy("data_type", "era").agg(F.count(F.lit(1)).alias("n"))


@query
def j2_benchmark_join(spark, sf_dir):
    parts = lazy_parts(spark, sf_dir)
    joined = attach_left(stack_parts(parts.panel), stack_parts(parts.benchmark), ["era"])
    return joined.select(
        "id", "era", "data_type", F.col("v5_lgbm_cyrusd20").cast("float").alias("benchmark")
    )


@query
def j3_meta_join(spark, sf_dir):
    parts = lazy_parts(spark, sf_dir)
    joined = attach_left(stack_parts(parts.panel), parts.meta, ["era", "data_type"])
    return joined.select("id", "era", "data_type", F.col(META_COLUMN).cast("float").alias(META_COLUMN))


@query
def j2_bucketed_joins(spark, sf_dir):
    """Both joins over parts that are kept in buckets by id."""
    joined = bucket_parts(lazy_parts(spark, sf_dir), buckets=8).joined(spark)
    return joined.select(
        "id", "era", "data_type", F.col("v5_lgbm_cyrusd20").cast("float").alias("benchmark"), F.col(META_COLUMN).cast("float").alias(META_COLUMN)
    )


@query
def j4_panel_build(spark, sf_dir):
    return panel_digest(build_panel(lazy_parts(spark, sf_dir)))


@query
def j5_prepare(spark, sf_dir):
    path = scratch_path(spark, "data")
    prepare_panel(spark, raw_dir(spark, sf_dir), path)
    return panel_digest(S.scan_panel(spark, path))


# ---- aggregates and checks


@query
def a1_special_eras(spark, sf_dir):
    return Q.special_eras(build_panel(lazy_parts(spark, sf_dir)))


def dirty_panel(spark, sf_dir):
    number = F.col("id").cast("long")
    preds = (
        F.when(number % 7 == 0, F.lit(float("nan"))).when(number % 7 == 1, F.lit(None)).otherwise(F.col("preds_0"))
    )
    panel = event_panel(spark, sf_dir)
    return panel.withColumns({"preds_0": preds, "feature_c": F.when(number % 50 != 0, F.col("feature_c"))})


@query
def a2_nan_check(spark, sf_dir):
    panel = dirty_panel(spark, sf_dir)
    return Q.count_violations(panel, Q.nan_rules(panel))


@query
def a3_null_check(spark, sf_dir):
    panel = dirty_panel(spark, sf_dir)
    return Q.count_violations(panel, Q.null_rules(panel))


@query
def a4_presence_windows(spark, sf_dir):
    panel = build_panel(lazy_parts(spark, sf_dir))
    return Q.count_violations(panel, Q.window_rules(panel, Q.eras_as_dict(Q.special_eras(panel))))


@query
def a5_check_report(spark, sf_dir):
    panel = build_panel(lazy_parts(spark, sf_dir))
    eras = Q.eras_as_dict(Q.special_eras(panel))
    return Q.check_report(P.fill_missing(panel, P.default_fill_rules(eras)), eras)


@query
def a6_row_count(spark, sf_dir):
    return Q.row_count(P.era_range(event_panel(spark, sf_dir), 1, 2))


@query
def a7_value_counts(spark, sf_dir):
    return count_values(line_panel(spark, sf_dir), LINE_FEATURES)


@query
def a8_target_counts(spark, sf_dir):
    return count_with_target(line_panel(spark, sf_dir), LINE_FEATURES, code())


@query
def a9_pair_counts(spark, sf_dir):
    return mirrored(count_pairs(line_panel(spark, sf_dir), LINE_FEATURES))


@query
def a10_pair_target_counts(spark, sf_dir):
    return mirrored(count_pairs_with_target(line_panel(spark, sf_dir), LINE_FEATURES, code()))


@query
def a10_pair_target_counts_tiled(spark, sf_dir):
    counts = count_pairs_with_target(line_panel(spark, sf_dir), LINE_FEATURES, code(), method="tiles", tile=3)
    return mirrored(counts)


@query
def a11_marginal_target(spark, sf_dir):
    return target_counts_of(count_pairs_with_target(line_panel(spark, sf_dir), LINE_FEATURES, code()))


@query
def a12_marginal_pairs(spark, sf_dir):
    return mirrored(pair_counts_of(count_pairs_with_target(line_panel(spark, sf_dir), LINE_FEATURES, code())))


@query
def a13_gram(spark, sf_dir):
    products = gram(line_panel(spark, sf_dir), [ONE, *LINE_FEATURES, "target"])
    return products.withColumn("value", rounded("value"))


@query
def a13_gram_blocks(spark, sf_dir):
    products = gram(line_panel(spark, sf_dir), [ONE, *LINE_FEATURES, "target"], method="blocks")
    return products.withColumn("value", rounded("value"))


@query
def a14_mean_of_eras(spark, sf_dir):
    scores = M.era_scores(event_panel(spark, sf_dir), "preds_0")
    return scores.agg(rounded(M.mean_score("corr")).alias("corr"), rounded(M.mean_score("payoff")).alias("payoff"))


@query
def a15_annualized_return(spark, sf_dir):
    scores = M.era_scores(event_panel(spark, sf_dir), "preds_0")
    return scores.agg(rounded(M.annualized_return("payoff"), 4).alias("annual_return"))


# ---- per-era transforms


def hot_limit(df: DataFrame) -> int:
    """A group limit below the largest era, so that the split into small and hot eras takes place."""
    sizes = df.groupBy("era").agg(F.count(F.lit(1)).alias("n"))
    return int(sizes.agg(F.percentile_approx("n", 0.6)).first()[0])


@query
def w1_average_rank(spark, sf_dir):
    return E.average_rank(event_panel(spark, sf_dir), {"rank_0": "preds_0", "rank_m": "meta"}).select(
        "id", "era", "rank_0", "rank_m"
    )


@query
def w1_average_rank_hot(spark, sf_dir):
    panel = event_panel(spark, sf_dir).select("id", "era", "preds_0", "meta")
    ranked = E.average_rank(panel, {"rank_0": "preds_0", "rank_m": "meta"}, hot_rows=hot_limit(panel))
    return ranked.select("id", "era", "rank_0", "rank_m")


@query
def w2_center(spark, sf_dir):
    return E.center(event_panel(spark, sf_dir), {"centred": "target"}).select(
        "id", "era", rounded("centred").alias("centred")
    )


@query
def w3_gaussianize(spark, sf_dir):
    return E.gaussianize(event_panel(spark, sf_dir), {"g": "preds_0", "gm": "meta"}).select(
        "id", "era", rounded("g").alias("g"), rounded("gm").alias("gm")
    )


@query
def w4_normal_quantile(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    top = ev.agg(F.max("event_id")).first()[0]
    rows = ev.select(F.col("event_id").cast("string").alias("id"), ((F.col("event_id") + 0.5) / (top + 1.0)).alias("p"))
    return with_norm_ppf(rows, {"q": F.col("p")}).select("id", rounded("q").alias("q"))


@query
def w5_signed_power(spark, sf_dir):
    rows = event_panel(spark, sf_dir).withColumn("x", F.col("preds_0") - 50.0)
    return E.exponentiate(rows, {"y": "x"}).select("id", "era", rounded("y").alias("y"))


@query
def w6_orthogonal_projection(spark, sf_dir):
    rows = E.orthogonal_projection(event_panel(spark, sf_dir), "meta", "preds_0", "rest")
    return rows.select("id", "era", rounded("rest").alias("rest"))


@query
def w7_standardize(spark, sf_dir):
    rows = E.gaussianize(event_panel(spark, sf_dir), {"g": "preds_0"})
    return E.standardize(rows, {"z": "g"}).select("id", "era", rounded("z").alias("z"))


@query
def w8_ensemble(spark, sf_dir):
    rows = E.ensemble(event_panel(spark, sf_dir), ["preds_0", "preds_1"])
    return rows.select("id", "era", rounded("ensemble").alias("ensemble"))


def summary(scores: DataFrame) -> DataFrame:
    means = M.score_summary(scores)
    return means.select(
        *[rounded(c).alias(c) for c in M.METRICS], rounded("annual_return", 4).alias("annual_return")
    )


@query
def w8_ensemble_scores(spark, sf_dir):
    return summary(M.era_scores(event_panel(spark, sf_dir), ["preds_0", "preds_1"]))


@query
def w9_global_scores(spark, sf_dir):
    one = M.global_scores(line_panel(spark, sf_dir), "preds_0")
    return one.select("n", *[rounded(c).alias(c) for c in M.METRICS])


@query
def w9_global_gaussianize(spark, sf_dir):
    rows = E.gaussianize(event_panel(spark, sf_dir).select("id", "preds_0"), {"g": "preds_0"}, by=())
    return rows.select("id", rounded("g").alias("g"))


# ---- scores


def one_metric(spark, sf_dir, metric: str) -> DataFrame:
    scores = M.era_scores(event_panel(spark, sf_dir), "preds_0", metrics=[metric])
    return scores.select("era", rounded(metric).alias(metric))


@query
def m1_corr_by_era(spark, sf_dir):
    return one_metric(spark, sf_dir, "corr")


@query
def m2_mmc_by_era(spark, sf_dir):
    return one_metric(spark, sf_dir, "mmc")


@query
def m3_payoff_by_era(spark, sf_dir):
    return one_metric(spark, sf_dir, "payoff")


def score_table(scores: DataFrame) -> DataFrame:
    return scores.select("era", "n", *[rounded(c).alias(c) for c in M.METRICS])


@query
def m4_era_scores(spark, sf_dir):
    return score_table(M.era_scores(line_panel(spark, sf_dir), "preds_0"))


@query
def m4_era_scores_hot(spark, sf_dir):
    lines = line_panel(spark, sf_dir)
    return score_table(M.era_scores(lines, "preds_0", hot_rows=hot_limit(lines)))


@query
def m4_era_scores_prefix(spark, sf_dir):
    return score_table(M.era_scores(event_panel(spark, sf_dir), "preds_0", strategy="prefix"))


@query
def m5_corr(spark, sf_dir):
    return M.corr(event_panel(spark, sf_dir), "preds_0").select(rounded("corr").alias("corr"))


@query
def m6_mmc(spark, sf_dir):
    return M.mmc(event_panel(spark, sf_dir), "preds_0").select(rounded("mmc").alias("mmc"))


@query
def m7_payoff(spark, sf_dir):
    return M.payoff(event_panel(spark, sf_dir), "preds_0").select(rounded("payoff").alias("payoff"))


@query
def m8_annual_return(spark, sf_dir):
    one = M.annual_return(line_panel(spark, sf_dir), "preds_0")
    return one.select(rounded("annual_return", 4).alias("annual_return"))


@query
def m9_corr_vector(spark, sf_dir):
    rows = M.corr_vector(event_panel(spark, sf_dir))
    return rows.select("id", "era", rounded("corr_vector", 9).alias("corr_vector"))


@query
def m10_mmc_vector(spark, sf_dir):
    rows = M.mmc_vector(event_panel(spark, sf_dir))
    return rows.select("id", "era", rounded("mmc_vector", 9).alias("mmc_vector"))


@query
def m11_payoff_vector(spark, sf_dir):
    rows = M.payoff_vector(event_panel(spark, sf_dir))
    return rows.select("id", "era", rounded("payoff_vector").alias("payoff_vector"))


# ---- information and feature orders


def event_pairs(spark, sf_dir) -> DataFrame:
    return count_pairs_with_target(event_panel(spark, sf_dir), EVENT_FEATURES, code())


def line_pairs(spark, sf_dir) -> DataFrame:
    return count_pairs_with_target(line_panel(spark, sf_dir), LINE_FEATURES, code())


@query
def f1_mi_with_target(spark, sf_dir):
    mi = mi_with_target(count_with_target(event_panel(spark, sf_dir), EVENT_FEATURES, code()))
    return mi.select("f", rounded("mi", 9).alias("mi"))


@query
def f2_mi_of_pairs(spark, sf_dir):
    mi = mi_of_pairs(mirrored(count_pairs(line_panel(spark, sf_dir), LINE_FEATURES)))
    return mi.select("f1", "f2", rounded("mi", 9).alias("mi"))


@query
def f3_cmi_of_pairs(spark, sf_dir):
    cmi = cmi_of_pairs(mirrored(line_pairs(spark, sf_dir)))
    return cmi.select("f1", "f2", rounded("cmi", 9).alias("cmi"))


def one_order(spark, sf_dir, method: str) -> DataFrame:
    order = greedy_order(pair_information(event_pairs(spark, sf_dir)), [method])
    return order.select("pos", "f", rounded("objective", 9).alias("objective"))


@query
def f4_order_cife(spark, sf_dir):
    return one_order(spark, sf_dir, "CIFE")


@query
def f5_order_jmi(spark, sf_dir):
    return one_order(spark, sf_dir, "JMI")


@query
def f6_order_cmim(spark, sf_dir):
    return one_order(spark, sf_dir, "CMIM")


@query
def f7_order_jmim(spark, sf_dir):
    return one_order(spark, sf_dir, "JMIM")


@query
def f8_order_dmim(spark, sf_dir):
    return one_order(spark, sf_dir, "DMIM")


@query
def f9_greedy_orders(spark, sf_dir):
    order = greedy_order(pair_information(event_pairs(spark, sf_dir)))
    return order.select("method", "pos", "f")


@query
def f9_greedy_steps(spark, sf_dir):
    pairs = pair_information(event_pairs(spark, sf_dir)).checkpoint()
    return greedy_order_steps(pairs, "DMIM", top_k=len(EVENT_FEATURES)).select("method", "pos", "f")


@query
def f9_lazy_orders(spark, sf_dir):
    """The orders of the criteria with running maxima, without a pair table."""
    orders = lazy_greedy_orders(event_panel(spark, sf_dir), EVENT_FEATURES, code(), ("CMIM", "JMIM", "DMIM"), first=3)
    return orders.select("method", "pos", "f")


@query
def f10_feature_ranking(spark, sf_dir):
    return rank_features(event_panel(spark, sf_dir), EVENT_FEATURES, era_1=16)


@query
def f11_selection_hook(spark, sf_dir):
    strategy = InformationStrategy("JMI", first_n=3, era_1=31)
    chosen = select_features(event_panel(spark, sf_dir), EVENT_FEATURES, strategy)
    return chosen.select(F.lit("jmi").alias("strategy"), "pos", "feature")


@query
def f12_linear_attributions(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    model = fit_ols(panel.where(SPLITS.train.contains()), EVENT_FEATURES)
    rows = linear_attributions(panel.where(SPLITS.validation.contains()), model, ["id"])
    return rows.select("id", *[rounded(c).alias(c) for c in rows.columns if c != "id"])


@query
def f13_t_value_elimination(spark, sf_dir):
    return AttributionStrategy(EraRange(1, 27), 8, 2).report(event_panel(spark, sf_dir), EVENT_FEATURES)


@query
def f13_normal_equations(spark, sf_dir):
    """Coefficients and t-values of the elimination, step by step."""
    report = AttributionStrategy(EraRange(1, 27), 8, 2).report(event_panel(spark, sf_dir), EVENT_FEATURES)
    return report.select("pos", "feature", rounded("coefficient").alias("coefficient"), rounded("t_value").alias("t_value"), "dropped_at")


# ---- models


def model_data(spark, sf_dir) -> PanelData:
    panel = event_panel(spark, sf_dir).withColumnRenamed("meta", META_COLUMN)
    return PanelData(panel, EVENT_FEATURES, splits=SPLITS)


def model_table(spark, model: LinearModel) -> DataFrame:
    return model.table(spark).withColumn("value", rounded("value"))


def trained_model(spark, sf_dir) -> LinearModel:
    return fit_ols(event_panel(spark, sf_dir).where(SPLITS.train.contains()), EVENT_FEATURES)


class RoundedPredictions:
    """Estimator wrapper: predictions rounded to 12 decimals, so that equal ones tie in every engine."""

    def __init__(self, estimator):
        self.estimator = estimator

    def fit(self, df: DataFrame) -> LinearModel:
        return RoundedLinearModel(self.estimator.fit(df))


class RoundedLinearModel(LinearModel):
    def __init__(self, model: LinearModel):
        super().__init__(model.features, model.targets, model.coefficients, model.intercepts)

    def transform(self, df: DataFrame, features=None) -> DataFrame:
        return super().transform(df, features).withColumn("prediction", F.round("prediction", 12))


def rounded_module() -> Module:
    return Module(RoundedPredictions(LeastSquares(tuple(EVENT_FEATURES))))


def metric_table(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("value", rounded("value"))


@query
def l1_ols_fit(spark, sf_dir):
    return model_table(spark, fit_ols(line_panel(spark, sf_dir), LINE_FEATURES, ["target", "meta"]))


@query
def l1_ols_fit_blocks(spark, sf_dir):
    return model_table(spark, fit_ols(line_panel(spark, sf_dir), LINE_FEATURES, method="blocks"))


@query
def l2_ols_predict(spark, sf_dir):
    scored = trained_model(spark, sf_dir).transform(event_panel(spark, sf_dir))
    return scored.select("id", rounded("prediction").alias("prediction"))


@query
def l3_linear_preset(spark, sf_dir):
    fitted = ml_linear(LINE_FEATURES).fit(line_panel(spark, sf_dir)).stages[-1]
    model = LinearModel(
        tuple(LINE_FEATURES), ("target",), (tuple(float(b) for b in fitted.coefficients),), (fitted.intercept,)
    )
    return model_table(spark, model)


@query
def l4_boosted_trees(spark, sf_dir):
    data = model_data(spark, sf_dir)
    module = Module(boosted_trees(EVENT_FEATURES, preset="quick"))
    return module.train(data.train_dataset()).validate(data)


def event_trees() -> HistogramTrees:
    """A preset with few rounds and two columns a tree; residuals are written anew within the run."""
    return histogram_trees(EVENT_FEATURES, preset="small", rounds=4, depth=3, rate=0.3, column_fraction=0.4, write_every=2)


@query
def l4_tree_table(spark, sf_dir):
    model = event_trees().fit(event_panel(spark, sf_dir).where(SPLITS.train.contains()))
    return model.table(spark).withColumn("value", rounded("value")).withColumn("gain", rounded("gain"))


@query
def l4_tree_scores(spark, sf_dir):
    """Squared errors and predictions of the trees per era, in all eras."""
    panel = event_panel(spark, sf_dir)
    scored = event_trees().fit(panel.where(SPLITS.train.contains())).transform(panel)
    error = F.col("target").cast("double") - F.col("prediction")
    return scored.groupBy("era").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("prediction")).alias("prediction"), rounded(F.avg(error * error)).alias("error")
    )


@query
def l4_tree_presets(spark, sf_dir):
    """The first rounds of each preset with its own rate and depth: leaves, their values and rows per tree."""
    panel = line_panel(spark, sf_dir).where("era < 40")
    parts = []
    for preset in ("small", "large", "deep"):
        trees = histogram_trees(LINE_FEATURES, preset=preset, rounds=3, column_fraction=0.6)
        model = trees.fit(panel)
        parts.append(model.table(spark).where("tree >= 0 AND feature IS NULL").groupBy(F.lit(preset).alias("preset"), "tree").agg(
            F.sum("rows").alias("rows"), rounded(F.sum("value"), 9).alias("value"), F.count(F.lit(1)).alias("leaves")
        ))
    return union(parts)


def wide_panel(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Panel of many columns made from ids and a feature."""
    panel = event_panel(spark, sf_dir).withColumn("n", F.col("id").cast("long"))
    names = [f"x{i}" for i in range(WIDE)]
    return panel.select("id", *[((F.col("n") * (i + 1) + F.col("feature_b")) % 7).alias(x) for i, x in enumerate(names)]), names


@query
def a13_gram_wide(spark, sf_dir):
    """Per column its sum of squares and the sum of its products with all columns, from the tiles."""
    wide, names = wide_panel(spark, sf_dir)
    products = gram(wide, names)
    both = products.select("i", "j", "value").unionByName(products.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy("i").agg(F.sum("value").alias("products"), F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("squares"))


@query
def l2_ols_predict_wide(spark, sf_dir):
    """A model of many columns made from ids and features; the coefficients are those of the SQL."""
    wide, names = wide_panel(spark, sf_dir)
    model = LinearModel(tuple(names), ("target",), (tuple((i % 11 - 5) / 8 for i in range(WIDE)),), (0.25,))
    return model.transform(wide).select("id", rounded("prediction").alias("prediction"))


@query
def l8_refit_run(spark, sf_dir):
    """A run that is fitted twice has the scores of its second fit only."""
    data = model_data(spark, sf_dir)
    store = RunStore(spark, scratch_path(spark, "runs"))
    trainer = Trainer(store, "run", scratch_path(spark, "model"))
    trainer.fit(Module(LeastSquares(tuple(EVENT_FEATURES[:1])), ["corr"]), data)
    trainer.fit(least_squares_module(data), data)
    return metric_table(store.metrics("run").select("split", "metric", "value"))


@query
def l5_fit_step(spark, sf_dir):
    data = model_data(spark, sf_dir)
    module = least_squares_module(data)
    return model_table(spark, module.train(data.train_dataset()).model)


@query
def l6_guarded_predict(spark, sf_dir):
    data = model_data(spark, sf_dir)
    module = least_squares_module(data).train(data.train_dataset())
    return module.predict(data.val_dataset()).select("id", rounded("prediction").alias("prediction"))


@query
def l7_evaluate_split(spark, sf_dir):
    data = model_data(spark, sf_dir)
    return metric_table(rounded_module().train(data.train_dataset()).validate(data))


def run_training(spark, sf_dir):
    data = model_data(spark, sf_dir)
    store = RunStore(spark, scratch_path(spark, "runs"))
    trainer = Trainer(store, "run-1", scratch_path(spark, "model"))
    return data, trainer


@query
def l8_cached_evaluation(spark, sf_dir):
    data, trainer = run_training(spark, sf_dir)
    trainer.fit(rounded_module(), data)
    # no module is passed: both answers come from the stored metrics of the run
    return metric_table(trainer.validate(data).unionByName(trainer.test(data)))


@query
def l9_model_reload(spark, sf_dir):
    data = model_data(spark, sf_dir)
    path = scratch_path(spark, "model")
    least_squares_module(data).train(data.train_dataset()).save(spark, path)
    reloaded = Module.load(spark, path)
    return reloaded.predict(data.test_dataset()).select("id", rounded("prediction").alias("prediction"))


@query
def l10_populate_metrics(spark, sf_dir):
    data = model_data(spark, sf_dir)
    return metric_table(populate_metrics(rounded_module().train(data.train_dataset()), data))


@query
def l11_best_run(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    store = RunStore(spark, scratch_path(spark, "runs"))
    for column in ("preds_0", "preds_1", "meta"):
        store.log_metrics(column, evaluate_predictions(panel, "val", preds=column, metrics=["corr"]))
    return union(
        [
            best_run(store.metrics(), "val/Corr", mode).select(
                F.lit(mode).alias("mode"), "run_id", rounded("value").alias("value")
            )
            for mode in ("max", "min")
        ]
    )


@query
def l12_train_job(spark, sf_dir):
    data, trainer = run_training(spark, sf_dir)
    output = train(data, rounded_module(), trainer, "val/Payoff")
    return metric_table(output.record)


@query
def l13_result_record(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    metrics = union(
        [
            evaluate_predictions(panel.where(eras.contains()), split, preds="preds_0")
            for split, eras in (("val", SPLITS.validation), ("test", SPLITS.test))
        ]
    )
    return metric_table(train_output(metrics, "val/Corr"))


@query
def l14_live_predictions(spark, sf_dir):
    panel = build_panel(lazy_parts(spark, sf_dir))
    scored = live_predictions(panel, trained_model(spark, sf_dir), EVENT_FEATURES)
    return scored.select("id", rounded("prediction").alias("prediction"))


@query
def l15_splits(spark, sf_dir):
    data = model_data(spark, sf_dir)
    parts = {"train": data.train_dataset(), "val": data.val_dataset(), "test": data.test_dataset()}
    return union(
        [
            df.agg(F.lit(s).alias("split"), F.count(F.lit(1)).alias("n"),
                   rounded(F.sum(F.col("target").cast("double")), 4).alias("target"))
            for s, df in parts.items()
        ]
    )


# ---- sort, limit, top-k


def relevance(spark, sf_dir) -> DataFrame:
    return mi_with_target(count_with_target(event_panel(spark, sf_dir), EVENT_FEATURES, code()))


def feature_name(f):
    return F.element_at(F.array(*[F.lit(c) for c in EVENT_FEATURES]), f + 1)


@query
def t1_first_n_features(spark, sf_dir):
    # one row per feature: the whole list is sorted, then cut
    ranked = relevance(spark, sf_dir).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("mi")).alias("order"), "f"))).alias("all")
    )
    listed = ranked.select(F.posexplode("all").alias("pos", "entry")).select(
        "pos", feature_name(F.col("entry.f")).alias("feature")
    )
    return listed.orderBy("pos").limit(3)


@query
def t2_argmax(spark, sf_dir):
    best = F.max_by(F.struct("f", "mi"), F.struct("mi", -F.col("f"))).alias("best")
    return relevance(spark, sf_dir).agg(best).select("best.f", rounded("best.mi", 9).alias("mi"))


@query
def t3_order_to_list(spark, sf_dir):
    order = greedy_order(pair_information(event_pairs(spark, sf_dir)))
    named = named_order(order, EVENT_FEATURES)
    listed = F.array_sort(F.collect_list(F.struct("pos", "feature"))).getField("feature")
    return named.groupBy("method").agg(F.array_join(listed, ",").alias("features"))


@query
def t4_selected_filter(spark, sf_dir):
    values = relevance(spark, sf_dir)
    marked = values.agg(F.collect_list(F.struct("f", "mi")).alias("all"), F.avg("mi").alias("mean")).select(
        F.inline("all"), "mean"
    )
    report = marked.select(
        F.col("f").alias("pos"), feature_name(F.col("f")).alias("feature"), (F.col("mi") > F.col("mean")).alias("selected")
    )
    return selected_only(report)


# ---- streams


def event_stream(spark, sf_dir, files: int = 4) -> DataFrame:
    """The event panel written to several files and read back one file per micro-batch."""
    panel = event_panel(spark, sf_dir)
    path = scratch_path(spark, "stream")
    panel.repartition(files, "id").write.parquet(path)
    return spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def r1_streaming_counts(spark, sf_dir):
    counts = pair_count_stream(event_stream(spark, sf_dir), EVENT_FEATURES, code())
    path = scratch_path(spark, "counts")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream = (
        counts.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return spark.read.parquet(path)


@query
def r1_accumulated_counts(spark, sf_dir):
    path = scratch_path(spark, "counts")
    accumulate_pair_counts(
        event_stream(spark, sf_dir), EVENT_FEATURES, code(), path, scratch_path(spark, "checkpoint")
    ).awaitTermination()
    return accumulated_counts(spark, path)


def streamed_scores(spark, sf_dir, metrics=M.METRICS, eras: EraRange | None = None, split="all") -> EraScoreStream:
    scores = EraScoreStream(scratch_path(spark, "scores"), "preds_0", split=split, metrics=metrics)
    stream = event_stream(spark, sf_dir, files=2)
    stream = stream.where(eras.contains()) if eras else stream
    scores.start(stream, scratch_path(spark, "checkpoint")).awaitTermination()
    return scores


@query
def r2_streaming_corr(spark, sf_dir):
    return streamed_scores(spark, sf_dir, ["corr"]).scores(spark).select("era", rounded("corr").alias("corr"))


@query
def r2_closing_eras(spark, sf_dir):
    """Three batches of which the later ones hold rows of eras that are open, and of eras that have closed by then."""
    panel = event_panel(spark, sf_dir)
    odd = F.col("id").cast("long") % 2 == 1
    stream = EraScoreStream(scratch_path(spark, "scores"), "preds_0", metrics=["corr"], closes_after=3)
    stream.update(panel.where((F.col("era") <= 10) & ~odd), 0)
    stream.update(panel.where(F.col("era").between(8, 20) & odd), 1)
    stream.update(panel.where((F.col("era") > 10) & ~odd), 2)
    return stream.scores(spark).select("era", "n", rounded("corr").alias("corr"))


@query
def r3_streaming_mmc(spark, sf_dir):
    return streamed_scores(spark, sf_dir, ["mmc"]).scores(spark).select("era", rounded("mmc").alias("mmc"))


@query
def r4_streaming_payoff(spark, sf_dir):
    scores = streamed_scores(spark, sf_dir, ["payoff"]).scores(spark)
    return scores.select("era", rounded("payoff").alias("payoff"))


@query
def r5_streaming_annual_return(spark, sf_dir):
    one = streamed_scores(spark, sf_dir, ["payoff"]).summary(spark)
    return one.select(rounded("annual_return", 4).alias("annual_return"))


@query
def r6_metric_bundle(spark, sf_dir):
    streams = [
        streamed_scores(spark, sf_dir, eras=eras, split=split)
        for split, eras in (("val", SPLITS.validation), ("test", SPLITS.test))
    ]
    return metric_table(metric_bundle(spark, streams))


# ---- user functions


def pearson(t, p, m):
    return F.try_divide(F.covar_pop(t, p), F.stddev_pop(t) * F.stddev_pop(p))


@query
def u1_user_score(spark, sf_dir):
    per_era = M.erawise(event_panel(spark, sf_dir), pearson, "preds_0")
    return per_era.select("era", rounded("pearson").alias("pearson"))


@query
def u1_user_score_meta(spark, sf_dir):
    def shared(t, p, m):
        return F.avg(m * p) + F.avg(t)

    per_era = M.erawise(event_panel(spark, sf_dir), shared, "preds_0")
    return per_era.select("era", rounded("shared").alias("shared"))


@query
def u1_user_score_meta_arrays(spark, sf_dir):
    def shared(t, p, m):
        return (m * p).mean() + t.mean()

    per_era = M.erawise_pandas(event_panel(spark, sf_dir), shared, "preds_0")
    return per_era.select("era", rounded("shared").alias("shared"))


@query
def u1_user_score_compounded(spark, sf_dir):
    score = M.UserScore(pearson, M.annualized_return)
    return score.value(event_panel(spark, sf_dir), "preds_0").select(F.round(F.log1p("value"), 6).alias("log_return"))


@query
def u1_user_score_arrays(spark, sf_dir):
    def pearson_arrays(t, p, m):
        return ((t - t.mean()) * (p - p.mean())).mean() / (t.std() * p.std())

    per_era = M.erawise_pandas(event_panel(spark, sf_dir), pearson_arrays, "preds_0", name="pearson")
    return per_era.select("era", rounded("pearson").alias("pearson"))


def pearson_in_parts() -> M.MergeableScore:
    """Pearson correlation of target and predictions from sums of batches, means and products centred as in a variance merge."""

    def add(state, t, p, m):
        n, st, sp = len(t), t.mean(), p.mean()
        return merge(state, (n, st, sp, ((t - st) ** 2).sum(), ((p - sp) ** 2).sum(), ((t - st) * (p - sp)).sum()))

    def merge(a, b):
        n = a[0] + b[0]
        if not a[0] or not b[0]:
            return a if a[0] else b
        dt, dp, both = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
        return (
            n, a[1] + dt * b[0] / n, a[2] + dp * b[0] / n, a[3] + b[3] + dt * dt * both, a[4] + b[4] + dp * dp * both, a[5] + b[5] + dt * dp * both,
        )

    def finish(state):
        return state[5] / (state[3] * state[4]) ** 0.5

    return M.MergeableScore(lambda: (0, 0.0, 0.0, 0.0, 0.0, 0.0), add, merge, finish, "pearson")


@query
def u1_user_score_mergeable(spark, sf_dir):
    per_era = M.erawise_mergeable(event_panel(spark, sf_dir), pearson_in_parts(), "preds_0")
    return per_era.select("era", rounded("pearson").alias("pearson"))


@query
def u2_user_model(spark, sf_dir):
    class WeightedSum:
        """A user model: anything with ``predict(matrix)``."""

        def predict(self, x):
            return (x * range(1, x.shape[1] + 1)).sum(axis=1)

    return predict_with(event_panel(spark, sf_dir), WeightedSum(), EVENT_FEATURES)


@query
def u3_user_strategy(spark, sf_dir):
    def positive_covariance(panel: DataFrame, features) -> list[str]:
        row = panel.agg(*[F.covar_pop(c, "target").alias(c) for c in features]).first()
        return sorted((c for c in features if row[c] > 0), key=lambda c: -row[c])

    strategy = FunctionStrategy(positive_covariance)
    return select_features(event_panel(spark, sf_dir), EVENT_FEATURES, strategy)
