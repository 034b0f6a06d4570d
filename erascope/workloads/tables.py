"""The test tables shaped into panels. Every column is derived from the given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDE = 600  # columns of the wide model
EVENT_FEATURES = ["feature_a", "feature_b", "feature_c", "feature_d", "feature_e"]
LINE_FEATURES = ["feature_1", "feature_2", "feature_3", "feature_4", "feature_5"]
META_COLUMN = "combined_meta_model"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed panel over ``events``: 30 eras (days), five features with values 0..4."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(i)) for i, t in enumerate(EVENT_TYPES)])
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("era"),
        (((F.col("event_id") * 7 + F.col("user_id")) % 5) / 4.0).cast("float").alias("target"),
        F.col("value").alias("preds_0"),
        ((F.col("event_id") * 37) % 101).cast("double").alias("preds_1"),
        F.col("user_id").cast("double").alias("meta"),
        (F.col("event_id") % 5).cast("tinyint").alias("feature_a"),
        (F.col("user_id") % 5).cast("tinyint").alias("feature_b"),
        F.floor(F.get_json_object("props", "$.k").cast("int") / 20).cast("tinyint").alias("feature_c"),
        code.cast("tinyint").alias("feature_d"),
        F.floor(F.hour("ts") / 5).cast("tinyint").alias("feature_e"),
    )


def line_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel without a key over ``lineitem``: 83 eras (months), five features with values 0..4."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    months = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return li.select(
        (months + 1).alias("era"),
        ((F.floor("l_extendedprice") % 5) / 4.0).cast("float").alias("target"),
        F.col("l_extendedprice").alias("preds_0"),
        F.col("l_quantity").alias("meta"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("tinyint").alias("feature_1"),
        (F.round(F.col("l_discount") * 100) % 5).cast("tinyint").alias("feature_2"),
        (F.round(F.col("l_tax") * 100) % 5).cast("tinyint").alias("feature_3"),
        ((F.col("l_linenumber") - 1) % 5).cast("tinyint").alias("feature_4"),
        (F.col("l_suppkey") % 5).cast("tinyint").alias("feature_5"),
    )


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event panel with the raw layout's labels and targets plus the day number ``d`` (helper column)."""
    t = F.col("target")
    number = F.col("id").cast("long")
    d = F.col("era")
    label = (
        F.when(d <= 15, "train").when(d < 26, "validation").when(d <= 29, "test").otherwise("live")
    )
    return event_panel(spark, sf_dir).select(
        "id",
        F.when(d == 30, F.lit("X")).otherwise(F.lpad(d.cast("string"), 4, "0")).alias("era"),
        label.alias("data_type"),
        *EVENT_FEATURES,
        F.when(d < 26, t).alias("target"),
        F.when(d < 26, t).alias("target_cyrusd_20"),
        F.when(d < 18, t).alias("target_cyrusd_60"),
        F.when((d < 26) & (number % 11 != 0), t).alias("target_jeremy_20"),
        F.when((d < 18) & (number % 13 != 0), t).alias("target_jeremy_60"),
        (F.col("preds_0") / 500).alias("_benchmark"),
        (F.col("meta") / 150).alias("_meta"),
        d.alias("_d"),
    )


def raw_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven raw parts as lazy frames, by file name."""
    rows = raw_panel(spark, sf_dir)
    d = F.col("_d")
    pieces = {"train": d <= 15, "validation": (d > 15) & (d < 30), "live": d == 30}
    parts = {n: rows.where(c).drop("_benchmark", "_meta", "_d") for n, c in pieces.items()}
    for n, c in pieces.items():
        parts[f"{n}_benchmark_models"] = rows.where(c & (d >= 10)).select(
            "id", "era", F.col("_benchmark").alias("v5_lgbm_cyrusd20")
        )
    parts["meta_model"] = rows.where((d >= 18) & (d < 26)).select(
        "id", "era", "data_type", F.col("_meta").alias(META_COLUMN)
    )
    return parts


def write_raw(spark: SparkSession, sf_dir: str, raw_dir: str) -> None:
    """Write the seven raw parts and the feature catalogue."""
    from erascope.sources.catalogue import write_feature_sets

    for name, part in raw_parts(spark, sf_dir).items():
        part.write.mode("overwrite").parquet(f"{raw_dir}/{name}.parquet")
    sets = {"small": EVENT_FEATURES[:3], "medium": EVENT_FEATURES[:4], "all": EVENT_FEATURES}
    write_feature_sets(spark, raw_dir, sets)
