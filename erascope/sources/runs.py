"""Runs, metrics and parameters as append-only Parquet tables."""

from __future__ import annotations

import time
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope.sources.files import exists

METRICS_SCHEMA = "run_id string, split string, metric string, value double, attempt long"
PARAMS_SCHEMA = "run_id string, key string, value string"


class RunStore:
    """Two tables below one folder: ``metrics`` and ``params``. Appends are atomic per write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log_metrics(self, run_id: str, metrics: DataFrame, new_attempt: bool = False) -> None:
        """S10. Append ``(split, metric, value)`` rows of a run; with ``new_attempt`` they replace its earlier rows.

        Nothing is deleted: readers take the rows of the newest attempt of each run.
        """
        rows = metrics.select(F.lit(run_id).alias("run_id"), "split", "metric", "value")
        self.append_metrics(rows, time.time_ns() if new_attempt else None)

    def append_metrics(self, metrics: DataFrame, attempt: int | None = None) -> None:
        """S10. Append ``(run_id, split, metric, value)`` rows of any number of runs, to their newest attempts."""
        rows = metrics.select("run_id", "split", "metric", "value")
        if attempt is None:
            newest = self._attempts().groupBy("run_id").agg(F.max("attempt").alias("attempt"))
            rows = rows.join(newest, "run_id", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0).cast("long")))
        else:
            rows = rows.withColumn("attempt", F.lit(attempt).cast("long"))
        rows.select("run_id", "split", "metric", "value", "attempt").write.mode("append").parquet(f"{self.root}/metrics")

    def log_params(self, run_id: str, params: Mapping[str, Any]) -> None:
        """S11. Append the flattened parameters of one run."""
        rows = [(run_id, k, None if v is None else str(v)) for k, v in flatten(params).items()]
        self.append_params(self.spark.createDataFrame(rows, PARAMS_SCHEMA))

    def append_params(self, params: DataFrame) -> None:
        """S11. Append ``(run_id, key, value)`` rows of any number of runs."""
        params.select("run_id", "key", "value").write.mode("append").parquet(f"{self.root}/params")

    def metrics(self, run_id: str | None = None, split: str | None = None) -> DataFrame:
        """Rows of the newest attempt of each run."""
        table = self._attempts()
        if run_id is not None:
            table = table.where(F.col("run_id") == run_id)
        newest = table.groupBy("run_id").agg(F.max("attempt").alias("attempt"))
        table = table.join(newest, ["run_id", "attempt"], "left_semi").select("run_id", "split", "metric", "value")
        return table if split is None else table.where(F.col("split") == split)

    def _attempts(self) -> DataFrame:
        # rows written before attempts were kept belong to attempt 0
        return self._read("metrics", METRICS_SCHEMA).fillna(0, ["attempt"])

    def params(self, run_id: str | None = None) -> DataFrame:
        table = self._read("params", PARAMS_SCHEMA)
        return table if run_id is None else table.where(F.col("run_id") == run_id)

    def best_run(self, metric: str, mode: str = "max", split: str | None = None) -> DataFrame:
        """L11. Best run by a metric; see ``best_run``."""
        return best_run(self.metrics(), metric, mode, split)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)


def split_metric(name: str) -> tuple[str | None, str]:
    """``val/payoff`` -> ``("val", "payoff")``; a bare name has no split. Lower case."""
    head, _, tail = name.lower().rpartition("/")
    return (head or None, tail)


def best_run(metrics: DataFrame, metric: str, mode: str = "max", split: str | None = None) -> DataFrame:
    """L11. One row ``(run_id, value)``; NaN never wins, names compare in lower case.

    Of equal values the smallest run id wins, whichever the mode.
    """
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    wanted_split, name = split_metric(metric)
    split = split or wanted_split
    rows = metrics.where((F.lower("metric") == name) & ~F.isnan("value") & F.col("value").isNotNull())
    if split is not None:
        rows = rows.where(F.col("split") == split)
    sign = 1.0 if mode == "max" else -1.0
    best_value = F.max(F.col("value") * sign) * sign
    best = rows.groupBy("run_id").agg(best_value.alias("value"))
    # ties: order by the signed value, then by run id downwards
    pick = F.min(F.struct((F.col("value") * -sign).alias("order"), F.col("run_id"), F.col("value"))).alias("b")
    return best.agg(pick).where(F.col("b").isNotNull()).select("b.run_id", "b.value")


def flatten(params: Any, prefix: str = "") -> dict[str, Any]:
    """Nested mappings and lists to dotted keys; list indexes are key parts. One run's parameters."""
    if isinstance(params, Mapping):
        children = [(str(k), v) for k, v in params.items()]
    elif isinstance(params, (list, tuple)):
        children = [(str(i), v) for i, v in enumerate(params)]
    else:
        return {prefix: params}
    flat: dict[str, Any] = {}
    for key, value in children:
        flat.update(flatten(value, f"{prefix}.{key}" if prefix else key))
    return flat


def flatten_json(df: DataFrame, run_id: str, params: str) -> DataFrame:
    """S11 for many runs: ``(run_id, key, value)`` from a column of JSON objects of any nesting.

    Documents are variants, so a text that looks like JSON stays a leaf. Their merged type tells how deep they
    nest; each level opens the containers of the level before, in one pass over the rows. Empty lists and
    objects have no leaves, as in ``flatten``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(run_id).cast("string").alias("run_id"), F.lit(None).cast("string").alias("key"), F.parse_json(params).alias("v"))
    merged = rows.agg(F.schema_of_variant_agg("v").alias("t")).first()["t"] or ""
    for _ in range(merged.count("OBJECT<") + merged.count("ARRAY<")):
        opened = spark.sql(
            "SELECT run_id, r.key, v, e.pos, e.key AS name, e.value AS child FROM {rows} AS r, LATERAL variant_explode_outer(v) AS e",
            rows=rows,
        )
        inside = F.concat_ws(".", "key", F.coalesce("name", F.col("pos").cast("string")))
        rows = opened.select(
            "run_id", F.when(F.col("child").isNull(), F.col("key")).otherwise(inside).alias("key"), F.coalesce("child", "v").alias("v")
        )
    leaves = rows.where(F.col("v").isNotNull() & ~F.to_json("v").isin("{}", "[]"))
    return leaves.select("run_id", F.coalesce("key", F.lit("")).alias("key"), F.variant_get("v", "$", "string").alias("value"))
