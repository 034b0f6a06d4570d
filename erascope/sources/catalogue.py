"""Feature-set catalogue, era catalogue and selected-feature lists.

A catalogue is a folder of JSON files with the schema ``feature_sets map<string, array<string>>``. Sizes
are those of column lists, not of data. Sets written later override sets of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope.sources.files import child_names, exists

SETS_SCHEMA = "feature_sets map<string, array<string>>"
FEATURES_FILE = "features.json"
EXTRA_FILE = "extra_feature_sets.json"
VERSION_PREFIX = "version-"
ERAS_FILE = "eras.json"
ERAS_SCHEMA = "train int, benchmark int, validation int, metamodel int, test int, live int"


def read_feature_sets(spark: SparkSession, data_dir: str) -> DataFrame:
    """S4. ``(set_name, pos, feature)``; the extra file, if present, overrides sets of the same name."""
    base = _entries(spark, f"{data_dir}/{FEATURES_FILE}", 0)
    extra_path = _newest(spark, f"{data_dir}/{EXTRA_FILE}")
    if extra_path:
        base = base.unionByName(_extra_entries(spark, extra_path, 1))
    return (
        base.groupBy("set_name")
        .agg(F.max_by("features", "priority").alias("features"))
        .select("set_name", F.posexplode("features").alias("pos", "feature"))
    )


def feature_sets(spark: SparkSession, data_dir: str) -> dict[str, list[str]]:
    """The catalogue as a mapping for use as an argument of a projection."""
    rows = read_feature_sets(spark, data_dir).orderBy("set_name", "pos").collect()
    sets: dict[str, list[str]] = {}
    for row in rows:
        sets.setdefault(row["set_name"], []).append(row["feature"])
    return sets


def write_feature_sets(spark: SparkSession, data_dir: str, sets: Mapping[str, Sequence[str]]) -> None:
    """Write the base catalogue."""
    frame = spark.createDataFrame([({k: list(v) for k, v in sets.items()},)], SETS_SCHEMA)
    frame.coalesce(1).write.mode("overwrite").json(f"{data_dir}/{FEATURES_FILE}")


def merge_feature_sets(order: DataFrame, data_dir: str) -> None:
    """S5. Add one set per method to the extra catalogue; the key is the lower-case method name.

    ``order`` has ``(method, pos, feature)``. Sets already stored under other names are kept. The merged sets
    are a new version next to the old ones, which readers see once it is complete, so a failure loses nothing.
    """
    spark = order.sparkSession
    path = f"{data_dir}/{EXTRA_FILE}"
    new = order.groupBy(F.lower("method").alias("set_name")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "feature"))).getField("feature").alias("features")
    )
    merged = {r["set_name"]: r["features"] for r in new.collect()}
    stored = _newest(spark, path)
    if stored:
        for row in _extra_entries(spark, stored, 0).collect():
            merged.setdefault(row["set_name"], row["features"])
    text = F.to_json(F.col("sets"))
    frame = spark.createDataFrame([(merged,)], "sets map<string, array<string>>")
    number = max(_complete(spark, path), default=0) + 1
    frame.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{VERSION_PREFIX}{number:06d}")


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose write has ended."""
    names = child_names(spark, path) if exists(spark, path) else []
    numbers = [int(n.removeprefix(VERSION_PREFIX)) for n in names if n.startswith(VERSION_PREFIX)]
    return sorted(n for n in numbers if exists(spark, f"{path}/{VERSION_PREFIX}{n:06d}/_SUCCESS"))


def _newest(spark: SparkSession, path: str) -> str | None:
    """The newest complete version of the extra sets, or the file itself where it has no versions."""
    numbers = _complete(spark, path)
    if numbers:
        return f"{path}/{VERSION_PREFIX}{numbers[-1]:06d}"
    plain = exists(spark, path) and not any(n.startswith(VERSION_PREFIX) for n in child_names(spark, path))
    return path if plain else None


def write_eras(eras: DataFrame, data_dir: str) -> None:
    """S6. Era catalogue as one JSON row."""
    eras.coalesce(1).write.mode("overwrite").json(f"{data_dir}/{ERAS_FILE}")


def read_eras(spark: SparkSession, data_dir: str) -> DataFrame:
    return spark.read.schema(ERAS_SCHEMA).option("multiLine", True).json(f"{data_dir}/{ERAS_FILE}")


def copy_feature_sets(spark: SparkSession, source_dir: str, data_dir: str) -> None:
    """S6. Copy the raw feature catalogue next to the panel."""
    frame = _read_sets(spark, f"{source_dir}/{FEATURES_FILE}")
    frame.coalesce(1).write.mode("overwrite").json(f"{data_dir}/{FEATURES_FILE}")


def write_selected(selected: DataFrame, path: str) -> None:
    """S9. One feature name per line, in order of ``pos``."""
    ordered = selected.repartition(1).sortWithinPartitions("pos")
    ordered.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """Names written by ``write_selected`` as ``(pos, feature)``; the file is read as one text."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("pos", "feature"))


def _read_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SETS_SCHEMA).option("multiLine", True).json(path)


def _entries(spark: SparkSession, path: str, priority: int) -> DataFrame:
    return _read_sets(spark, path).select(
        F.explode("feature_sets").alias("set_name", "features"), F.lit(priority).alias("priority")
    )


def _extra_entries(spark: SparkSession, path: str, priority: int) -> DataFrame:
    # the extra file is the bare map, without the enclosing key
    text = spark.read.text(path, wholetext=True)
    sets = text.select(F.from_json("value", "map<string, array<string>>").alias("sets"))
    return sets.select(F.explode("sets").alias("set_name", "features"), F.lit(priority).alias("priority"))
