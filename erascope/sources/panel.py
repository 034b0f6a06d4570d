"""Panel and raw-part files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.sources.catalogue import ERAS_FILE, FEATURES_FILE
from erascope.sources.files import all_exist, child_names, exists

# Names of the raw parts.
PANEL_PARTS = ("train", "validation", "live")
BENCHMARK_PARTS = ("train_benchmark_models", "validation_benchmark_models", "live_benchmark_models")
META_PART = "meta_model"
PANEL_FILE = "panel.parquet"
VERSION_PREFIX = "version="
COMPLETE_MARK = "_COMPLETE"
MANIFEST_FILE = "manifest.parquet"
MANIFEST = "era int, n long, digest long, version string"


def scan_panel(spark: SparkSession, data_dir: str) -> DataFrame:
    """S1. Lazy scan; era filters prune partitions, projections prune columns.

    A version with a manifest is read from the folders of its eras, some of which may lie in older versions.
    """
    if not exists(spark, f"{data_dir}/{MANIFEST_FILE}"):
        return spark.read.parquet(f"{data_dir}/{PANEL_FILE}")
    root = data_dir.rsplit("/", 1)[0]
    folders: dict[str, list[str]] = {}
    for row in read_manifest(spark, data_dir):
        base = f"{root}/{row['version']}/{PANEL_FILE}"
        folders.setdefault(base, []).append(f"{base}/{S.ERA}={'__HIVE_DEFAULT_PARTITION__' if row['era'] is None else row['era']}")
    if not folders:
        return spark.read.parquet(f"{data_dir}/{PANEL_FILE}")
    parts = [spark.read.option("basePath", base).parquet(*paths) for base, paths in sorted(folders.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


@dataclass(frozen=True)
class RawParts:
    panel: list[DataFrame]
    benchmark: list[DataFrame]
    meta: DataFrame


def scan_raw(spark: SparkSession, raw_dir: str) -> RawParts:
    """S2. Lazy scans of the seven raw files."""

    def part(name: str) -> DataFrame:
        return spark.read.parquet(f"{raw_dir}/{name}.parquet")

    return RawParts([part(n) for n in PANEL_PARTS], [part(n) for n in BENCHMARK_PARTS], part(META_PART))


def write_panel(panel: DataFrame, data_dir: str) -> None:
    """S3. Parquet partitioned by era.

    REBALANCE lets AQE give a large era several writers and small eras one, so neither a hot era nor a
    flood of small files arises.
    """
    panel.hint("rebalance", S.ERA).write.mode("overwrite").partitionBy(S.ERA).parquet(f"{data_dir}/{PANEL_FILE}")


def read_manifest(spark: SparkSession, data_dir: str) -> list[Row]:
    """``era, n, digest, version``: one row per era, with the version whose folder has it."""
    return spark.read.schema(MANIFEST).parquet(f"{data_dir}/{MANIFEST_FILE}").orderBy("era").collect()


def era_digests(panel: DataFrame) -> DataFrame:
    """``era, n, digest``: rows of each era and a checksum of their values that does not depend on their order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(panel.columns)])
    both = F.xxhash64(F.bit_xor(row), F.sum(row.cast("decimal(20,0)")))
    return panel.groupBy(S.ERA).agg(F.count(F.lit(1)).alias("n"), both.alias("digest"))


def write_changed_eras(panel: DataFrame, data_dir: str, previous: str | None) -> list[int | None]:
    """S3, S8. Write the eras whose rows are not in the ``previous`` version as they are, and a manifest of all.

    Returns the eras written. ``data_dir`` and ``previous`` are folders below the same root.
    """
    spark = panel.sparkSession
    known = {}
    if previous is not None and exists(spark, f"{previous}/{MANIFEST_FILE}"):
        known = {r["era"]: r for r in read_manifest(spark, previous)}
    version = data_dir.rsplit("/", 1)[1]
    rows, changed = [], []
    for r in era_digests(panel).collect():
        old = known.get(r["era"])
        same = old is not None and (old["n"], old["digest"]) == (r["n"], r["digest"])
        rows.append((r["era"], r["n"], r["digest"], old["version"] if same else version))
        if not same:
            changed.append(r["era"])
    wanted = F.col(S.ERA).isin([e for e in changed if e is not None])
    if None in changed:
        wanted = F.coalesce(wanted, F.lit(True))
    write_panel(panel.where(wanted), data_dir)
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{data_dir}/{MANIFEST_FILE}")
    return changed


def is_complete(spark: SparkSession, data_dir: str) -> bool:
    """S7. Panel (fully written), era catalogue and feature catalogue all exist."""
    return all_exist(spark, [f"{data_dir}/{n}" for n in (f"{PANEL_FILE}/_SUCCESS", ERAS_FILE, FEATURES_FILE)])


def new_version(spark: SparkSession, root: str) -> str:
    """S8. Path of the next version below ``root``; older versions stay in place as the archive."""
    taken = _versions(spark, root)
    return f"{root}/{VERSION_PREFIX}{(taken[-1] if taken else 0) + 1:06d}"


def publish_version(spark: SparkSession, version_dir: str) -> None:
    """S8. Mark a version as complete; readers only see complete versions."""
    spark.range(1).select(F.lit("complete").alias("value")).coalesce(1).write.mode("overwrite").text(
        f"{version_dir}/{COMPLETE_MARK}"
    )


def current_version(spark: SparkSession, root: str) -> str | None:
    """Newest complete version, or None."""
    for number in reversed(_versions(spark, root)):
        path = f"{root}/{VERSION_PREFIX}{number:06d}"
        if exists(spark, f"{path}/{COMPLETE_MARK}"):
            return path
    return None


def _versions(spark: SparkSession, root: str) -> list[int]:
    names = [n for n in child_names(spark, root) if n.startswith(VERSION_PREFIX)]
    return sorted(int(n.removeprefix(VERSION_PREFIX)) for n in names)
