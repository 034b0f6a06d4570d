"""From raw parts to a checked panel."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession

from erascope import schema as S
from erascope.operators.joins import join_parts
from erascope.operators.projection import (
    default_fill_rules,
    fill_missing,
    live_era,
    normalise_types,
    relabel_live,
)
from erascope.operators.quality import check_report, eras_as_dict, require_clean, special_era_columns
from erascope.session import scratch_path
from erascope.sources.catalogue import ERAS_SCHEMA, copy_feature_sets, read_eras, write_eras
from erascope.sources.files import discard
from erascope.sources.panel import (
    RawParts,
    current_version,
    is_complete,
    new_version,
    publish_version,
    scan_panel,
    scan_raw,
    write_changed_eras,
    write_panel,
)


def build_panel(parts: RawParts) -> DataFrame:
    """J4. Stack, join, relabel the live era and cast. The live era comes from the label columns alone."""
    labels = reduce(lambda a, b: a.unionByName(b), [p.select(S.ERA) for p in parts.panel])
    joined = join_parts(parts.panel, parts.benchmark, parts.meta)
    return normalise_types(relabel_live(joined, live_era(labels)))


def prepare_panel(
    spark: SparkSession, raw_dir: str, data_dir: str, strict: bool = True, overwrite: bool = False
) -> DataFrame:
    """J5. Build, describe, fill, check and write a panel; returns the check report.

    Nothing is done when ``data_dir`` is complete.
    """
    if is_complete(spark, data_dir) and not overwrite:
        return check_report(scan_panel(spark, data_dir), eras_as_dict(read_eras(spark, data_dir)))
    ready = checked_panel(spark, raw_dir, strict)
    write_eras(spark.createDataFrame([ready.eras], ERAS_SCHEMA), data_dir)
    copy_feature_sets(spark, raw_dir, data_dir)
    write_panel(ready.panel, data_dir)
    discard(spark, ready.staging)
    return ready.report


@dataclass(frozen=True)
class CheckedPanel:
    """A panel that reads the folder ``staging``, its era catalogue and its report, which is kept as rows."""

    panel: DataFrame
    eras: dict[str, int]
    report: DataFrame
    staging: str


def checked_panel(spark: SparkSession, raw_dir: str, strict: bool = True) -> CheckedPanel:
    """J5. The joined, filled and checked panel.

    The joins run once, for a staging folder; the era catalogue is observed while it is written. The checks read it
    once and whoever writes the panel once more.
    """
    staging = scratch_path(spark, "staging")
    built = build_panel(scan_raw(spark, raw_dir))
    seen = Observation()
    built.observe(seen, *special_era_columns(built)).write.parquet(staging)
    eras = {"train": S.FIRST_ERA, **seen.get}
    filled = fill_missing(spark.read.parquet(staging), default_fill_rules(eras))
    rules = check_report(filled, eras)
    report = spark.createDataFrame(rules.collect(), rules.schema)
    if strict:
        require_clean(report)
    return CheckedPanel(filled, eras, report, staging)


def rebuild_panel(spark: SparkSession, raw_dir: str, root: str, strict: bool = True) -> str:
    """S8. Prepare a new version below ``root`` and publish it; the previous versions stay readable.

    Only eras whose rows have changed are written; the manifest of the version points to the older folders of the others.
    """
    target, previous = new_version(spark, root), current_version(spark, root)
    ready = checked_panel(spark, raw_dir, strict)
    write_eras(spark.createDataFrame([ready.eras], ERAS_SCHEMA), target)
    copy_feature_sets(spark, raw_dir, target)
    write_changed_eras(ready.panel, target, previous)
    publish_version(spark, target)
    discard(spark, ready.staging)
    return target


def scan_current(spark: SparkSession, root: str) -> DataFrame:
    """Panel of the newest complete version."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no complete version below {root}")
    return scan_panel(spark, version)
