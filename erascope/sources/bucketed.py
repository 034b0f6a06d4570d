"""Raw parts kept in buckets by id, so that joining them again needs no shuffle.

The parts of a side are stacked and written once as a table of the session's catalogue: hashed into a fixed number of
buckets by id, sorted inside them. Sides with equal numbers of buckets join bucket by bucket; however often the panel
is built from them, nothing is exchanged. An id with very many rows makes its bucket large, so such data should stay
with the plain parts, whose joins AQE splits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope import schema as S
from erascope.operators.joins import attach_left, stack_parts
from erascope.session import scratch_path
from erascope.sources.panel import RawParts


@dataclass(frozen=True)
class BucketedParts:
    """Names of the tables of the stacked panel, the stacked benchmark models and the meta model."""

    panel: str
    benchmark: str
    meta: str

    def joined(self, spark: SparkSession) -> DataFrame:
        """J2 -> J3 over the tables; the same rows as ``join_parts`` gives for the parts."""
        panel, benchmark, meta = (spark.table(t) for t in (self.panel, self.benchmark, self.meta))
        return attach_left(attach_left(panel, benchmark, [S.ERA]), meta, [S.ERA, S.DATA_TYPE])


def write_buckets(df: DataFrame, table: str, path: str, buckets: int, key: str = S.ID) -> None:
    """Write ``df`` to ``path`` as a bucketed table; rows without a key lie in the bucket of null."""
    spread = df.repartition(buckets, F.col(key)).sortWithinPartitions(key)
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def bucket_parts(parts: RawParts, buckets: int, path: str | None = None, name: str | None = None) -> BucketedParts:
    """Write the raw parts as three bucketed tables below ``path`` (the shared folder unless given)."""
    spark = parts.meta.sparkSession
    path = path or scratch_path(spark, "buckets")
    name = name or f"erascope_{uuid.uuid4().hex}"
    sides = {"panel": stack_parts(parts.panel), "benchmark": stack_parts(parts.benchmark), "meta": parts.meta}
    for side, df in sides.items():
        write_buckets(df, f"{name}_{side}", f"{path}/{side}", buckets)
    return BucketedParts(*[f"{name}_{side}" for side in sides])
