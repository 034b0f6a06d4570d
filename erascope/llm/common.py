"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope.session import scratch_path

# ASCII white space separates words; everything else is part of a word.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage durably."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile hands Python workers at most so many rows at once: texts are long, and a batch is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of ``text`` with A-Z lowered; null is empty. Splitting it cuts at ASCII white space only."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


class Memory:
    """What a worker keeps of words between batches of text; pure speed, results do not depend on it.

    Words that come up in two batches settle, the others go whenever there are more than ``size`` of them.
    """

    def __init__(self, size: int):
        self.size = size
        self.settled: dict = {}
        self.recent: dict = {}

    def known(self, wanted: Iterable) -> tuple[dict, list]:
        """The values of those words that are kept, and the other words."""
        found, missing = {}, []
        if len(self.settled) > self.size:
            self.settled = {}
        for word in wanted:
            value = self.settled.get(word)
            if value is None:
                value = self.recent.pop(word, None)
                if value is None:
                    missing.append(word)
                    continue
                self.settled[word] = value
            found[word] = value
        return found, missing

    def keep(self, fresh: dict) -> None:
        if len(self.recent) + len(fresh) > self.size:
            self.recent = {}
        self.recent.update(fresh)
