"""Era scores kept up to date over a stream.

Ranks cannot be merged, so the rows of an open era are kept. Each micro-batch is written once, which also tells what
eras it touched, and only these are scored again; a late row just touches its era.

Rows lie in folders by split, fate, era and span of micro-batches. Once an era has ``MERGED`` spans of about the same length, all of
batches before the current one, they are written as one span, so an era has few folders however many batches there were.
A merged span counts once it is complete, and whatever lies within a complete one does not, so a failure at any
point leaves one set of rows. With ``closes_after`` an era closes when an era that much later was seen in an earlier batch: its
scores are final, its rows are removed, and rows that still come for it are kept apart as too late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from erascope.functions.ranking import HOT_GROUP_ROWS
from erascope.operators.scores import METRICS, era_scores, score_summary
from erascope.sources.files import child_names, discard, exists

ROWS = "rows"
SCORES = "scores"
LATEST = "latest"
MERGED = 8


class EraScoreStream:
    """Tables ``rows`` (by split, fate, era, span), ``scores`` (by split, era) and ``latest`` (by split, batch) below ``root``.

    Writing replaces whole partitions, so a micro-batch that is run again after a failure changes nothing.
    """

    def __init__(
        self,
        root: str,
        preds: str | Sequence[str] = "prediction",
        target: str = "target",
        meta: str = "meta",
        era: str = "era",
        split: str = "all",
        metrics: Sequence[str] = METRICS,
        strategy: str = "auto",
        hot_rows: int = HOT_GROUP_ROWS,
        closes_after: int | None = None,
    ):
        self.root = root.rstrip("/")
        self.preds = [preds] if isinstance(preds, str) else list(preds)
        self.target, self.meta, self.era, self.split = target, meta, era, split
        self.metrics, self.strategy, self.hot_rows = tuple(metrics), strategy, hot_rows
        self.closes_after = closes_after

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the query; by default it processes what is there and stops."""
        return (
            stream.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Store one micro-batch and score its eras again; those of closed eras are stored as too late."""
        spark = batch.sparkSession
        latest = self._latest_before(spark, batch_id)
        closed_below = None if latest is None or self.closes_after is None else latest - self.closes_after
        if closed_below is not None:
            self._close(spark, closed_below)
        era = F.col(self.era).cast("int")
        rows = batch.where(F.col(self.era).isNotNull()).select(
            F.lit(self.split).alias("split"),
            (F.lit(False) if closed_below is None else era < closed_below).alias("late"),
            era.alias("era"),
            F.lit(_span(batch_id, batch_id)).alias("span"),
            *dict.fromkeys([self.target, self.meta, *self.preds]),
        )
        seen = Observation()
        rows = rows.observe(
            seen, F.collect_set(F.when(~F.col("late"), F.col("era"))).alias("eras"), F.max("era").alias("latest")
        )
        _replace_partitions(rows.hint("rebalance", "era"), f"{self.root}/{ROWS}", ["split", "late", "era", "span"])
        touched, newest = sorted(seen.get["eras"]), seen.get["latest"]
        if newest is None:
            return
        for e in touched:
            self._merge(spark, e, batch_id)
        if touched:
            scores = era_scores(
                self.rows_of(spark, touched),
                self.preds, self.target, self.meta, "era", self.metrics, self.strategy, self.hot_rows,
            ).withColumn("split", F.lit(self.split))
            _replace_partitions(scores, f"{self.root}/{SCORES}", ["split", "era"])
        mark = spark.createDataFrame([(max(newest, newest if latest is None else latest),)], "latest int")
        mark.write.mode("overwrite").parquet(f"{self.root}/{LATEST}/split={self.split}/batch_id={batch_id}")

    def _folder(self, table: str, late: bool = False) -> str:
        fate = f"/late={str(late).lower()}" if table == ROWS else ""
        return f"{self.root}/{table}/split={self.split}{fate}"

    def _latest_before(self, spark: SparkSession, batch_id: int) -> int | None:
        """Latest era seen in the batches before this one, from the mark of the last of them; older marks go."""
        folder = self._folder(LATEST)
        marks = {int(n.split("=")[1]): n for n in child_names(spark, folder) if n.startswith("batch_id=")}
        done = sorted(b for b in marks if b < batch_id and exists(spark, f"{folder}/{marks[b]}/_SUCCESS"))
        for old in done[:-1]:
            discard(spark, f"{folder}/{marks[old]}")
        return spark.read.parquet(f"{folder}/{marks[done[-1]]}").first()[0] if done else None

    def _eras(self, spark: SparkSession, late: bool = False) -> list[int]:
        names = child_names(spark, self._folder(ROWS, late))
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("era="))

    def _close(self, spark: SparkSession, below: int) -> None:
        """Remove the rows of closed eras; an earlier batch closed them, so no batch that is run again needs them."""
        for e in self._eras(spark):
            if e < below:
                discard(spark, f"{self._folder(ROWS)}/era={e}")

    def spans(self, spark: SparkSession, era: int, late: bool = False) -> list[tuple[int, int]]:
        """The spans of batches whose folders count: complete ones that lie in no other."""
        folder = f"{self._folder(ROWS, late)}/era={era}"
        known = [tuple(int(x) for x in n.split("=")[1].split("-")) for n in child_names(spark, folder) if n.startswith("span=")]
        whole = [s for s in known if s[0] == s[1] or exists(spark, f"{folder}/span={_span(*s)}/_SUCCESS")]
        return sorted(s for s in whole if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in whole))

    def _merge(self, spark: SparkSession, era: int, batch_id: int) -> None:
        """Write spans of earlier batches as one where there are many of about the same length."""
        folder = f"{self._folder(ROWS)}/era={era}"
        spans = [s for s in self.spans(spark, era) if s[1] < batch_id]
        while len(spans) >= MERGED:
            some = spans[-MERGED:]
            if _level(some[0]) > _level(some[-1]):
                return
            paths = [f"{folder}/span={_span(*s)}" for s in some]
            whole = (some[0][0], some[-1][1])
            merged = spark.read.parquet(*paths)
            merged.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/span={_span(*whole)}")
            for path in paths:
                discard(spark, path)
            spans = [*spans[:-MERGED], whole]

    def _read(self, spark: SparkSession, eras: Sequence[int], late: bool = False) -> DataFrame | None:
        base = f"{self.root}/{ROWS}"
        paths = [f"{self._folder(ROWS, late)}/era={e}/span={_span(*s)}" for e in eras for s in self.spans(spark, e, late)]
        return spark.read.option("basePath", base).parquet(*paths) if paths else None

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """Rows of the open eras of this split; None without any."""
        return self._read(spark, self._eras(spark))

    def late_rows(self, spark: SparkSession) -> DataFrame | None:
        """Rows that came after their era had closed; None without any."""
        return self._read(spark, self._eras(spark, True), True)

    def rows_of(self, spark: SparkSession, eras: Sequence[int]) -> DataFrame:
        """Stored rows of some open eras; only their folders are listed."""
        return self._read(spark, eras)

    def reset(self, spark: SparkSession) -> None:
        """Forget all rows and scores of this split, as at the start of an epoch; batches may count from zero again."""
        for table in (ROWS, SCORES, LATEST):
            discard(spark, f"{self.root}/{table}/split={self.split}")

    def scores(self, spark: SparkSession) -> DataFrame:
        """Current era scores: ``split, era, n`` and the metrics; no rows after a reset."""
        path = f"{self.root}/{SCORES}"
        if not exists(spark, path):
            raise FileNotFoundError(path)
        schema = ", ".join(["n long", *[f"{m} double" for m in self.metrics], "split string", "era int"])
        return spark.read.schema(schema).parquet(path)

    def summary(self, spark: SparkSession) -> DataFrame:
        """Current mean scores and annual return of this split."""
        return score_summary(self.scores(spark).where(F.col("split") == self.split))


def metric_bundle(spark: SparkSession, streams: Sequence[EraScoreStream]) -> DataFrame:
    """R6. ``(split, metric, value)`` of several streams, e.g. validation and test."""
    result = None
    for s in streams:
        summary = s.summary(spark)
        entries = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in summary.columns]
        part = summary.select(F.lit(s.split).alias("split"), F.inline(F.array(*entries)))
        result = part if result is None else result.unionByName(part)
    return result


def _span(first: int, last: int) -> str:
    return f"{first:012d}-{last:012d}"


def _level(span: tuple[int, int]) -> int:
    """How often spans were merged into this one, judged by its length."""
    level, length = 0, span[1] - span[0] + 1
    while length >= MERGED:
        level, length = level + 1, length // MERGED
    return level


def _replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)
