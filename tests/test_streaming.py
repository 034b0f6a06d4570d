import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from erascope.operators.counts import count_pairs_with_target
from erascope.operators.projection import target_code
from erascope.operators.scores import era_scores, score_summary
from erascope.session import scratch_path
from erascope.streaming.counts import accumulate_pair_counts, accumulated_counts
from erascope.streaming.scores import EraScoreStream, metric_bundle
from erascope.workloads.queries import event_stream
from erascope.workloads.tables import EVENT_FEATURES, event_panel


def close(a, b):
    return np.allclose(np.array([list(a)], dtype=float), np.array([list(b)], dtype=float), atol=1e-9, rtol=1e-9)


def test_counts_do_not_depend_on_batches(spark):
    code = target_code("target")
    batch = count_pairs_with_target(event_panel(spark, SMALL), EVENT_FEATURES, code)
    path, checkpoint = scratch_path(spark, "c"), scratch_path(spark, "k")
    accumulate_pair_counts(event_stream(spark, SMALL, 3), EVENT_FEATURES, code, path, checkpoint).awaitTermination()
    total = accumulated_counts(spark, path)
    assert total.exceptAll(batch.select(total.columns)).isEmpty() and total.count() == batch.count()


def test_scores_follow_the_stream(spark):
    panel = event_panel(spark, SMALL)
    stream = EraScoreStream(scratch_path(spark, "s"), "preds_0", split="val")
    stream.start(event_stream(spark, SMALL, 2), scratch_path(spark, "k")).awaitTermination()
    want = score_summary(era_scores(panel, "preds_0")).first()
    assert close(stream.summary(spark).first(), want)
    assert metric_bundle(spark, [stream]).count() == 4
    # late rows of one era: only that era changes
    before = {r["era"]: r["corr"] for r in stream.scores(spark).collect()}
    late = panel.where("era = 3").withColumn("preds_0", F.col("preds_0") * -1)
    stream.update(late, 1000)
    after = {r["era"]: r["corr"] for r in stream.scores(spark).collect()}
    assert {e for e in after if after[e] != before[e]} == {3}
    # the same batch again changes nothing
    stream.update(late, 1000)
    again = {r["era"]: r["corr"] for r in stream.scores(spark).collect()}
    assert abs(again[3] - after[3]) < 1e-12
    both = era_scores(panel.unionByName(late).where("era = 3"), "preds_0").first()
    assert abs(again[3] - both["corr"]) < 1e-9
    stream.update(panel.limit(0), 1001)
    assert stream.scores(spark).count() == 30


def test_many_batches_leave_few_folders(spark, monkeypatch):
    from erascope.streaming import scores as module

    monkeypatch.setattr(module, "MERGED", 3)
    panel = event_panel(spark, SMALL).where("era <= 2").cache()
    stream = EraScoreStream(scratch_path(spark, "s"), "preds_0", metrics=["corr"])
    parts = 20
    number = F.pmod(F.xxhash64("id"), F.lit(parts))
    for b in range(parts):
        stream.update(panel.where(number == b), b)
        assert all(len(stream.spans(spark, e)) <= 9 for e in (1, 2))
    want = {r["era"]: r["corr"] for r in era_scores(panel, "preds_0", metrics=["corr"]).collect()}

    def matches():
        got = {r["era"]: r["corr"] for r in stream.scores(spark).collect()}
        return got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)

    assert matches() and stream.rows(spark).count() == panel.count()
    stream.update(panel.where(number == parts - 1), parts - 1)  # the last batch again
    assert matches() and stream.rows(spark).count() == panel.count()
    # a merge that was cut off before its parts were removed, and one that never finished
    folder = f"{stream.root}/rows/split=all/late=false/era=1"
    first, last = stream.spans(spark, 1)[0], stream.spans(spark, 1)[-1]
    spark.read.parquet(f"{folder}/span={module._span(*first)}").limit(1).write.parquet(f"{folder}/span={module._span(first[0], first[0])}")
    spark.read.parquet(f"{folder}/span={module._span(*last)}").limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{folder}/span={module._span(0, 900)}"
    )
    assert stream.rows(spark).count() == panel.count()
    stream.reset(spark)
    assert stream.scores(spark).count() == 0 and stream.rows(spark) is None and stream.scores(spark).columns == ["n", "corr", "split", "era"]
    stream.update(panel, 0)
    assert matches()


def test_eras_close(spark):
    panel = event_panel(spark, SMALL).cache()
    stream = EraScoreStream(scratch_path(spark, "s"), "preds_0", metrics=["corr"], closes_after=3)

    def even(rows, rest):
        return rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == rest)

    stream.update(even(panel.where("era <= 4"), 0), 0)
    stream.update(even(panel.where("era BETWEEN 3 AND 6"), 1), 1)  # late for 3 and 4, but not too late
    for _ in range(2):  # the second time as after a failure
        stream.update(panel.where("era BETWEEN 7 AND 9").unionByName(even(panel.where("era = 2"), 1)), 2)  # 2 closed: 6 was seen
    stream.update(even(panel.where("era IN (3, 4, 5)"), 0), 3)  # closed by 9
    admitted = even(panel.where("era <= 4"), 0).unionByName(even(panel.where("era BETWEEN 3 AND 6"), 1)).unionByName(panel.where("era BETWEEN 7 AND 9"))
    want = {r["era"]: r["corr"] for r in era_scores(admitted, "preds_0", metrics=["corr"]).collect()}
    got = {r["era"]: r["corr"] for r in stream.scores(spark).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 or got[e] != got[e] for e in want)
    assert {r["era"] for r in stream.rows(spark).select("era").distinct().collect()} == {6, 7, 8, 9}
    assert {r["era"] for r in stream.late_rows(spark).select("era").distinct().collect()} == {2, 3, 4, 5}
    late = even(panel.where("era = 2"), 1).count() + even(panel.where("era IN (3, 4, 5)"), 0).count()
    assert stream.late_rows(spark).count() == late
