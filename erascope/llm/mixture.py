"""Mix sources to target weights, with DataFrame operations only.

Every source's target is a number of words. A document gets a pseudo-random place from its id and text; the mix
takes it once per full pass over the source, and once more if its place lies below the source's threshold. The
threshold comes from nested histograms: words are summed by source and bucket of the place, the bucket in
which the running sum meets the budget is split again, and so on, until no bucket is left to split. Only
documents of those boundary buckets are counted again, and no documents are sorted. Rows that repeat id and text share a place:
those of a source's boundary place are divided in the same way by places of their own, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erascope.llm.common import SPACED_WORD, staged

WEIGHTS = (3, 1, 2)  # by the source's position, repeating
SHARE = 1.5  # words of the mix in units of all words
MOST = 2  # no source is taken more than so many times
STEP_BITS = 12
LEVELS = 5  # the place has STEP_BITS * LEVELS bits


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def place_of(doc_id: Column, text: Column) -> Column:
    """60 pseudo-random bits of id and text; null counts as the empty text."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return _bits(F.md5(F.concat_ws(":", *parts).cast("binary")))


def row_place(row: Column) -> Column:
    """60 pseudo-random bits of the number of a row."""
    return _bits(F.md5(row.cast("string").cast("binary")))


def _bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, STEP_BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code point order, null last, weigh 3, 1, 2, repeating. The targets share 1.5 times all words by
    weight; one above twice its source's size stops there and the rest is shared again, until none is above.
    That is a common level per weight: sources are taken in the order in which a rising level meets their stop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("weight", F.get(weights, (F.col("at") - 1) % len(WEIGHTS)))
    per = per.withColumn("stop", F.col("source_size") * float(MOST))
    rising = Window.orderBy(F.col("stop") / F.col("weight"), "at")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) * SHARE - stopped) / open_weight
    # the first source whose stop lies above the level that is left for it and those behind it
    met = F.when(F.col("stop") >= level * F.col("weight"), level)
    per = per.withColumn("own_level", met)
    level = F.first("own_level", ignorenulls=True).over(whole)
    target = F.coalesce(F.least(F.col("stop"), level * F.col("weight")), F.col("stop"))
    return per.select("source", "source_size", target.alias("target"))


def edges(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``of, low, words, left``: the place at which the running sum of a source first exceeds its goal.

    ``rows`` has ``source, size, place``, ``goals`` has ``source, rest``. ``words`` is the sum at the place, ``left`` what the
    goal leaves for it. Sources whose goal is not below their whole have no row.
    """
    state = goals.select(F.col("source").alias("of"), F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = STEP_BITS * (LEVELS - 1 - level)
        prefix = F.shiftright("place", shift + STEP_BITS)
        state = state.select("of", "left", "prefix")
        inside = rows.join(state, rows["source"].eqNullSafe(state["of"]) & (prefix == F.col("prefix")))
        bucket = F.shiftright("place", shift)
        # partial sums leave at most one row per task, source and bucket, however large a source is
        sums = inside.groupBy("of", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("left").alias("left"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        sums = sums.withColumn("passed", F.sum("words").over(Window.partitionBy("of").orderBy("bucket")))
        edge = F.min_by(F.struct("words", "low", "high", (F.col("left") - (F.col("passed") - F.col("words"))).alias("left")), "bucket")
        met = sums.filter("passed > left").groupBy("of").agg(F.min("bucket").alias("prefix"), edge.alias("edge"))
        state = staged(met.select("of", "prefix", "edge.words", "edge.low", "edge.high", "edge.left"), "mixture-edges")
        if state.filter("low < high").isEmpty():  # every boundary bucket is a single place
            break
    return state.select("of", "low", "words", "left")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (``doc_id, text, source``).

    ``taken`` is a multiple of ``size``: the full passes over the source, and one more below the threshold. A source
    misses its target by half of its boundary document at most. Null text has size 0; null is a source of its own. With no
    words at all every target is 0. The same table gives the same rows; which of exactly repeated rows is taken is open.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place_of(F.col("doc_id"), F.col("text")).alias("place"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "mixture-rows")
    plan = _plan(rows)
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["mixed_source"]))
    at_edge = F.col("place") == F.col("mixed_low")
    within = joined.filter(~at_edge).withColumn("times", _times(F.col("place") < F.col("mixed_low")))
    both = within.unionByName(_divided(joined.filter(at_edge)))
    return both.select(
        "doc_id", "size", F.col("mixed_size").alias("source_size"), F.col("mixed_target").alias("target"), (F.col("size") * F.col("times")).alias("taken")
    )


def _plan(rows: DataFrame) -> DataFrame:
    """Per source its size and target, the full passes over it, and the boundary place of the pass that is not full."""
    targets = staged(source_targets(rows.select("source", "size")), "mixture-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("mixed_passes", passes)
    plan = plan.withColumn("rest", F.col("target") - F.col("mixed_passes") * F.col("source_size"))
    found = edges(rows, plan.select("source", "rest"))
    plan = plan.join(found, plan["source"].eqNullSafe(found["of"]), "left")
    plan = plan.select(
        F.col("source").alias("mixed_source"), F.col("source_size").alias("mixed_size"), F.col("target").alias("mixed_target"), "mixed_passes",
        # without an edge every place is below
        F.coalesce("low", F.lit(1 << (STEP_BITS * LEVELS))).alias("mixed_low"), F.coalesce("left", F.lit(0.0)).alias("mixed_left"),
    )
    # written down, so that Spark knows its size and broadcasts it if it is small: texts need no shuffle by source
    return staged(plan, "mixture-plan")


def _times(more: Column) -> Column:
    """How often a document is taken, with one pass more where ``more`` holds."""
    return F.least(F.col("mixed_passes") + F.when(more, 1).otherwise(0), F.lit(MOST))


def _divided(rows: DataFrame) -> DataFrame:
    """``rows`` of boundary places (``size, row`` and the plan) with ``times``: as many are taken once more as the goal leaves room for."""
    placed = rows.withColumn("mixed_place", row_place(F.col("row")))
    goals = placed.groupBy("mixed_source").agg(F.first("mixed_left").alias("rest")).withColumnRenamed("mixed_source", "source")
    found = edges(placed.select(F.col("mixed_source").alias("source"), "size", F.col("mixed_place").alias("place")), goals)
    # the boundary row goes in if the goal lies nearer to the sum with it
    limits = found.select("of", (F.col("low") + F.when(F.col("left") * 2 > F.col("words"), 1).otherwise(0)).alias("mixed_below"))
    joined = placed.join(limits, placed["mixed_source"].eqNullSafe(limits["of"]), "left")
    more = F.coalesce(F.col("mixed_place") < F.col("mixed_below"), F.lit(True))
    return joined.withColumn("times", _times(more)).drop("mixed_place", "of", "mixed_below")


def take(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row of ``docs`` as many times as the mix takes it, with the same columns.

    Rows of size 0 follow their source's passes and threshold like any other.
    """
    columns = docs.columns
    renamed = docs.toDF(*[f"doc_{i}" for i in range(len(columns))])
    of = {c: renamed[f"doc_{i}"] for i, c in enumerate(columns)}
    keyed = renamed.withColumn("place", place_of(of["doc_id"], of["text"]))
    sizes = keyed.select(of["source"].alias("source"), word_count(of["text"]).alias("size"), "place")
    plan = _plan(staged(sizes, "mixture-rows"))
    joined = keyed.join(plan, of["source"].eqNullSafe(plan["mixed_source"]))
    at_edge = F.col("place") == F.col("mixed_low")
    within = joined.filter(~at_edge).withColumn("times", _times(F.col("place") < F.col("mixed_low")))
    edge = joined.filter(at_edge).withColumn("size", word_count(of["text"])).withColumn("row", F.monotonically_increasing_id())
    divided = _divided(staged(edge, "mixture-edge-rows"))
    kept = [*renamed.columns, "times"]
    both = within.select(*kept).unionByName(divided.select(*kept)).filter("times > 0")
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(*[F.col(f"doc_{i}").alias(c) for i, c in enumerate(columns)])
