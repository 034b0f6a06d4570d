"""Near-duplicate groups by SimHash fingerprints.

Fingerprints that differ in at most two bits are linked. They are cut into five blocks: two differing bits
touch at most two of them, so a linked pair agrees on at least three. Distinct fingerprints are therefore
joined on every choice of three blocks (38 or 39 bits) and the Hamming distance of the pairs is verified.
A bucket of more than ``PAIRED`` fingerprints is not paired: its members send themselves and every value
that is one bit away. Two fingerprints are within two bits of each other exactly if they meet at such a
value, and at most 27 can meet at one, so the links stay linear in the bucket and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from erascope.llm.common import spare_name, staged, text_bytes
from erascope.llm.graph import components

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
BLOCKS = 5
PAIRED = 24
CHUNK = 1 << 15


def signed(value: int) -> int:
    """The 64 bits of ``value`` as a signed integer."""
    return value - (1 << BITS) if value >> (BITS - 1) else value


def block_masks() -> list[int]:
    """Bit masks of every choice of blocks that a linked pair may agree on."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, BLOCKS - RADIUS)]


def majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the 64-bit hashes, repeats included; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), CHUNK):
        chunk = hashes[start : start + CHUNK].astype(">u8")
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of ``size`` words, in order; a text with fewer words is one shingle, without words none."""
    words = text_bytes(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(size)), strict=False)] or [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))


def fingerprint(text: str | None) -> int:
    """Majority bit by bit over the hashes of the word shingles; 0 without words."""
    return majority(shingle_hashes(text))


@F.pandas_udf(LongType())
def fingerprint_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` between the distinct values of the column ``print`` that connect whatever lies within two bits."""
    masks = block_masks()
    keys = prints.select("print").distinct().select(
        "print",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("choice"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)])
        ).alias("key"),
    ).select("key.choice", "key.part", "print")
    sizes = keys.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = staged(keys.join(sizes, ["choice", "part"]), "simhash-buckets")
    left = members.filter(F.col("size") <= PAIRED).select("choice", "part", F.col("print").alias("a"))
    right = left.withColumnRenamed("a", "b")
    pairs = left.join(right, ["choice", "part"]).filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )
    flips = [[0, *(signed(1 << k) for k in range(BITS) if not m >> k & 1)] for m in masks]
    choices = F.array(*[F.array(*[F.lit(v) for v in row]) for row in flips])
    meeting = members.filter(F.col("size") > PAIRED).select(
        "choice", "print", F.explode(F.get(choices, F.col("choice"))).alias("flip")
    ).select("choice", "print", F.col("print").bitwiseXOR(F.col("flip")).alias("point"))
    lowest = F.min("print").over(Window.partitionBy("choice", "point"))
    stars = meeting.select(F.col("print").alias("a"), lowest.alias("b")).filter("a <> b")
    return pairs.select("a", "b").unionByName(stars.select("a", "b"))


def link_prints(printed: DataFrame, links: Callable[[DataFrame], DataFrame] = near_links) -> DataFrame:
    """``print, root, component_id`` per distinct value of ``print`` in rows ``doc_id, print``; ``root`` names the group."""
    classes = staged(printed.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes))
    joined = classes.join(roots, classes["print"] == roots["node"], "left")
    joined = joined.select("print", "first", F.coalesce("root", "print").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(lowest, "root").select("print", "root", "component_id")


def group_near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Null text counts as empty; texts without words have fingerprint zero and are linked like any other.
    Repeated rows each get a row. Rows with a null id take the smallest id of their group, null if it has none.
    """
    printed = staged(docs.select("doc_id", fingerprint_column("text").alias("print")), "simhash-prints")
    joined = printed.join(link_prints(printed), "print")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the near-duplicates: each group keeps its document with the smallest id.

    Of rows that share this id, one with the smallest text hash stays; a group without ids keeps one row in the
    same way. What goes is decided on narrow rows; the texts are joined once, with the keys of the rows to drop.
    """
    narrow = staged(
        docs.select("doc_id", F.xxhash64("text").alias("hash"), fingerprint_column("text").alias("print")), "simhash-prints"
    )
    return keep_first(docs, narrow, link_prints(narrow))


def keep_first(docs: DataFrame, narrow: DataFrame, linked: DataFrame) -> DataFrame:
    """``docs`` without what ``narrow`` (``doc_id, hash, print`` of its rows) and ``linked`` (see ``link_prints``) drop."""
    rows = narrow.join(linked, "print").groupBy("root", "component_id", "doc_id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    rows = staged(rows, "simhash-rows")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.filter(stays).groupBy("root").agg(F.min("hash").alias("first"))
    judged = rows.join(first, "root").withColumn("stays", stays & (F.col("hash") == F.col("first")))
    name = spare_name(docs, "text_hash")
    keyed = docs.withColumn(name, F.xxhash64("text"))

    def of(keys: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(keys["doc_id"]) & (keyed[name] == keys["hash"])

    gone = staged(judged.filter(~F.col("stays") | (F.col("rows") > 1)).select("doc_id", "hash", "stays"), "simhash-gone")
    # what goes grows with the corpus, so it is not broadcast at any size
    kept = keyed.join(gone.hint("merge"), of(gone), "left_anti")
    once = gone.filter("stays")
    if not once.isEmpty():  # rows that are repeated as they are
        kept = kept.unionByName(keyed.join(once, of(once), "left_semi").dropDuplicates(["doc_id", name]))
    return kept.drop(name)
