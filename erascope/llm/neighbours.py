"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A bounded sample gives the codes: principal axes, turned by rotations that bring the projected sample closest to
its own signs (several rotations, if a vector has fewer dimensions than a code has bits). A code is cut into
substrings and each substring indexed. Codes within a Hamming radius ``r`` of a query agree with it up to
``r // substrings`` bits in at least one substring, so probing all buckets that close finds every one of them;
they are verified on the whole code and ranked by the cosine of the original vectors in double precision.

The index is cut into blocks by a hash of the row, each with its own substring tables, and the stated query set
into chunks; every chunk meets every block in a task of its own, which holds one block and one chunk whatever
the size of the table or the number of equal vectors. Only the best of each block go on to the final ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 128
PART = 16  # bits of a substring
PARTS = BITS // PART


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that codes and radius are learned from; ``cover`` is the share of the sample's true neighbours the radius must hold."""

    neighbours: int = 5
    sample: int = 4096
    trial: int = 256
    cover: float = 0.985
    rounds: int = 30
    block_rows: int = 16_384
    chunk_rows: int = 4_096


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    axes: np.ndarray  # dimensions x bits, rotations included
    radius: int


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def encode(codes: Codes, rows: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    signs = (unit(rows) - codes.mean) @ codes.axes > 0
    return np.packbits(signs, axis=1).view(np.uint16).reshape(len(rows), PARTS)


def learn(sample: np.ndarray, settings: Settings) -> Codes:
    """Axes, rotations and radius from the sampled vectors."""
    rows = unit(sample)
    mean = rows.mean(axis=0)
    spread, vectors = np.linalg.eigh((rows - mean).T @ (rows - mean))
    principal = vectors[:, np.argsort(-spread, kind="stable")][:, :BITS]
    rng = np.random.default_rng(7)
    projected = (rows - mean) @ principal
    turned = []
    while sum(t.shape[1] for t in turned) < BITS:
        turn = np.linalg.qr(rng.normal(size=(principal.shape[1],) * 2))[0]
        for _ in range(settings.rounds):
            left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (left @ right).T
        turned.append(principal @ turn)
    axes = np.concatenate(turned, axis=1)[:, :BITS]
    codes = Codes(mean, axes, BITS)
    known = encode(codes, sample)
    trial = min(settings.trial, len(rows))
    likeness = rows[:trial] @ rows.T
    likeness[np.arange(trial), np.arange(trial)] = -np.inf
    nearest = np.argsort(-likeness, axis=1, kind="stable")[:, : min(settings.neighbours, len(rows) - 1)]
    away = [hamming(known[nearest[i]], known[i]) for i in range(trial)]
    radius = int(np.quantile(np.concatenate(away), settings.cover, method="higher")) if nearest.size else BITS
    return Codes(mean, axes, radius)


def hamming(known: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(known ^ code).sum(axis=1, dtype=np.int64)


class Block:
    """The substring tables of some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(PARTS):
            order = np.argsort(codes[:, j], kind="stable")
            values, counts = np.unique(codes[:, j], return_counts=True)
            self.tables.append((order, values, counts))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius``: probe all buckets near enough in some substring, then verify."""
        near = np.zeros(len(self.codes), bool)
        for j, (order, values, counts) in enumerate(self.tables):
            hit = np.bitwise_count(values ^ code[j]) <= radius // PARTS
            near[order[np.repeat(hit, counts)]] = True
        rows = np.flatnonzero(near)
        return rows[hamming(self.codes[rows], code) <= radius]


FOUND = ["query_id", "key", "asked", "vec_id", "score", "times"]


def search(codes: Codes, settings: Settings, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The best distinct rows of one block for every query of one chunk, with the times that each may be taken."""
    ids, keys = index["vec_id"].to_numpy(), index["key"].to_numpy()
    copies = index["copies"].to_numpy()
    rows = np.stack(index["vector"].to_list()).astype(np.float64)
    size = np.sqrt((rows * rows).sum(axis=1))
    block = Block(encode(codes, rows))
    asked = np.stack(queries["vector"].to_list()).astype(np.float64)
    answers = []
    for query, key, rows_asked, vector, code in zip(queries["query_id"], queries["key"], queries["asked"], asked, encode(codes, asked), strict=True):
        radius = codes.radius
        # of the row itself only its further copies are candidates
        times = np.where((ids == query) & (keys == key), copies - 1, copies)
        while True:
            found = block.within(code, radius)
            found = found[times[found] > 0]
            if len(found) >= settings.neighbours or radius >= BITS:
                break
            radius += PARTS  # too few in the block: look further out, in the end everywhere
        # summed row by row, so that equal vectors get equal scores wherever they lie
        score = (rows[found] * vector).sum(axis=1) / (size[found] * np.sqrt((vector * vector).sum()))
        if len(found) > settings.neighbours:
            last = np.partition(score, len(score) - settings.neighbours)[len(score) - settings.neighbours]
            found, score = found[score >= last], score[score >= last]
        best = np.lexsort((ids[found], -score))[: settings.neighbours]
        answers += [(query, key, rows_asked, int(ids[found[b]]), float(score[b]), min(int(times[found[b]]), settings.neighbours)) for b in best]
    return pd.DataFrame(answers, columns=FOUND)


def nearest_neighbours(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of each row for which ``is_query`` holds.

    ``vectors`` has ``vec_id`` and ``embedding``. Ranks go by falling cosine, then by id. Rows with a null id, unusable vectors
    and those whose length is not the most frequent one take no part, as a cosine needs equal lengths. All other rows but
    the query's own are candidates, also those with its id or vector; rows that repeat id and vector are each found and
    each have their answers. Fewer candidates than asked for give fewer rows.
    """
    spark = vectors.sparkSession
    vector = F.col("embedding")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(vector)).select("vec_id", vector.alias("vector"), is_query.alias("asked"))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked"))
    lengths = lengths.orderBy(F.desc("n"), "length").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths or not lengths[0]["asked"]:
        return spark.createDataFrame([], schema)
    length, total, asked = lengths[0]
    rows = rows.filter(F.size("vector") == length)
    share = min(1.0, settings.sample / total)
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    # ids that repeat could exceed the bound
    sample = drawn.select("vec_id", "vector").limit(2 * settings.sample).toPandas()
    if len(sample) < min(total, 64):
        sample = rows.select("vec_id", "vector").limit(settings.sample).toPandas()
    matrix = np.stack(sample.sort_values("vec_id", kind="stable")["vector"].to_list()).astype(np.float64)
    codes = spark.sparkContext.broadcast(learn(matrix, settings))

    blocks, chunks = -(-total // settings.block_rows), -(-asked // settings.chunk_rows)
    key = F.xxhash64("vec_id", "vector")
    distinct = rows.groupBy("vec_id", "vector").agg(F.count_if("asked").alias("asked"), F.count(F.lit(1)).alias("copies")).withColumn("key", key)
    block, chunk = F.pmod("key", F.lit(blocks)).cast("int"), F.pmod(F.shiftright("key", 20), F.lit(chunks)).cast("int")
    index = distinct.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "key", "copies", "vector")
    queries = distinct.filter("asked > 0").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk.alias("chunk"), F.col("vec_id").alias("query_id"), "key", "asked", "vector"
    )

    def run(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if some.empty or others.empty:
            return pd.DataFrame({c: [] for c in FOUND})
        return search(codes.value, settings, some, others)

    found = index.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInPandas(
        run, "query_id long, key long, asked long, vec_id long, score double, times int"
    )
    # each block gives at most the wanted number of distinct rows, each at most so many times
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.neighbours)
    each = ranked.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int"))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
