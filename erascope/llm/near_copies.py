"""Near copies by SimHash fingerprints and the similarity of their word shingles.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Fingerprints of these
shingles within two bits are linked by blocks as in ``simhash``, and the texts of a link decide. Texts at 0.8 were measured
up to 17 bits of 64 apart (README), which no join on blocks of the fingerprint can carry: a choice of blocks is left
with too few bits. So the fingerprints are complemented by MinHash: texts that agree on all five minima
of one of 24 bands meet in a bucket. A pair at 0.8 meets with probability 0.9999. What meets is verified on the
texts themselves.

Groups are what matters, not pairs, so a pair inside a known group is not verified again. In the first rounds one
text of every bucket that still holds several groups is its centre, another one each round, and the texts of other groups
meet it, so a round is linear in the buckets; there are ``ROUNDS`` of them unless one finds nothing new. What is
left, texts that share buckets but no group, is paired by rare shingles: in sets sorted by how many texts have a shingle, of
sizes m and n, a pair at 0.8 has ``need = 4 / 9 * (m + n)`` shingles in common, so one of them is among the first
``m - need + 1`` and ``n - need + 1``. This loses no pair, and texts that share a passage only share its frequent shingles, which
come last, and do not meet. A pair has at most ``m + n - 2 * need`` shingles in one of its sets only, of which those that no
other text has and the parities that differ are a lower bound, which keeps variants of one text apart. So pairs grow with the texts and not with the square of a passage's. Each pair is judged on one
byte of every minimum first (two texts at 0.8 agree on 96 of 120 on average, with a deviation of 4.4; ``AGREE``, five
deviations less, rules out one pair in a million); the texts of those that agree are fetched, and decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope.llm.common import small_batches, staged
from erascope.llm.graph import components
from erascope.llm.simhash import SEED, keep_first, link_prints, majority, near_links, shingle_hashes, signed

SHINGLE = 5
SIMILAR = 0.8
BANDS = 24
ROWS = 5  # minima of a band
MINIMA = BANDS * ROWS
AGREE = 74
ROUNDS = 2  # with a centre per bucket at most; what they leave is paired in any case
PARITIES = 4  # words of 64 parities
PARITY = [f"parity_{i}" for i in range(PARITIES)]
CHUNK = 1 << 12
HANDED = 1 << 9  # rows that a Python worker gets at once
BATCH = 1 << 6  # texts or pairs of texts that are held at once

_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text with fewer words is one shingle, without words none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones it is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def minima(found: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.uint64)
    lows = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), CHUNK):
        lows = np.minimum(lows, (found[i : i + CHUNK, None] * FACTORS + OFFSETS).min(axis=0))
    return lows


def _signed_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints, fingerprints, signs = [], [], []
        for text in batch["text"]:
            hashes = shingle_hashes(text, SHINGLE)
            found = np.unique(hashes)
            prints.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            fingerprints.append(signed(majority(hashes)))
            signs.append(minima(found).astype(np.uint8).tobytes())
        prints = np.array(prints, np.uint64).view(np.int64)
        yield pd.DataFrame({"id": batch["id"], "hash": batch["hash"], "print": prints, "fingerprint": np.array(fingerprints, np.int64), "sign": signs})


def band_keys(sign: Column) -> Column:
    """A hash of the number and the bytes of each band of a text's signature."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(sign, i * ROWS + 1, ROWS)) for i in range(BANDS)])


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b`` that connect the texts (``print, fingerprint``) whose fingerprints ``near_links`` connects."""
    lows = staged(texts.groupBy("fingerprint").agg(F.min("print").alias("low")), "near-fingerprints")
    near = near_links(lows.select(F.col("fingerprint").alias("print")))
    for name in ("a", "b"):
        near = near.join(lows.select(F.col("fingerprint").alias(name), F.col("low").alias(f"low_{name}")), name)
    same = texts.join(lows, "fingerprint").filter("print <> low").select("low", "print")
    pairs = near.select("low_a", "low_b").union(same).toDF("one", "other")
    return pairs.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), MINIMA) for c in ("sign_a", "sign_b"))
            yield batch.loc[(a == b).sum(axis=1) >= AGREE, ["a", "b"]]


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets: dict[int, np.ndarray] = {}
        good = []
        for i in range(0, len(batch), BATCH):
            part = batch.iloc[i : i + BATCH]
            if len(sets) > BATCH:
                sets = {}
            for a, b, one, other in zip(part["a"], part["b"], part["text_a"], part["text_b"], strict=True):
                for name, text in ((a, one), (b, other)):
                    if name not in sets:
                        sets[name] = shingle_set(text)
                good.append(similarity(sets[a], sets[b]) >= SIMILAR)
        yield batch.loc[np.array(good, bool), ["a", "b"]]


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose ``texts`` (``print, sign, text``) are similar; signatures rule most others out."""
    for name in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("print").alias(name), F.col("sign").alias(f"sign_{name}")), name)
    pairs = staged(pairs.select("a", "b", "sign_a", "sign_b").mapInPandas(_agreeing, "a long, b long"), "near-agreeing")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    wanted = staged(texts.select("print", "text").join(needed.hint("merge"), "print"), "near-wanted")
    for name in ("a", "b"):
        pairs = pairs.join(wanted.select(F.col("print").alias(name), F.col("text").alias(f"text_{name}")), name)
    return staged(pairs.select("a", "b", "text_a", "text_b").mapInPandas(_similar, "a long, b long"), "near-links")


def open_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, print, root`` of the buckets that hold texts of several groups of ``links``."""
    roots = components(links).withColumnRenamed("node", "print")
    rooted = members.select("key", "print").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    spread = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return staged(rooted.join(spread.select("key"), "key", "left_semi"), "near-open")


def needed_of(total: Column) -> Column:
    """How many shingles two similar sets of ``total`` shingles together have in common at least."""
    return F.ceil(total * (SIMILAR / (1 + SIMILAR)) - 1e-6)


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, root, text in zip(batch["print"], batch["root"], batch["text"], strict=True):
            found = shingle_set(text)
            yield pd.DataFrame({"print": name, "root": root, "size": len(found), "shingle": found.view(np.int64)})


def rare_shingles(texts: DataFrame) -> DataFrame:
    """``shingle, place, size, print, root``: of each text (``print, root, text``) the shingles that one of its pairs must have.

    ``place`` counts from 0 by the number of texts that have a shingle. Those that no other text has come first; they are left
    out and counted in ``alone``. ``parity_`` holds the parity of the number of the others by their last bits.
    """
    rows = staged(texts.mapInPandas(_shingles, "print long, root long, size long, shingle long"), "near-shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    parity = [F.bit_xor(F.when(F.expr(f"(shingle >> 6) & {PARITIES - 1} = {i}"), bit).otherwise(F.lit(0))).alias(f"parity_{i}") for i in range(PARITIES)]
    listed = F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared")
    shared = rows.join(often, "shingle").groupBy("print", "root", "size").agg(listed, *parity)
    alone = F.col("size") - F.size("shared")
    first = F.col("size") - F.ceil(F.col("size") * SIMILAR - 1e-6) + 1  # no partner is smaller than that
    about = ["size", "alone", "print", "root", *PARITY]
    ranked = shared.withColumn("alone", alone).filter(alone < first)
    ranked = ranked.select(*about, F.posexplode(F.slice("shared", F.lit(1), (first - alone).cast("int"))).alias("at", "one"))
    return ranked.select("one.shingle", (F.col("alone") + F.col("at")).alias("place"), *about)


def pairs_with_centres(left: DataFrame, number: int) -> DataFrame:
    """``a, b`` with ``a < b``: the texts of open buckets (``key, print, root``) with the centre of the round, unless of its group."""
    centre = F.min(F.struct(F.xxhash64("print", F.lit(number)).alias("order"), "print", "root")).alias("centre")
    met = left.join(left.groupBy("key").agg(centre), "key").filter("root <> centre.root")
    if number == 0:  # copies share all their buckets: one centre is enough to begin with
        met = met.groupBy("print").agg(F.min("centre").alias("centre"))
    return met.select(F.least("print", "centre.print").alias("a"), F.greatest("print", "centre.print").alias("b")).distinct()


def rare_pairs(left: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: texts of different groups of open buckets whose rare shingles allow for a similarity of 0.8."""
    needed = left.select("print", "root").distinct()
    rare = staged(rare_shingles(texts.select("print", "text").join(needed.hint("merge"), "print")), "near-rarest")
    # the largest group at a shingle is not paired with itself
    sizes = rare.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("texts"))
    most = sizes.groupBy("shingle").agg(F.max(F.struct("texts", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("groups"))
    rare = rare.join(most.filter("groups > 1"), "shingle")
    sides = ["print", "root", "place", "size", "alone", *PARITY]
    some = rare.filter("root <> most").select("shingle", *[F.col(c).alias(f"{c}_a") for c in sides])
    need = needed_of(F.col("size_a") + F.col("size"))
    fits = (F.col("place_a") + need <= F.col("size_a")) & (F.col("place") + need <= F.col("size"))
    # as many shingles at least are in one of the two sets only
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(c))) for c in PARITY), F.col("alone_a") + F.col("alone"))
    near = apart <= F.col("size_a") + F.col("size") - 2 * need
    pairs = some.join(rare, (some["shingle"] == rare["shingle"]) & F.expr("root <> root_a AND (root = most OR print_a < print)") & fits & near)
    return pairs.select(F.least("print_a", "print").alias("a"), F.greatest("print_a", "print").alias("b")).distinct()


def verified_links(members: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect what verified pairs of ``first`` and of rows ``key, print`` of equal key connect."""
    left = members.withColumn("root", F.col("print"))
    tried = staged(first.union(pairs_with_centres(left, 0)).distinct(), "near-pairs")
    links = similar(tried, texts)
    for number in range(1, ROUNDS):
        left = open_buckets(left, links)
        if left.isEmpty():
            return links
        pairs = staged(pairs_with_centres(left, number).join(tried, ["a", "b"], "left_anti"), "near-pairs")
        found = similar(pairs, texts)
        links, tried = links.unionByName(found), tried.unionByName(pairs)
        if found.isEmpty():
            break
    else:
        left = open_buckets(left, links)
    pairs = rare_pairs(left, texts).join(tried, ["a", "b"], "left_anti")
    return links.unionByName(similar(staged(pairs, "near-pairs"), texts))


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group that similar pairs connect the document with the smallest id stays.

    Texts without words are one group. Null and repeated ids are treated as in ``simhash.keep_one_of_each_group``.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession, HANDED):
        return _kept(docs, rows, kind)


def _kept(docs: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    found = staged(rows.mapInPandas(_signed_texts, f"id {kind}, hash long, print long, fingerprint long, sign binary"), "near-prints")
    narrow = found.select(F.col("id").alias("doc_id"), "hash", "print")

    def links(classes: DataFrame) -> DataFrame:
        one = F.min(F.struct("hash", "fingerprint", "sign")).alias("one")
        distinct = staged(found.filter(F.octet_length("sign") > 0).groupBy("print").agg(one).select("print", "one.*"), "near-signed")
        first = staged(simhash_pairs(distinct), "near-simhash")
        keyed = distinct.select("print", F.explode(band_keys(F.col("sign"))).alias("key"))
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        members = staged(keyed.join(shared.select("key"), "key").select("key", "print"), "near-members")
        met = members.select("print").union(first.select(F.explode(F.array("a", "b")))).distinct()
        # the texts that meet another one grow with the corpus: they are fetched by one shuffle, whatever the size
        needed = distinct.join(met, "print").select("hash", "print", "sign")
        named = rows.select("hash", "text").join(needed.hint("merge"), "hash").groupBy("hash", "print").agg(F.first("sign").alias("sign"), F.first("text").alias("text"))
        return verified_links(members, first, staged(named.select("print", "sign", "text"), "near-texts"))

    return keep_first(docs, narrow, link_prints(narrow, links))
