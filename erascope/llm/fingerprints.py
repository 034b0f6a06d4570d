"""Document fingerprints: the word-shingle hashes below a fixed fraction of all hash values.

The number kept grows with the text, so the share of one text's hashes that another has is an unbiased estimate
of containment however unequal the two are, and the sketch of a union is the union of the sketches. A text whose
hashes all lie above the fraction keeps its smallest one, so that no text with words has an empty sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope.llm.common import text_bytes

SHINGLE = 5
SCALE = 4  # one hash of so many is kept
CEILING = (1 << 64) // SCALE
LOWEST = -(1 << 63)
RANGE_ROWS = 2_000  # documents of a range of ids, about
MOST_RANGES = 20_000  # ranges get longer beyond that; a range is read as a stream, so its length costs no memory


def sketch(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes below the fraction; a text of fewer words is one shingle, none gives nothing."""
    words = text_bytes(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(SHINGLE)), strict=False)] or [b" ".join(words)]
    hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))
    kept = hashes[hashes < CEILING]
    return kept if len(kept) else hashes[:1]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    kept = both[both < CEILING]
    return kept if len(kept) else both[:1]


def to_text(kept: np.ndarray) -> str:
    """16 hexadecimal digits per hash, in order."""
    return kept.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 if neither text has words, 0 if only one has."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has; 1 if the first has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``, or all of it if shorter."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _row(doc_id, text: str, kept: np.ndarray, following: str, following_kept: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_kept = kept if changed == text else sketch(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(kept), to_text(changed_kept),
        likeness(kept, changed_kept), likeness(kept, following_kept), containment(kept, changed_kept),
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_edited double"
)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range, then by falling id, the guest of the next range last: each meets the row behind it."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    held = None  # range, id, text and sketch of the row before
    for batch in batches:
        done = []
        for number, name, text, guest in zip(batch["range"], batch["id"], batch["text"], batch["guest"], strict=True):
            if guest and (held is None or held[0] != number):
                continue  # a further row with the guest's id
            text = text or ""
            kept = sketch(text)
            if held is not None and held[0] == number:
                done.append(_row(*held[1:], text, kept))
            held = None if guest else (number, name, text, kept)
        values = dict(zip(columns, zip(*done, strict=True), strict=True)) if done else {c: [] for c in columns}
        ids = pd.array([None if v is None else int(v) for v in values["doc_id"]], dtype="Int64")
        yield pd.DataFrame({**values, "doc_id": ids})


def range_number(at: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie above ``at``: range 0 has the largest ids. Looks at every 64th cut first."""
    if not cuts:
        return F.lit(0)

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c <= at))

    fine = F.lit(np.array(cuts, np.int64))
    start = F.greatest(below(F.lit(np.array(cuts[::64], np.int64))) - 1, F.lit(0)) * 64
    return F.lit(len(cuts)) - start - below(F.slice(fine, start + 1, F.lit(64)))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` for every row of ``docs`` (``doc_id, text``): fingerprints of texts and of edited texts.

    The edit takes its words from the next document by falling id, after the last one from the first; ids that
    are null come last, rows with equal ids in the order of their texts. Null text counts as empty. A single row
    is its own next document.

    Ids are cut into ranges at quantiles. Texts are shuffled once, by range, and read in order as a stream; the
    first row of each range is also sent to the range before it, as the document behind its last one.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    ids = docs.select(order.alias("at"))
    rows = ids.count()
    if not rows:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    pieces = min(MOST_RANGES, max(1, rows // RANGE_ROWS))
    cuts = sorted(set(ids.approxQuantile("at", [i / pieces for i in range(1, pieces)], 0.2 / pieces))) if pieces > 1 else []
    number = range_number(order, [int(c) for c in cuts])
    tops = ids.groupBy(range_number(F.col("at"), [int(c) for c in cuts]).alias("range")).agg(F.max("at").alias("at"))
    heads = {r["range"]: r["at"] for r in tops.collect()}
    known = sorted(heads)
    # the range before each one, and the first one's guests go to the last
    host = {heads[r]: known[i - 1] for i, r in enumerate(known)}
    hosts = F.create_map(*[F.lit(x) for pair in host.items() for x in pair])
    guest = F.try_element_at(hosts, order)
    places = F.array(
        F.struct(number.alias("range"), F.lit(False).alias("guest")), F.struct(guest.alias("range"), F.lit(True).alias("guest"))
    )
    sent = docs.select(F.col("doc_id").cast("string").alias("id"), order.alias("at"), "text", F.explode(F.filter(places, lambda p: p["range"].isNotNull())).alias("place"))
    sent = sent.select("id", "at", "text", "place.range", "place.guest")
    behind = [F.col("at").desc(), F.col("id").isNull(), F.col("text").asc_nulls_first()]
    sorted_rows = sent.repartition("range").sortWithinPartitions("range", "guest", *behind)
    return sorted_rows.mapInPandas(_compare, SCHEMA)
