"""Language identification with string kernels.

A text is folded to symbols (letters; every run of other characters is one gap) and described by the set
of its n-grams of one to three symbols. The kernel of two texts is the number of n-grams present in both,
summed over the lengths and divided by the geometric mean of each text's own number. A bounded sample of
labelled rows gives landmarks (Nystroem) and the training rows of one-versus-rest kernel ridge regression;
a batch of texts is scored by two matrix products: presence by landmarks, then landmarks by labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope.llm.common import id_remainder, spare_name

ALPHABET = 96  # 0 is the gap, 1..26 are a..z, other letters share the rest
CODES = ALPHABET + ALPHABET**2 + ALPHABET**3
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled sample, ``landmarks`` the Nystroem rank, ``columns`` the width of the model."""

    fit_rows: int = 1536
    landmarks: int = 160
    ridge: float = 1e-2
    columns: int = 1 << 15
    batch: int = 128


@dataclass(frozen=True)
class Model:
    labels: list[str]
    column_of: np.ndarray  # n-gram code -> column of ``presence``; -1 where no landmark has it
    presence: np.ndarray  # columns x landmarks
    own: np.ndarray  # square roots of the landmarks' own kernel values
    weights: np.ndarray  # landmarks x labels
    bias: np.ndarray


@cache
def symbol_table() -> np.ndarray:
    """Symbol of every code point: letters without regard to case, 0 for anything else."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 % 2**32 >> 8) % (ALPHABET - 27)
    return table


def symbols(text: str | None) -> np.ndarray:
    """Letters as symbols with one gap between words and at both ends; empty if there is no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = symbol_table()[points]
    if not row.any():
        return row[:0]
    row = np.concatenate([row[:0], [0], row, [0]]).astype(np.uint8)
    keep = row > 0
    keep[1:] |= keep[:-1]  # a gap stays only behind a letter
    keep[0] = True
    return row[keep]


def gram_codes(text: str | None) -> np.ndarray:
    """Codes of the n-grams of one to three symbols, repeats included."""
    row = symbols(text).astype(np.int32)
    pairs = row[:-1] * ALPHABET + row[1:]
    triples = pairs[:-1] * ALPHABET + row[2:]
    return np.concatenate([row, pairs + ALPHABET, triples + (ALPHABET + ALPHABET**2)])


def _distinct(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        codes = [np.unique(gram_codes(t)) for t in batch["text"]]
        yield pd.DataFrame({"key": batch["key"], "lang": batch["lang"], "codes": codes})


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from rows ``doc_id, text, lang``; rows without lang or letters are left out, None if none remain.

    The sample takes the rows with the smallest pseudo-random keys, which are scaled by the number of rows
    of the label, so that each label has about the same share and a rerun takes the same rows.
    """
    named = labelled.filter(F.col("lang").isNotNull())
    # one number per label, as the model has one column per label
    sizes = {r["lang"]: r["size"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).collect()}
    if not sizes:
        return None
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair]), F.col("lang"))
    uniform = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    key = (uniform * size).alias("key")
    last = named.select(key).orderBy("key").limit(settings.fit_rows).agg(F.max("key")).first()[0]
    chosen = named.filter(F.col("text").rlike(r"\p{L}")).select(key, "text", "lang").filter(F.col("key") <= F.lit(last))
    # equal keys (one id in many rows) could exceed the bound
    rows = chosen.limit(2 * settings.fit_rows).mapInPandas(_distinct, "key double, lang string, codes array<int>").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["key", "lang"], kind="stable").reset_index(drop=True)
    labels = sorted(set(rows["lang"]))
    grams = [np.asarray(c, np.int64) for c in rows["codes"]]
    marks = grams[: settings.landmarks]
    known = np.unique(np.concatenate(marks))
    column_of = np.full(CODES, -1, np.int32)
    column_of[known] = np.arange(len(known)) % settings.columns
    presence = np.zeros((min(len(known), settings.columns), len(marks)), np.float32)
    for j, codes in enumerate(marks):
        presence[column_of[codes], j] = 1
    own = np.sqrt([len(c) for c in marks])

    def kernel(some: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(some), len(presence)), np.float32)
        for i, codes in enumerate(some):
            found = column_of[codes]
            x[i, found[found >= 0]] = 1
        return (x @ presence) / np.outer(np.sqrt([len(c) for c in some]), own)

    values, vectors = np.linalg.eigh(kernel(marks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
    features = np.concatenate([kernel(grams[i : i + 256]) for i in range(0, len(grams), 256)]) @ root
    design = np.column_stack([features, np.ones(len(features))])
    targets = np.where(rows["lang"].to_numpy()[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    penalty = settings.ridge * np.eye(design.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(design.T @ design + penalty, design.T @ targets)
    return Model(labels, column_of, presence, own, root @ solved[:-1], solved[-1])


def score_batch(model: Model, texts: list[str | None], seen: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Labels and scores of a few texts; ``seen`` is a zeroed flag per code, left zeroed."""
    x = np.zeros((len(texts), len(model.presence)), np.float32)
    size = np.zeros(len(texts))
    for i, text in enumerate(texts):
        codes = gram_codes(text)
        seen[codes] = True
        size[i] = np.count_nonzero(seen)
        seen[codes] = False
        found = model.column_of[codes]
        x[i, found[found >= 0]] = 1
    kernel = (x @ model.presence) / np.maximum(np.sqrt(size)[:, None], 1) / model.own
    values = kernel @ model.weights + model.bias
    best = values.argmax(axis=1)
    score = np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1)
    return [model.labels[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)], np.where(size > 0, score, 0.0)


def with_language(docs: DataFrame, model: Model | None, name: str, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with a struct ``name`` of ``lang_pred`` and ``score``, from the text alone.

    Null text, a text without a letter, or no model: ``und`` and 0. Equal texts get equal results.
    """
    if model is None:
        none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        return docs.withColumn(name, none)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(CODES, bool)
        for texts in batches:
            labels, scores = [], []
            for i in range(0, len(texts), settings.batch):
                found = score_batch(shared.value, list(texts[i : i + settings.batch]), seen)
                labels += found[0]
                scores.append(found[1])
            yield pd.DataFrame({"lang_pred": labels, "score": np.concatenate([*scores, np.zeros(0)])})

    return docs.withColumn(name, classify.asNondeterministic()("text"))


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 4) == 2


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the rows that are not held out, predict all: ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), settings)
    scored = with_language(docs.select("doc_id", "text"), model, "found", settings)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs`` whose text has a language; only texts without any letter (or null) are rejected."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), settings)
    name = spare_name(docs, "found")
    scored = with_language(docs, model, name, settings)
    kept = scored.filter(F.col(f"{name}.lang_pred") != UNKNOWN) if model else scored
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
