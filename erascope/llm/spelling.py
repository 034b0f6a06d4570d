"""Spelling variants: words one edit apart, found through the sorted rotations of a permuterm index.

A word ``p c s`` with an end mark has the rotation ``s$pc``, which starts behind the letter ``c``. Skipping that
letter leaves the prefix ``s$p``: the same one for every word that has another letter there, and the whole
rotation of the word ``ps`` that lacks it. So every rotation stands in the index under its own text and under its
prefix without the last letter, and words meet in the sorted index exactly if one edit turns one into the other.
A prefix holds one word per letter of the alphabet and one without: it is scanned in one go and each member is told
how many others there are and which is the most frequent, so no pairs are listed. A letter within a row of equal
ones can be skipped at several places; only the first place counts, so that every pair meets once.

The rotations of a word take space by the square of its length. Prefixes of more than ``LONG`` letters therefore
stand in an index of their own as fingerprints of 122 bits, which follow from running sums in time by the length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erascope.llm.common import staged

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
END = "$"  # no letter of a word
SLIP = 97  # one in so many runs of a text loses a letter
SHORTEST = 5
FEWEST = 3
TIMES = 2  # a form is at least so many times as frequent
LONG = 64
PRIME = (1 << 61) - 1
BASES = (0x1F3D5B79ACE02468 % PRIME, 0x0B5E1A7C3D9F8642 % PRIME)
HELD = 200_000  # distinct words that a task counts before it passes its counts on

SCHEMA = "word string, form string, root string, n long, n_near long, form_n long"


def slipped(name: str, run: str) -> str:
    """``run`` without one letter where the checksum of id and run says so."""
    h = zlib.crc32(f"{name}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for name, text in zip(batch["name"], batch["text"], strict=True):
            for run, n in Counter(RUNS.findall(text)).items():
                word = slipped(name, run.translate(LOWER))
                if len(word) >= SHORTEST:
                    counts[word] += n
            if len(counts) >= HELD:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
    yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: words of at least ``SHORTEST`` letters that occur at least ``FEWEST`` times in all texts."""
    named = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return named.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= FEWEST)


def rotations(words: DataFrame) -> DataFrame:
    """``key, letter, n``: each rotation under its own text (no letter) and under its prefix without the last letter.

    Keys of more than ``LONG`` letters are left out.
    """
    word, size = F.col("word"), F.char_length("word")
    whole = F.transform(
        F.sequence(F.lit(0), size), lambda i: F.struct(F.concat(F.substr(word, i + 1), F.lit(END), F.left(word, i)).alias("key"), F.lit("").alias("letter"))
    )
    skipped = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            F.concat(F.substr(word, i + 1), F.lit(END), F.left(word, i - 1)).alias("key"), F.substr(word, i, F.lit(1)).alias("letter")
        ),
    )
    short = words.filter(size <= LONG + 1)
    both = F.when(size <= LONG, F.concat(whole, skipped)).otherwise(skipped)
    return short.select("n", F.explode(both).alias("at")).select("at.key", "at.letter", "n")


def running_sums(word: str, base: int) -> tuple[list[int], list[int]]:
    """Fingerprints of all beginnings of ``word`` and powers of ``base``, from which those of all rotations follow."""
    sums, powers = [0], [1]
    for letter in word:
        sums.append((sums[-1] * base + ord(letter)) % PRIME)
        powers.append(powers[-1] * base % PRIME)
    return sums, powers


def long_keys(word: str) -> Iterator[tuple[str, str, str]]:
    """Key, last letter of the key and skipped letter, as in ``rotations``, for the keys of more than ``LONG`` letters."""
    size = len(word)
    kinds = [(base, *running_sums(word, base)) for base in BASES]

    def key(at: int, before: int) -> str:
        """Fingerprint of ``word[at:]``, the end mark and ``word[:before]``."""
        parts = []
        for base, sums, powers in kinds:
            behind = sums[size] - sums[at] * powers[size - at]
            parts.append(((behind * base + ord(END)) * powers[before] + sums[before]) % PRIME)
        return f"{size - at + before}:{parts[0]:x}:{parts[1]:x}"

    if size > LONG:
        for i in range(size + 1):
            yield key(i, i), word[i - 1] if i else END, ""
    if size > LONG + 1:
        for i in range(1, size + 1):
            yield key(i, i - 1), word[i - 2] if i > 1 else END, word[i - 1]


def _long_rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for ref, word, n in zip(batch["ref"], batch["word"], batch["n"], strict=True):
            rows = pd.DataFrame(list(long_keys(word)), columns=["key", "last", "letter"])
            yield rows.assign(n=n, name=ref)


def word_at(key: str, letter: str) -> str:
    behind, before = key.split(END)
    return before + letter + behind


def neighbours_at(last: str, letters: list[str], counts: list[int], names: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """Name, number of neighbours, count and name of the best one, for the words at a key whose last letter is ``last``.

    The members come with the word that lacks the letter first, if there is one, the others by falling count and letter.
    Neighbours by a replaced letter and by one letter more or less come in rows of their own.
    """
    plain = letters[0] == ""
    others = range(1 if plain else 0, len(names))
    if len(others) > 1:
        for i in others:
            k = others[0] if i != others[0] else others[1]
            yield names[i], len(others) - 1, counts[k], names[k]
    if plain:
        near = [i for i in others if letters[i] != last]  # skips the first of equal letters only
        for i in near:
            yield names[i], 1, counts[0], names[0]
        if near:
            yield names[0], len(near), counts[near[0]], names[near[0]]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["name", "n_near", "near_n", "near"]
    held = None  # the rows of the last key, which may go on in the next batch
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        keys = batch["key"].to_numpy(object)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        held = batch.iloc[starts[-1] :]
        yield pd.DataFrame(_groups(batch, starts), columns=columns)
    if held is not None:
        yield pd.DataFrame(_groups(held, np.array([0, len(held)])), columns=columns)


def _groups(batch: pd.DataFrame, starts: np.ndarray) -> list[tuple[str, int, int, str]]:
    """Neighbours at all keys between ``starts``."""
    keys, letters, counts = (batch[c].tolist() for c in ("key", "letter", "n"))
    lasts, names = (batch["last"].tolist(), batch["name"].tolist()) if "name" in batch else (None, None)
    rows = []
    several = np.flatnonzero(np.diff(starts) > 1)
    for a, b in zip(starts[several].tolist(), starts[several + 1].tolist(), strict=True):
        here = names[a:b] if names else [word_at(keys[a], letter) for letter in letters[a:b]]
        rows += neighbours_at(lasts[a] if lasts else keys[a][-1], letters[a:b], counts[a:b], here)
    return rows


def scanned(index: DataFrame) -> DataFrame:
    """``name, n_near, near_n, near``: what ``neighbours_at`` says at every key of the sorted index."""
    ordered = index.repartition("key").sortWithinPartitions("key", F.col("letter") != "", F.col("n").desc(), "letter")
    return ordered.mapInPandas(_scan, "name string, n_near long, near_n long, near string")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``, for words with neighbours: their number, the most frequent one and its count."""
    named = words.filter(F.char_length("word") > LONG).select(F.sha2("word", 256).alias("ref"), "word", "n")
    found = scanned(rotations(words)).withColumnRenamed("name", "word")
    if not named.isEmpty():
        # rows of the long index name their words by digest; of equally frequent neighbours the texts decide
        longs = staged(scanned(named.mapInPandas(_long_rotations, "key string, last string, letter string, n long, name string")), "spelling-long")
        most = longs.groupBy("name").agg(F.sum("n_near").alias("n_near"), F.max("near_n").alias("near_n"))
        texts = named.select("ref", "word")
        tied = longs.select("name", "near_n", "near").distinct().join(texts.withColumnsRenamed({"ref": "near", "word": "text"}), "near")
        best = tied.groupBy("name", "near_n").agg(F.min("text").alias("near"))
        long = most.join(best, ["name", "near_n"]).join(texts.withColumnRenamed("ref", "name"), "name")
        found = found.unionByName(long.select("word", "n_near", "near_n", "near"))
    first = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    total = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best"))
    return total.select("word", "n_near", (-F.col("best.rank")).alias("near_n"), F.col("best.near").alias("near"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: where following the forms ends. Each round doubles the steps taken.

    Counts at least double from form to form, so there are no circles and a few rounds are enough.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        now = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` for every word of ``docs`` (``doc_id, text``).

    Null and empty texts have no words; a null id counts as the empty text in the checksum; repeated rows count
    repeatedly. Of equally frequent neighbours the first by code points is the form. No words: no rows.
    """
    words = staged(count_words(docs), "spelling-words")
    known = words.join(near_words(words), "word", "left")
    formed = F.col("near_n") >= TIMES * F.col("n")
    known = staged(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    rooted = known.join(last_forms(known.filter("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
