"""Byte-pair encoding and decoding with the vocabulary of a tokenizer file (word ends marked, lower case).

The distinct words of a slice of texts form a trie, which is walked depth first. Every node keeps the last
token of the encoding of its prefix: the vocabulary entry ending there that may follow the last token
of what is left of it. Two tokens may follow each other if encoding their joined text gives the two back, and
an encoding is right exactly if each of its neighbours may follow each other. The states of a shared prefix
are computed once, a word costs at most the longest token's length per letter, and texts look their words up:
the number of tokens, their ids as text and their names, which are all that is joined per text.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from erascope.llm.common import Memory

END = "</w>"
# The file's own rule for cutting a text into words (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same rule for lower-case texts of letters that have no other form and whose kind has never changed.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SLICE = 2 << 20  # letters of text whose words share a trie
REMEMBERED = 250_000  # words of either kind kept between slices (see ``Memory``)
Joined = tuple[int, str, str]  # number of tokens, their ids and their names, each joined by one space


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """The parts of the tokenizer file that encoding needs, small enough to send to every worker."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    return {
        "ids": content["model"]["vocab"],
        "merges": [tuple(m) for m in content["model"]["merges"]],
        "special": {t["content"]: t["id"] for t in content["added_tokens"]},
    }


class Encoder:
    """Encodes words by walking their trie; remembers what it has encoded."""

    def __init__(self, vocabulary: dict):
        self.ids: dict[str, int] = {k: v for k, v in vocabulary["ids"].items() if k not in vocabulary["special"]}
        self.ranks = {pair: i for i, pair in enumerate(vocabulary["merges"])}
        self.special: dict[str, int] = vocabulary["special"]
        self.token_of = {v: k for k, v in self.ids.items()} | {v: k for k, v in self.special.items()}
        self.inner: dict[str, str | None] = {}
        self.final: dict[str, str | None] = {}
        for token in self.ids:
            marked = token.endswith(END) and token != END
            letters = token[: -len(END)] if marked else token
            ends = self.final if marked else self.inner
            for i in range(1, len(letters)):
                ends.setdefault(letters[i:])
            ends[letters] = token
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})
        self.may_follow: dict[tuple[str, str], bool] = {}
        self.names = [self.token_of.get(i, "") for i in range(max(self.token_of) + 1)]
        self.numbers = [str(i) for i in range(len(self.names))]
        self.words = Memory(REMEMBERED)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging, best rank first and leftmost; used on the text of two tokens only."""
        while len(symbols) > 1:
            ranked = [(self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))]
            rank, at = min(ranked)
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else [*token]

    def fits(self, before: str, token: str) -> bool:
        """Whether ``token`` may follow ``before``; an empty ``before`` asks whether it may stand alone."""
        key = (before, token)
        known = self.may_follow.get(key)
        if known is None:
            if len(self.may_follow) > 200_000:
                self.may_follow.clear()
            want = [before, token] if before else [token]
            known = self.may_follow[key] = self.merged([*self.symbols(before), *self.symbols(token)] if before else self.symbols(token)) == want
        return known

    def last_token(self, path: str, depth: int, ends: dict[str, str | None], tokens: list[str]) -> str:
        """Last token of the encoding of ``path[:depth]``; ``tokens`` has those of the shorter prefixes.

        Walks back while the letters still end some entry of the vocabulary; ``ends`` has all such endings,
        with the entry's name where the ending is one itself.
        """
        found, start = [], depth - 1
        while start >= 0:
            ending = path[start:depth]
            if ending not in ends:
                break
            token = ends[ending]
            if token:
                found.append((tokens[start], token))
            start -= 1
        known = self.may_follow
        for key in reversed(found):
            if known[key] if key in known else self.fits(*key):
                return key[1]
        raise ValueError(f"the vocabulary lacks the letter {path[depth - 1 : depth]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, Joined]:
        """The tokens of each distinct word."""
        found = {}
        rows = sorted((w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters), w) for w in words)
        tokens, last = [""], ""  # tokens[d]: last token of the first d letters of the path to the current node
        for path, word in rows:
            shared = 0
            for a, b in zip(path[: len(tokens) - 1], last, strict=False):
                if a != b:
                    break
                shared += 1
            del tokens[min(shared, len(path) - 1) + 1 :]
            while len(tokens) < len(path):
                tokens.append(self.last_token(path, len(tokens), self.inner, tokens))
            parts = [self.last_token(path, len(path), self.final, tokens)]
            at = len(path) - (len(parts[0]) - len(END))
            while at:
                parts.append(tokens[at])
                at -= len(tokens[at])
            parts.reverse()
            found[word] = (len(parts), " ".join([self.numbers[self.ids[p]] for p in parts]), " ".join(parts))
            last = path
        return found

    def split(self, text: str | None) -> list[str]:
        """Words of a text, and special tokens in their own spelling, in order."""
        pieces = self.cut.split(text or "") if self.cut else [text or ""]
        words: list[str] = []
        for i, piece in enumerate(pieces):
            if i % 2:
                words.append(piece)
            elif PLAIN.fullmatch(piece):
                words += PLAIN_WORDS.findall(piece.lower())
            else:
                # lower case letter by letter: the final sigma has no form of its own here
                words += WORDS.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return words

    def encode(self, texts: list[str | None]) -> Iterator[Joined]:
        """Number of tokens, ids as text and decoded text of each text."""
        split = [self.split(t) for t in texts]
        needed = {w for ws in split for w in ws}
        words, missing = self.words.known(needed - self.special.keys())
        fresh = self.encode_words(missing)
        self.words.keep(fresh)
        words |= fresh
        for name in needed & self.special.keys():
            words[name] = (1, self.numbers[self.special[name]], name)
        for ws in split:
            yield joined([words[w] for w in ws])

    def decode(self, ids: Iterable[int]) -> str:
        """Token texts joined by one space, as a tokenizer without a decoder does; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if 0 <= i < len(self.names)])


def joined(parts: list[Joined]) -> Joined:
    """The words of a text in one."""
    if not parts:
        return 0, "", ""
    counts, ids, names = zip(*parts, strict=True)
    return sum(counts), " ".join(ids), " ".join(names)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def encoded(docs: DataFrame, path: str, keep_ids: bool = False) -> Column:
    """A struct column for the column ``text``: ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    Null counts as empty; a text without words has no tokens and both digests are those of the empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if keep_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))

    @F.pandas_udf(StructType(fields))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for texts in batches:
            # a slice at a time goes back, so that a worker never holds the ids of a whole batch
            for part in _slices(list(texts)):
                rows = []
                for count, ids, text in encoder.encode(part):
                    row = [count, _digest(ids), _digest(text)]
                    rows.append([*row, np.fromstring(ids, np.int32, sep=" ")] if keep_ids else row)
                yield pd.DataFrame(rows, columns=[f.name for f in fields])

    return encode.asNondeterministic()("text")


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> Column:
    """The decoded text of a column of token ids; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for rows in batches:
            yield pd.Series([None if r is None else encoder.decode(int(i) for i in r) for r in rows], dtype=object)

    return decode(ids)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and vocabulary, so that words are remembered between tasks."""
    key = hash(tuple(shared.value["merges"][-64:])) ^ len(shared.value["ids"])
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``."""
    return docs.select("doc_id", encoded(docs, path).alias("found")).select("doc_id", "found.*")
