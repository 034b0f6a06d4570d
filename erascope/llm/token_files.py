"""Token ids in binary files with a shared zstandard dictionary.

A folder holds data files in ascending order of document ids and a manifest, a Parquet table with one row per data
file. A data file is

* a header: magic, version, bytes per id, sha256 of the dictionary,
* one zstandard frame per document, compressed on its own with the shared dictionary,
* the index: per document its id, whether the id is null, the end of its frame and the end of its ids (both counted
  from the start of the file),
* a footer: place of the index, number of documents, magic.

So a reader finds a short document with the index and one small read. The dictionary is trained on slices of id
arrays drawn from all documents by a hash, whose number is a parameter; it changes the size of the files only. Data
files carry a name of their own per attempt and count only once the manifest, which Spark commits, lists them: what a lost
executor leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from erascope.llm.common import staged
from erascope.session import scratch_path

END_ID = 2
FILE_BYTES = 32 << 20  # of ids before compression in a data file
SAMPLE = 4096  # slices that the dictionary is trained on
SLICE_IDS = 512  # ids of such a slice
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BATCH_LETTERS = 1 << 20  # letters that are encoded at once
KNOWN = 400_000  # pieces of a generation that a worker keeps (see ``Pieces``)

HEADER, FOOTER = "<8sHH32s", "<qq8s"
HEADER_SIZE, FOOTER_SIZE = struct.calcsize(HEADER), struct.calcsize(FOOTER)
MAGIC, VERSION = b"TOKENIDS", 1

# The byte-level rule always cuts before a space that stands behind a letter.
WORD_START = re.compile(r"(?<=\S)(?= )")
# Letters whose kind has never changed, and the byte-level rule for cutting them (fixed value, on these letters).
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
PRINTABLE = re.compile("[ -~]*")
# The letter that stands for each byte in a byte-level vocabulary (fixed value): printable Latin-1 as it is, the rest from U+0100 on.
AS_IT_IS = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {byte: chr(256 + i) for i, byte in enumerate(b for b in range(256) if b not in AS_IT_IS)}
SPACE = LETTERS[32]


class Pieces(dict):
    """Ids by piece of text; what is not kept is encoded when it is asked for. Pure speed, results do not depend on it.

    Of two generations of at least ``size`` pieces the older one goes; what is asked for again moves to the younger.
    """

    def __init__(self, size: int, encode: Callable[[str], bytes]):
        super().__init__()
        self.size, self.encode = size, encode
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids

    def shrink(self) -> None:
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()


class IdEncoder:
    """Ids of texts as little-endian bytes, by the tokenizers library, which encodes each distinct piece of text once.

    Tokenizers with other rules than the byte-level one encode whole texts.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(content)
        rule = parts.get("pre_tokenizer") or {}
        added = parts["added_tokens"]
        self.cuts = (
            rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space", True)
            and not parts.get("normalizer") and not parts["model"].get("dropout") and parts["model"]["type"] == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)
        )
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.kind = f"<u{id_width(content)}"
        self.code = {2: "H", 4: "I"}[id_width(content)]
        self.pieces = Pieces(KNOWN, self.piece)
        if self.cuts:
            # the library's own model, for pieces that are cut already
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["model"]["merges"]]
            self.model = models.BPE(parts["model"]["vocab"], merges, cache_capacity=0)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, text: str) -> bytes:
        """Ids of a piece that no rule cuts any further and that holds no special token."""
        letters = text.replace(" ", SPACE) if PRINTABLE.fullmatch(text) else text.encode().decode("latin-1").translate(LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def cut(self, text: str) -> list[str]:
        """Pieces of a text that are encoded apart.

        Texts of plain letters are cut by the rule. Others are cut before the spaces where the rule always cuts, and what is
        between is a piece of its own unless its letters are plain; so is what holds a special token.
        """
        if self.plain(text):
            return PIECES.findall(text)
        pieces: list[str] = []
        for chunk in WORD_START.split(text):
            if self.plain(chunk):
                pieces += PIECES.findall(chunk)
            else:
                pieces.append(chunk)
        return pieces

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not (self.marks and self.marks.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.ids(texts)
        plain = [self.plain(t) for t in texts]
        split = [PIECES.findall(t) if p else self.cut(t) for t, p in zip(texts, plain, strict=True)]
        # pieces that the model alone cannot encode occur in other texts only
        others = set().union(*(ps for ps, p in zip(split, plain, strict=True) if not p))
        whole = [p for p in others if p not in self.pieces and not self.plain(p)]
        self.pieces.update(zip(whole, self.ids(whole), strict=True))
        encoded = [b"".join(map(self.pieces.__getitem__, ps)) for ps in split]
        self.pieces.shrink()
        return encoded


def id_width(content: str) -> int:
    """Bytes of an id: two where all ids of the vocabulary fit."""
    parts = json.loads(content)
    ids = [*parts["model"]["vocab"].values(), *(t["id"] for t in parts["added_tokens"])]
    return 2 if max(ids, default=0) < 1 << 16 else 4


def _batches(texts: list[str]) -> Iterator[list[str]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_LETTERS:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


_ENCODERS: dict[str, IdEncoder] = {}


def _encoder(content: str) -> IdEncoder:
    """One encoder per worker process and vocabulary, so that words are remembered between tasks."""
    name = hashlib.sha256(content.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = IdEncoder(content)
    return _ENCODERS[name]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row of ``docs``: all ids with the end id, as bytes. Null text counts as empty."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    width = id_width(content)
    end = end_id.to_bytes(width, "little")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value)
        for batch in batches:
            start = 0
            for texts in _batches(batch["text"].tolist()):
                ids = [row + end for row in encoder.encode(texts)]
                names = batch["doc_id"].iloc[start : start + len(texts)]
                yield pd.DataFrame({"doc_id": names, "n_tokens": [len(row) // width for row in ids], "ids": ids})
                start += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(encode, "doc_id string, n_tokens long, ids binary")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids")


def train_dictionary(tokens: DataFrame, width: int, sample: int = SAMPLE) -> bytes:
    """A dictionary from ``sample`` slices of all id arrays of ``row, n_tokens, ids``, drawn by a hash; empty if they are too few.

    Every slice of every document has the same chance; the share that is drawn follows from their number.
    """
    slices = F.ceil(F.col("n_tokens") / SLICE_IDS)
    total = tokens.agg(F.sum(slices)).first()[0] or 0
    share = min(1.0, 2 * sample / total) if total else 0.0
    limit = int(share * ((1 << 63) - 1))
    size = SLICE_IDS * width

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = []
            for row, ids in zip(batch["row"], batch["ids"], strict=True):
                for at in range(0, len(ids), size):
                    place = xxhash.xxh64_intdigest(struct.pack("<qq", row, at), 0) >> 1
                    if place <= limit:
                        drawn.append((place, ids[at : at + size]))
            yield pd.DataFrame(drawn, columns=["place", "ids"])

    drawn = tokens.select("row", "ids").mapInPandas(draw, "place long, ids binary").orderBy("place").limit(sample)
    samples = [bytes(r["ids"]) for r in drawn.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""  # the samples are too few or too short


def _file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder; Hadoop's names of stores are also understood."""
    if folder.startswith(("s3a://", "s3n://")):
        folder = "s3://" + folder[6:]
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pyarrow.fs.FileSystem.from_uri(folder)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


class TokenFile:
    """One data file, open for reading: documents in order or one by one."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        system, root = _file_system(folder)
        self.file = system.open_input_file(f"{root}/{name}")
        magic, version, self.width, wanted = struct.unpack(HEADER, self.file.read_at(HEADER_SIZE, 0))
        size = self.file.size()
        self.index_at, self.n_docs, closing = struct.unpack(FOOTER, self.file.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
        if magic != MAGIC or closing != MAGIC or version != VERSION:
            raise ValueError(f"{name} is not a file of token ids")
        if wanted != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        index = self.file.read_at(size - FOOTER_SIZE - self.index_at, self.index_at)
        n = self.n_docs
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.ends = np.frombuffer(index, "<i8", n, 8 * n)
        self.id_ends = np.frombuffer(index, "<i8", n, 16 * n)
        self.nulls = np.frombuffer(index, "u1", n, 24 * n).astype(bool)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, place: int) -> np.ndarray:
        """Ids of the document at ``place``: one read of its frame."""
        start = int(self.ends[place - 1]) if place else HEADER_SIZE
        frame = self.file.read_at(int(self.ends[place]) - start, start)
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")

    def places(self, doc_id: int) -> range:
        """Places of the documents with this id; the ids ascend, null ids come first."""
        known = int(self.nulls.sum())
        low = known + int(np.searchsorted(self.doc_ids[known:], doc_id, "left"))
        return range(low, known + int(np.searchsorted(self.doc_ids[known:], doc_id, "right")))

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


MANIFEST = "part int, file string, n_docs long, n_ids long, first_id long, last_id long, bytes long"


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all rows of ``docs`` (``doc_id, text``) to ``folder``, in ascending order of ``doc_id``.

    Null ids come first; rows with equal ids follow one another in the order of their ids' hash and, where texts are equal too,
    in any order. ``folder`` must lie in a store that pyarrow's file systems reach. An empty table has a manifest without rows.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        width = id_width(file.read())
    tokens = staged(tokenized(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    dictionary = train_dictionary(tokens, width)
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())], "content binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")
    system, root = _file_system(folder)
    system.create_dir(f"{root}/data", recursive=True)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-total * width // file_bytes))
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        name = f"data/part-{part:06d}-{uuid.uuid4().hex}.ids"
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True)
        out, at, read = None, HEADER_SIZE, 0
        doc_ids, nulls, ends, id_ends = [], [], [], []
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], batch["ids"], strict=True):
                if out is None:
                    store, place = _file_system(folder)
                    out = store.open_output_stream(f"{place}/{name}")
                    out.write(struct.pack(HEADER, MAGIC, VERSION, width, hashlib.sha256(shared.value).digest()))
                frame = compressor.compress(ids)
                out.write(frame)
                at, read = at + len(frame), read + len(ids) // width
                doc_ids.append(0 if doc_id is None else int(doc_id))
                nulls.append(doc_id is None)
                ends.append(at)
                id_ends.append(read)
        if out is None:
            return
        for values in (doc_ids, ends, id_ends):
            out.write(np.array(values, "<i8").tobytes())
        out.write(np.array(nulls, "u1").tobytes())
        out.write(struct.pack(FOOTER, at, len(ends), MAGIC))
        size = out.tell()
        out.close()
        known = [i for i, null in zip(doc_ids, nulls, strict=True) if not null]
        bounds = [str(known[0]), str(known[-1])] if known else [None, None]
        yield pd.DataFrame([[part, name, len(ends), read, *bounds, size]], columns=[c.split()[0] for c in MANIFEST.split(", ")])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("row")]
    ranged = tokens.repartitionByRange(files, *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    schema = MANIFEST.replace("first_id long", "first_id string").replace("last_id long", "last_id string")
    manifest = ranged.mapInPandas(write, schema)
    manifest.withColumn("first_id", F.col("first_id").cast("long")).withColumn("last_id", F.col("last_id").cast("long")).write.parquet(f"{folder}/manifest")


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """The data files of ``folder`` with ``start``: the number of ids in all files before. One row per file."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(spark: SparkSession, folder: str, columns: dict, schema: str, wanted: list[int] | None = None) -> DataFrame:
    """Rows of the data files with what ``columns`` make of a document's ids; only the ``wanted`` ids if given."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["content"])
    shared = spark.sparkContext.broadcast(dictionary)
    files = manifest_of(spark, folder)
    if wanted is not None:
        hits = [F.col("first_id").isNotNull() & F.lit(w).between(F.col("first_id"), F.col("last_id")) for w in wanted]
        files = files.filter(F.exists(F.array(*hits), lambda h: h)) if hits else files.limit(0)
    count = files.count()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"], strict=True):
                with TokenFile(folder, name, shared.value) as file:
                    places = range(file.n_docs) if wanted is None else [p for w in sorted(set(wanted)) for p in file.places(w)]
                    for some in range(0, len(places), 1024):
                        rows = []
                        for p in places[some : some + 1024]:
                            ids = file.ids(p)
                            before = int(file.id_ends[p - 1]) if p else 0
                            rows.append([None if file.nulls[p] else str(file.doc_ids[p]), int(start) + before, len(ids), *[f(ids) for f in columns.values()]])
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", *columns])

    spread = files.select("file", "start").repartition(max(1, count))
    found = spread.mapInPandas(read, f"doc_id string, start long, n_tokens long, {schema}")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_token_files(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents in ``folder``; ``start`` counts the ids of all documents before.

    With ``wanted`` only the documents with these ids are read, by the index of the files that may hold them.
    """
    return _read(spark, folder, {"ids": lambda ids: ids.astype(np.int64)}, "ids array<long>", wanted)


def token_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in ``folder``: crc32 of the ids as little-endian 32-bit integers."""
    return _read(spark, folder, {"ids_crc32": lambda ids: zlib.crc32(ids.astype("<u4").tobytes())}, "ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read ``token_checksums`` back; see ``write_token_files``."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, folder)
    return token_checksums(docs.sparkSession, folder)
