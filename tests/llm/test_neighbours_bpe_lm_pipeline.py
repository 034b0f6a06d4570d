"""Neighbours, byte-pair encoding, language model and pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import MEDIUM, SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import clashing, none, odd, rows_of  # noqa: F401
from pyspark.sql import functions as F
from test_near_copies import kept_ids
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from erascope.llm import bpe, language, mixing_lm, mixture, neighbours, pii
from erascope.llm.common import table
from erascope.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ENCODER = bpe.Encoder(bpe.read_vocabulary(PATH))


def test_neighbours_recall_and_scores(spark):
    vectors = table(spark, MEDIUM, "embeddings")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids, rows = list(data), np.stack(list(data.values()))
    got = neighbours.nearest_neighbours(vectors, F.col("vec_id") % 10 == 0).toPandas()
    hit = total = 0
    for query in [i for i in ids if i % 10 == 0]:
        own = got[got["query_id"] == query].sort_values("rank")
        cosine = rows @ data[query] / (np.linalg.norm(rows, axis=1) * np.linalg.norm(data[query]))
        cosine[ids.index(query)] = -2
        best = [ids[i] for i in np.lexsort((ids, -cosine))[:5]]
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and query not in own["vec_id"].tolist()
        assert own["score"].tolist() == pytest.approx([cosine[ids.index(v)] for v in own["vec_id"]], abs=1e-12)
        assert own["score"].is_monotonic_decreasing
        hit += len(set(best) & set(own["vec_id"]))
        total += 5
    assert hit / total >= 0.9


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    known = rng.integers(0, 1 << 16, (500, neighbours.PARTS)).astype(np.uint16)
    known[250:] = known[:250] ^ (1 << rng.integers(0, 16, (250, neighbours.PARTS))).astype(np.uint16)
    block = neighbours.Block(known)
    for radius in (0, 3, 8, 17, 40, 60, 128):
        for code in known[::50]:
            assert block.within(code, radius).tolist() == np.flatnonzero(neighbours.hamming(known, code) <= radius).tolist()


def test_blocks_and_chunks_do_not_lose_neighbours(spark):
    vectors = table(spark, SMALL, "embeddings")
    cut = neighbours.Settings(block_rows=40, chunk_rows=3)
    whole = {(r["query_id"], r["rank"]): r["score"] for r in neighbours.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect()}
    parts = {(r["query_id"], r["rank"]): r["score"] for r in neighbours.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, cut).collect()}
    assert parts.keys() == whole.keys() and all(parts[k] >= whole[k] - 1e-12 for k in whole)


def test_repeated_ids_and_rows_are_candidates(spark):
    """Only the query's own row is none: against every other row, by brute force."""
    rng = np.random.default_rng(4)
    pool = rng.normal(size=(6, 4))
    rows = [(int(rng.integers(0, 5)), pool[rng.integers(0, 6)].tolist()) for _ in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest_neighbours(frame, F.col("vec_id") == 0, neighbours.Settings(block_rows=9, chunk_rows=2)).collect())
    want = []
    for i, (name, v) in enumerate(rows):
        if name == 0:
            others = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), n) for j, (n, w) in enumerate(rows) if j != i]
            want += [(0, k + 1, n, -c) for k, (c, n) in enumerate(sorted(others)[:5])]
    assert [(q, r, n, round(c, 9) + 0.0) for q, r, n, c in got] == [(q, r, n, c + 0.0) for q, r, n, c in sorted(want)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0])]
    rows += [(6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0, 0.0]), (10, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("key", F.lit("x"))
    got = [tuple(r) for r in neighbours.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    # both rows of id 0 ask, and each finds the other one
    assert sorted(got) == sorted(2 * [(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 3, 0.0)])
    assert neighbours.nearest_neighbours(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest_neighbours(frame.filter("vec_id = 0").dropDuplicates(["vec_id"]), F.lit(True)).count() == 0


def encoded(texts):
    return [ids for _, ids, _ in ENCODER.encode(texts)]


def by_library(texts):
    return [" ".join(map(str, e.ids)) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aeinrstlothé ñüßΣσİ'’.,!?0129\n\t 中😀́<|endof>", max_size=60), max_size=8))
def test_encoding_is_the_library_s(texts):
    texts += ["<|endoftext|>".join(texts), " <|startoftext|>"]
    got = encoded(texts)
    assert got == by_library(texts)
    ids = [[int(i) for i in g.split()] for g in got]
    assert [ENCODER.decode(i) for i in ids] == LIBRARY.decode_batch(ids, skip_special_tokens=False)


def test_encoding_of_long_and_random_words():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlcumwfgypbvk") for _ in range(rng.randint(1, 16))) for _ in range(20_000)]
    words += ["x" * 30_000, "ab" * 5_000, "é" * 3_000, "!" * 2_000]
    assert encoded(words) == by_library(words)


def test_encoding_of_every_assigned_character():
    import unicodedata

    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for i in range(0, len(points), 8192):
        texts = [f"A{chr(c)}b {chr(c)}" for c in points[i : i + 8192]]
        assert encoded(texts) == by_library(texts)


def test_encoded_tables(spark, odd, none, clashing):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for (i, _), e in zip(texts, LIBRARY.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        decoded = LIBRARY.decode(e.ids, skip_special_tokens=False)
        want.append((i, len(e.ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, e.ids)), decoded))))
    assert rows_of(bpe.encode_documents(docs, PATH)) == sorted(want, key=repr)
    assert bpe.encode_documents(none, PATH).count() == 0
    kept = clashing.select("doc_id", bpe.encoded(clashing, PATH, keep_ids=True).alias("e")).select("doc_id", "e.ids", "e.decoded_sha256")
    back = kept.select("*", F.sha2(bpe.decoded(kept, PATH), 256).alias("again"))
    assert back.filter("again <> decoded_sha256").count() == 0 and back.count() == clashing.count()


def test_base_scores_match_brute_force(spark, odd):
    docs = table(spark, SMALL, "documents").unionByName(odd)
    rows = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b""]) for r in docs.collect()]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        ((i, held[i], len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in rows),
        key=repr,
    )
    scored = mixing_lm.score_documents(docs)
    got = scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()
    key = lambda r: (repr(r[0]), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-4)


def test_model_learns_and_is_a_distribution(spark):
    docs = table(spark, MEDIUM, "documents")
    rows = mixing_lm.score_documents(docs).toPandas()
    assert len(rows) == docs.count() and (rows["score"] <= 0).all()
    held = rows[rows["held_out"]]
    bits = -held["score"].sum() * math.log2(10)
    sizes = {r["doc_id"]: len(b" ".join(r["text"].encode().split())) + 2 for r in docs.collect()}
    assert bits / sum(sizes[i] for i in held["doc_id"]) < 2.6  # bits per byte of texts not seen
    shuffled = docs.filter("doc_id < 40").withColumn("text", F.reverse("text"))
    worse = mixing_lm.score_documents(docs.filter("doc_id >= 40").unionByName(shuffled)).filter("doc_id < 40").toPandas()
    better = rows[rows["doc_id"] < 40]
    assert worse["score"].sum() < 1.15 * better["score"].sum()


def test_token_probabilities_sum_to_at_most_one():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    counted = Counter(words)
    ones, all_ = np.zeros(mixing_lm.TOTAL), np.zeros(mixing_lm.TOTAL)
    names = sorted(counted)
    times = np.array([counted[w] for w in names])
    mixing_lm.count_bits(names, times, ones, all_)
    assert all_[0:256].sum() == 8 * sum((len(w) + 1) * counted[w] for w in names)
    model = mixing_lm.learn(ones, all_, names, times, int(times.sum()), mixing_lm.Settings())
    every = [b"", *(bytes(w) for n in (1, 2, 3) for w in np.stack(np.meshgrid(*[list(b"abc")] * n), -1).reshape(-1, n).astype(np.uint8))]
    chance = np.exp(mixing_lm.log_probabilities(model, every))
    assert 0.5 < chance.sum() <= 1
    count, behind = mixing_lm.seen_before(np.array([3, 3, 1, 3, 3, 1]), np.array([4, 2]))
    assert count.tolist() == [0, 1, 0, 2, 0, 0] and behind.tolist() == [0, 1, 2, 3, 0, 1]


def test_blocks_do_not_change_scores(spark):
    docs = table(spark, SMALL, "documents")
    whole = {r["doc_id"]: r for r in mixing_lm.score_documents(docs).collect()}
    parts = {r["doc_id"]: r for r in mixing_lm.score_documents(docs, mixing_lm.Settings(block_bytes=20_000)).collect()}
    assert whole.keys() == parts.keys()
    assert all(parts[k][c] == pytest.approx(whole[k][c]) for k in whole for c in ("n_tokens", "n_known", "base_score", "score"))


def test_scores_without_training_rows(spark, none):
    assert mixing_lm.score_documents(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = mixing_lm.score_documents(spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")).orderBy("n_tokens").collect()
    assert [r["n_tokens"] for r in row] == [1, 3] and all(r["n_known"] == r["train_tokens"] == 0 and r["base_score"] == 0 for r in row)
    assert row[1]["score"] == pytest.approx(5 * 8 * math.log10(0.5), rel=0.01)


def test_pipeline_matches_its_parts(spark):
    """Every stage by brute force on its own input, from what the stage before gave."""
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    kept = corpus_pipeline.language(spark, docs, SMALL)
    assert rows_of(kept) == rows_of(docs.filter(F.col("text").rlike(r"\p{L}")))
    single = corpus_pipeline.near_duplicates(spark, kept, SMALL)
    assert rows_of(single) == rows_of(kept.filter(F.col("doc_id").isin(kept_ids([(r["doc_id"], r["text"]) for r in kept.collect()]))))
    clean = corpus_pipeline.personal_data(spark, single, SMALL)
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in pii.find_personal_data(single).collect()}
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        want, at = "", 0
        for kind, start, end in spans[r["doc_id"]]:  # overlapping spans go as one, under the first one's kind
            if int(start) >= at:
                want += texts[r["doc_id"]][at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        want += texts[r["doc_id"]][at:]
        assert (r["text"], r["n_chars"]) == (want, len(want))
    mixed = corpus_pipeline.mixture(spark, clean, SMALL)
    times = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixture.mix(clean).collect()})
    assert Counter(r["doc_id"] for r in mixed.collect()) == +times
    for df in (kept, single, clean, mixed):
        assert df.columns == columns and df.schema.simpleString() == docs.schema.simpleString()
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in rows) == +times
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_of_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == odd.columns
        found = corpus_pipeline.tokens(spark, docs, SMALL)
        assert found.columns[0] == "doc_id" and found.count() >= 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert [len([n for n in names if n.startswith(f"op{i}_")]) for i in range(1, 14)] == [1] * 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mix", "bpe_encoding"]
    assert language.UNKNOWN == "und"


def test_weights_come_from_every_training_token():
    """Also from long tokens and from those that a sample by frequency would miss, by as often as they occur."""
    rng = random.Random(9)
    names = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 5))) for _ in range(200)} | {b"x" * 200})
    times = np.array([rng.randint(1, 50) for _ in names])
    counts = tuple(np.zeros(mixing_lm.TOTAL) for _ in range(2))
    mixing_lm.count_bits(names, times, *counts)
    losses = []

    def added_up(add, shape, model):
        total = np.zeros(shape)
        half = len(names) // 2
        for part in (slice(None, half), slice(half, None)):  # as two tasks would
            add(total, model, mixing_lm.halves(*counts), names[part], times[part])
        if shape == mixing_lm.MOMENTS:
            losses.append(total[:, 0].sum())
        else:
            assert total[0].sum() == pytest.approx(8 * sum((len(n) + 1) * t for n, t in zip(names, times, strict=True)))
        return total

    two = mixing_lm.fit(mixing_lm.log_odds(*counts), added_up, mixing_lm.Settings(rounds=4))
    one = mixing_lm.learn(*counts, names, times, int(times.sum()), mixing_lm.Settings(rounds=4))
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
    for name in ("by_place", "by_byte", "refined"):
        assert np.allclose(getattr(one, name), getattr(two, name), atol=1e-4)


def test_shares_adapt_to_the_text_so_far():
    words, sizes = np.array([0, 0, 0, 0, 1, 2, 3, 4]), np.array([4, 4])
    got = mixing_lm.mixed_shares(np.full(8, 1e-4), words, sizes, np.full(8, 1e-3), mixing_lm.first_shares(100, 20))
    alone = mixing_lm.mixed_shares(np.full(4, 1e-4), words[4:], sizes[1:], np.full(4, 1e-3), mixing_lm.first_shares(100, 20))
    assert (np.diff(got[:4]) > 0).all() and got[4:] == pytest.approx(alone) and got[7] > got[5]
    assert mixing_lm.first_shares(0, 0).tolist() == [0, 0, 1]
