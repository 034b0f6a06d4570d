"""The pipeline's near-duplicate stage against brute force over all pairs of texts."""

import random

import numpy as np
from conftest import SMALL
from llm_tables import DOCUMENTS, clashing, none, odd, rows_of  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from erascope.llm import near_copies, simhash
from erascope.llm.common import table


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def kept_ids(rows):
    """Smallest id of each group that pairs at 0.8 connect."""
    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (not a and not b) or len(a & b) >= 0.8 * max(len(a | b), 1):
                low, high = sorted((group[i], group[j]))
                group = {n: low if g == high else g for n, g in group.items()}
    return sorted(set(group.values()))


def stage_ids(spark, docs):
    return sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCUMENTS)


def test_similarity():
    a, b = "one two three four five six", "One two three\tfour five six seven"
    assert near_copies.similarity(near_copies.shingle_set(a), near_copies.shingle_set(b)) == 2 / 3
    assert len(near_copies.shingle_set("one two")) == 1 and near_copies.shingle_set(" ").tolist() == []
    assert near_copies.minima(np.zeros(0, np.uint64)).tolist() == []


def test_stage_matches_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    assert stage_ids(spark, docs) == kept_ids([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_planted_near_copies_go(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    texts = []
    for changes in (1, 3, 5, 7, 9, 12):
        words = [word() for _ in range(300)]
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for at in rng.sample(range(300), changes):
                other[at] = word()
            texts.append(" ".join(other))
    want = kept_ids(list(enumerate(texts)))
    assert stage_ids(spark, frame(spark, texts)) == want and 6 <= len(want) < 16


def test_chain_of_copies_is_one_group(spark):
    """Neighbours in the chain are similar, its ends share little: later rounds must join what the first does not."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*[f"x{i}" for i in range(10 * n)], *words[10 * n :]]) for n in range(30)]
    want = kept_ids(list(enumerate(texts)))
    assert want == [0] and stage_ids(spark, frame(spark, texts)) == want


def shared_passage(rows, shared=60, own=70, seed=3):
    """Texts that share a passage and little else, and a near copy of every tenth."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(7))
    passage = [word() for _ in range(shared)]
    texts = [" ".join(passage + [word() for _ in range(own)]) for _ in range(rows)]
    return texts + [t.rsplit(" ", 2)[0] for t in texts[::10]]


def test_pairs_grow_with_the_texts_that_share_a_passage(spark, monkeypatch):
    """Not with their square, and the near copies among them are found."""
    tried = []
    whole = near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, *rest: tried.append(pairs.count()) or whole(pairs, *rest))
    for rows in (200, 800):
        tried.clear()
        texts = shared_passage(rows)
        assert stage_ids(spark, frame(spark, texts)) == list(range(rows))
        assert sum(tried) < 20 * rows and tried[-1] < rows / 10


def test_two_groups_in_the_same_buckets(spark):
    """Two large groups of near copies that share half of their words, and one text similar to both."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for half in ("a", "b"):
        words = base[:120] + [f"{half}{i}" for i in range(80)]
        for _ in range(40):
            other = list(words)
            other[rng.randrange(200)] = f"z{rng.random()}"
            texts.append(" ".join(other))
    assert stage_ids(spark, frame(spark, texts)) == kept_ids(list(enumerate(texts)))


def variants(rows, changes, seed=5):
    """A text of 150 words, and texts that replace some of its words at random places."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(rows):
        other = list(base)
        for at in rng.sample(range(150), rng.choice(changes)):
            other[at] = f"z{rng.random()}"
        texts.append(" ".join(other))
    return texts


def test_fingerprints_link_texts(spark, monkeypatch):
    """Without any bucket, texts whose fingerprints are within two bits of each other are still found."""
    monkeypatch.setattr(near_copies, "band_keys", lambda sign: F.array(F.col("print")))
    rng = random.Random(2)
    base = [f"w{i}" for i in range(2000)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join([*base, *base]), " ".join(f"v{rng.random()}" for _ in range(2000)), "", " "]
    prints = [simhash.majority(simhash.shingle_hashes(t, near_copies.SHINGLE)) for t in texts]
    assert all((p ^ prints[0]).bit_count() <= simhash.RADIUS for p in prints[1:3]) and len(set(prints[:3])) > 1
    assert stage_ids(spark, frame(spark, texts)) == [0, 3, 4]


def test_rare_pairs_hold_every_similar_pair(spark):
    texts = variants(60, range(7)) + shared_passage(30, 60, 20) + [" ".join(f"w{i}" for i in range(n)) for n in (3, 5, 6, 20, 24, 25, 121, 122, 150)]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    found = near_copies.rare_pairs(
        spark.createDataFrame([r[:2] for r in rows], "print long, root long"), spark.createDataFrame(rows, "print long, root long, text string")
    )
    sets = [shingles(t) for t in texts]
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) >= 0.8 * len(a | b)}
    pairs = {tuple(r) for r in found.collect()}
    assert len(want) > 500 and want <= pairs and len(pairs) < 2 * len(want)


def test_variants_of_one_text_that_are_not_similar_do_not_meet(spark, monkeypatch):
    tried = []
    whole = near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, *rest: tried.append(pairs.count()) or whole(pairs, *rest))
    for rows in (80, 240):
        tried.clear()
        texts = variants(rows, (5, 6))
        assert stage_ids(spark, frame(spark, texts)) == kept_ids(list(enumerate(texts)))
        assert tried[-1] < rows


def test_odd_rows(spark, clashing, none):
    kept = near_copies.keep_one_of_near_copies(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 8, 9, 10, 2**60 + 1] and ids.count(None) == 1
    assert near_copies.keep_one_of_near_copies(none).count() == 0
    assert kept.filter(F.col("doc_id").isNull()).first()["text"] == "le chat et le chien"
