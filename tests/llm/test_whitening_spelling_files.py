"""Whitening, spelling variants and token files against brute force, exact sums and the tokenizer library."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import MEDIUM, SMALL
from llm_tables import DOCUMENTS, WORDS, clashing, none, odd, rows_of  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from erascope.llm import spelling, token_files, whitening
from erascope.llm.common import table
from erascope.session import scratch_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


# --- whitening


def steps_of(vector, width):
    x = [int(min(max(np.floor(64 * float(c)), -(2.0**52)), 2.0**52)) + 1_000_000 for c in vector]
    return x + [1_000_000] * (width - len(x))


def brute_whitening(rows, most=32):
    """Rows by component from the whole list of vectors, in exact sums and one dense eigenproblem."""
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in sound)
    x = [steps_of(v, width) for _, v in sound]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return [i for i, _ in sound], n, deviation, centred, values, vectors, np.trace(covariance)


def compare_whitening(df, rows, most=32, tolerance=1e-8):
    ids, n, deviation, centred, values, vectors, trace = brute_whitening(rows, most)
    found = df.collect()
    assert len(found) == len(ids) * len(values)
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter((i, k + 1) for i in ids for k in range(len(values)))
    expected = defaultdict(list)
    for place, i in enumerate(ids):
        expected[i].append((deviation[place], centred[place]))
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and 0 <= errors.pop() <= 1e-4
    signs = {}
    for r in found:
        k = r["component"] - 1
        assert r["n"] == n
        assert r["deviation"] in {d if d < 1 << 63 else None for d, _ in expected[r["vec_id"]]}
        assert r["explained"] == pytest.approx(max(values[k], 0) / trace if trace else 0, rel=1e-4, abs=1e-12)
        if len(expected[r["vec_id"]]) == 1 and r["whitened"] is not None and abs(r["whitened"]) > 1e-6:
            want = expected[r["vec_id"]][0][1] @ vectors[:, k] / np.sqrt(values[k])
            sign = signs.setdefault(k, np.sign(want * r["whitened"]))
            assert r["whitened"] == pytest.approx(sign * want, abs=tolerance)
    return found


def test_whitening_matches_brute_force(spark):
    rows = table(spark, MEDIUM, "embeddings")
    compare_whitening(whitening.whiten(rows), [(r["vec_id"], r["embedding"]) for r in rows.collect()], tolerance=1e-6)


def test_whitening_of_copies_and_hot_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 5).tolist(), 1) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0, 0.0], 1) for i in range(300)]  # a third and more in one vector
    rows += [(2000 + i, rows[i][1], 1) for i in range(50)]
    df = spark.createDataFrame(rows, VECTORS)
    single = [(i, [float(np.float32(c)) for c in v]) for i, v, _ in rows]
    found = compare_whitening(whitening.whiten(df, components=3), single, most=3)
    by_id = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert all(by_id[2000 + i, k] == by_id[i, k] for i in range(50) for k in (1, 2, 3))
    # copies make no difference if each distinct vector weighs one
    once = {(r["vec_id"], r["component"]): (r["whitened"], r["n"]) for r in whitening.whiten(df, components=3, by_copies=False).collect()}
    distinct = {(r["vec_id"], r["component"]): (r["whitened"], r["n"]) for r in whitening.whiten(df.filter("vec_id <= 1000"), components=3).collect()}
    assert len(once) == 750 * 3
    for key, (value, n) in distinct.items():
        assert once[key][1] == n and abs(once[key][0]) == pytest.approx(abs(value), abs=1e-9)


def test_whitening_of_odd_tables(spark):
    rows = [
        (1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (None, [0.5, -2.0, 1.0], None), (2, None, 1), (3, [1.0, None, 2.0], 1),
        (4, [1.0, NAN, 2.0], 1), (5, [INF, 1.0, 2.0], 1), (6, [], 1), (7, [-0.7], 1), (8, [1e30, 0.0, -1e30], 1), (9, [0.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("white", F.lit(3)).withColumn("v", F.lit(4))
    found = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in found) == {1: 6, None: 3, 6: 3, 7: 3, 8: 3, 9: 3}
    assert {r["n"] for r in found} == {7} and all(r["identity_error"] <= 1e-4 for r in found)
    assert {r["vec_id"] for r in found if r["deviation"] is None} == {1, None, 6, 7, 8, 9}  # beyond a long
    compare_whitening(whitening.whiten(df.filter("vec_id <> 8 OR vec_id IS NULL")), [(i, v) for i, v, _ in rows if i != 8])
    same = whitening.whiten(df.filter("vec_id = 1")).collect()  # no variance at all
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same] == [(None, 0.0, 0, 0.0)] * 6
    for empty in (df.filter("vec_id = 2"), df.filter("vec_id = 6"), df.limit(0)):
        assert whitening.whiten(empty).collect() == []
        assert whitening.whiten(empty).schema.simpleString().startswith("struct<vec_id:bigint,component:int,n:bigint,deviation:bigint")


def test_exact_deviations():
    steps = np.array([[2**40, -3], [5, 7]], np.int64)
    rest = [1, 2]
    assert whitening.squared_deviations(steps, 3, rest) == [None, (15 - 1) ** 2 + (21 - 2) ** 2]
    assert whitening.squared_deviations(steps[1:], 3, rest) == [(15 - 1) ** 2 + (21 - 2) ** 2]


# --- spelling


def brute_words(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return long[at + 1 :] == short[at:]


def brute_variants(words):
    near = defaultdict(list)
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_size[size] if one_edit(w, v)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def variant_rows(docs):
    return rows_of(spelling.spelling_variants(docs))


def test_spelling_matches_brute_force_on_documents(spark):
    docs = table(spark, SMALL, "documents")
    words = brute_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(words) > 1000
    assert variant_rows(docs) == brute_variants(words)


def test_spelling_of_close_words(spark):
    """Few letters, so that words have many neighbours, equal letters in a row and chains of forms."""
    rng = random.Random(3)
    letters = "abÀé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(700)]
    texts = [" ".join(rng.choice(words[: 1 + k % 700]) for _ in range(40)) for k in range(300)]
    texts += ["aaaaa aaaaaa aaaaaaa " * 3, "Abbbb-ABBBB.abbbb,abbbbb abbbbb abbbbb"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    expected = brute_variants(brute_words(list(enumerate(texts))))
    assert len({r[2] for r in expected if r[1]}) > 3 and any(r[1] and r[2] != r[1] for r in expected)
    assert variant_rows(docs) == expected
    assert variant_rows(docs.repartition(7)) == expected


def test_spelling_of_long_words(spark):
    """Around the length from which prefixes stand as fingerprints, and far beyond."""
    rng = random.Random(9)
    words = []
    for size in (63, 64, 65, 66, 67, 300):
        word = "".join(rng.choice("abé") for _ in range(size))
        words += [word, word[:-1], word[1:], word[:30] + "z" + word[31:], word[:30] + "y" + word[31:], word[:20] + "zz" + word[20:], word + word[-1]]
    words += ["x" * 5000, "x" * 5001, "x" * 2500 + "y" + "x" * 2499]
    texts = [" ".join(words)] * 3 + [" ".join(words[::2])] * 4 + [" ".join(words[::3])] * 5
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    expected = brute_variants(brute_words(list(enumerate(texts))))
    assert sum(r[4] for r in expected if len(r[0]) > 64) > 20
    assert variant_rows(docs) == expected


def test_spelling_with_a_hot_word(spark):
    texts = ["spring " * 500 + "sprong sprang springs sprin"] * 40 + [f"word{chr(97 + i % 26)}ing sprung" for i in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    assert variant_rows(docs) == brute_variants(brute_words(list(enumerate(texts))))


def test_spelling_of_odd_tables(spark, odd, none, clashing):  # noqa: F811
    three = odd.unionAll(odd).unionAll(odd)
    expected = brute_variants(brute_words([(r["doc_id"], r["text"]) for r in three.collect()]))
    assert expected and variant_rows(three) == expected
    extra = clashing.withColumn("word", F.lit("x")).withColumn("form", F.lit("y")).withColumn("n", F.lit(0)).withColumn("name", F.lit("z"))
    assert variant_rows(extra.unionAll(extra).unionAll(extra)) == expected
    assert variant_rows(none) == [] and variant_rows(odd.filter("doc_id = 5")) == []


# --- token files


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(BYTES)
    made.no_truncation()
    made.no_padding()
    return made


ODD_TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b ", "\n\n x\n y", "don't we'll 'tis I'M", "1234 5,678.90", "tab\there \t x",
    "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>  y <|endoftext|>\n", "ünï çödé École", "Größe²³ ¼ ª º", "日本語 テキスト", "a b  c",
    "é e", "😀 😀😀", "\x1c x\x1d \x85 y", "word" * 5000, "ab " * 20_000, "a\r\nb \r\n c", "''' 's s' '", "x\u0000 y", "__init__ a_b--c",
]


def test_encoder_equals_the_library(library):
    with open(BYTES, encoding="utf-8") as file:
        encoder = token_files.IdEncoder(file.read())
    assert encoder.cuts and encoder.kind == "<u2"
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice(" \n\t'as1.,é²x  日") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == expected


def expected_rows(library, rows):
    start, found = 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_files_give_back_every_document(spark, library):
    docs = table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(docs.repartition(5), BYTES, folder, file_bytes=100_000)
    manifest = token_files.manifest_of(spark, folder).orderBy("part").collect()
    assert len(manifest) > 3 and [m["first_id"] for m in manifest] == sorted(m["first_id"] for m in manifest)
    found = sorted(tuple(r) for r in token_files.token_checksums(spark, folder).collect())
    assert found == sorted(expected_rows(library, rows))
    wanted = [rows[3][0], rows[50][0], -5]
    few = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, folder, wanted).collect()}
    assert few == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i in wanted}
    # the dictionary pays on short documents, and a file says which one it needs
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["content"])
    with token_files.TokenFile(folder, manifest[0]["file"], dictionary) as file:
        assert file.ids(1).tolist() == [*library.encode(dict(rows)[int(file.doc_ids[1])] or "", add_special_tokens=False).ids, 2]
    assert dictionary
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(folder, manifest[0]["file"], b"other")


def test_files_of_odd_tables(spark, library, odd, none, clashing):  # noqa: F811
    def sums(docs):
        return sorted((tuple(r) for r in token_files.round_trip(docs, BYTES).collect()), key=lambda r: r[1])

    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = sums(clashing.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(2)))
    expected = expected_rows(library, rows)
    assert [r[0] for r in found] == [r[0] for r in expected] and [r[0] for r in found][:2] == [None, None]
    # rows with equal ids may stand in either order
    assert Counter((r[0], *r[2:]) for r in found) == Counter((r[0], *r[2:]) for r in expected)
    assert [r[1] for r in found] == [sum(r[2] for r in found[:i]) for i in range(len(found))]
    assert sums(none) == []
    texts = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(ODD_TEXTS)], DOCUMENTS)
    assert sums(texts) == expected_rows(library, list(enumerate(ODD_TEXTS)))


def test_files_with_a_hot_id_are_spread(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(" ".join(WORDS)).alias("text"), F.lit("en").alias("lang"),
        F.lit("a").alias("source"), F.lit(1).alias("n_chars"),
    )
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, BYTES, folder, file_bytes=10_000)
    manifest = token_files.manifest_of(spark, folder).collect()
    assert sum(m["n_docs"] for m in manifest) == 3000 and max(m["n_docs"] for m in manifest) < 1500
    assert token_files.read_token_files(spark, folder, [7]).count() == 2000


def test_manifest_decides_what_counts(spark, odd):  # noqa: F811
    """A file that no manifest lists, as an interrupted attempt leaves it, is not read."""
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(odd, BYTES, folder)
    before = rows_of(token_files.token_checksums(spark, folder))
    system, root = token_files._file_system(folder)
    with system.open_output_stream(f"{root}/data/part-000000-left.ids") as out:
        out.write(b"half a file")
    assert rows_of(token_files.token_checksums(spark, folder)) == before


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        encoder = token_files.IdEncoder(file.read())
    assert not encoder.cuts
    made = Tokenizer.from_file(path)
    texts = ["Hello  World", "", "it's"]
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == [made.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_that_come_again_are_encoded_once():
    """A piece is looked up once per place and encoded when it is new; what is asked for again outlives its generation."""
    asked = []
    pieces = token_files.Pieces(3, lambda piece: asked.append(piece) or piece.encode())
    for i in range(9):
        assert b"".join(map(pieces.__getitem__, ["the", f"w{i}", f"v{i}"])) == f"thew{i}v{i}".encode()
        pieces.shrink()
        assert len(pieces) < 3 and len(pieces.before) <= 3
    assert asked.count("the") == 1 and len(asked) == 19


def test_texts_of_all_kinds_share_their_pieces():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        content = file.read()
    encoder = token_files.IdEncoder(content)
    encoder.pieces.size = 4
    texts = ["the cat", "the мир cat", "<|endoftext|> the", "", "  a\n\n b", "the 你好 cat's <|endoftext|>", "мир the cat"]
    for some in (texts, texts[::-1], texts[:2]):
        assert encoder.encode(some) == encoder.ids(some)
