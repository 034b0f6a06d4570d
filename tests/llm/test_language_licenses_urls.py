"""Language, license and URL operators against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from llm_tables import clashing, none, odd  # noqa: F401
from pyspark.sql import functions as F

from erascope.llm import language, licenses, urls
from erascope.llm.common import table


def test_presence_kernel_counts_shared_ngrams():
    def grams(text):
        row = "".join(chr(int(s) + 48) for s in language.symbols(text))
        return {(n, row[i : i + n]) for n in (1, 2, 3) for i in range(len(row) - n + 1)}

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcéÉß Z.1") for _ in range(rng.randint(1, 40))) + "a" for _ in range(40)]
    for a, b in zip(texts, texts[1:], strict=False):
        x, y = np.unique(language.gram_codes(a)), np.unique(language.gram_codes(b))
        assert len(x) == len(grams(a)) and len(np.intersect1d(x, y)) == len(grams(a) & grams(b))
    assert language.symbols("Ab! é").tolist() == language.symbols(" aB  É ").tolist()


def test_held_out_accuracy(spark):
    docs = table(spark, MEDIUM, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() >= 0.99


def test_predictions_do_not_see_labels_or_ids(spark):
    docs = table(spark, SMALL, "documents")
    train = docs.filter(~language.held_out(F.col("doc_id")))
    changed = train.unionByName(docs.filter(language.held_out(F.col("doc_id"))).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(changed).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1]) for k in a)


def test_language_of_odd_rows(odd, none, clashing):
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count()
    by_text = {r["doc_id"]: r for r in rows}
    for i in (3, 4, 5, 7, 10):
        assert by_text[i]["lang_pred"] == "und" and by_text[i]["score"] == 0
    assert by_text[1]["lang_pred"] in {"en", "de", "fr"}
    assert language.identify(none).count() == 0 and language.keep_identified(none).count() == 0
    kept = language.keep_identified(clashing)
    assert kept.columns == clashing.columns and kept.count() == 8
    assert {r["found"] for r in kept.collect()} == {"found"}


def test_unlabelled_table_is_undetermined(odd):
    rows = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def brute_license(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, l) for p, l in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({l for _, l in places}))


def test_license_base_columns_match_brute_force(spark, odd):
    rng = random.Random(5)
    parts = "mit MIT license License. general public GNU apache, 2.0 the é\u00a0x under version 3 - mit-license".split(" ")
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [r["text"] for r in table(spark, SMALL, "documents").collect()] + [r["text"] for r in odd.collect()]
    for text in texts:
        got = licenses.scan(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_license(text)
        assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(","))) and 0 <= got["score"] <= 1


def test_keyword_gate_loses_no_match(spark):
    texts = [r["text"] for r in table(spark, MEDIUM, "documents").filter(F.lower("text").contains("licens")).collect()]
    texts += ["Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: Apache-2.0 OR MIT", "new BSD license; open software license v3.0"]
    for text in texts:
        words = text.encode().translate(licenses.WORDS).split()
        line = b" " + b" ".join(words) + b" "
        every = {(m.start(), m.end(), i) for i, r in enumerate(licenses.rules()) for m in r.regex.finditer(line)}
        kept = licenses.suppressed(sorted(every))
        order = licenses.rules()
        labels = {order[i].label for _, _, i in every if order[i].base} | {order[i].label for _, _, i in kept}
        assert licenses.scan(text)["labels"] == ",".join(sorted(labels))


def test_contained_detections_of_lower_priority_go():
    order = licenses.rules()
    high = next(i for i, r in enumerate(order) if r.priority == 85)
    low = next(i for i, r in enumerate(order) if r.priority == 30)
    assert licenses.suppressed([(2, 5, low), (0, 9, high)]) == [(0, 9, high)]
    assert licenses.suppressed([(0, 9, low), (2, 5, high)]) == [(0, 9, low), (2, 5, high)]
    assert licenses.suppressed([(0, 5, low), (3, 9, high)]) == [(0, 5, low), (3, 9, high)]
    assert licenses.suppressed([(0, 5, low), (0, 5, low)]) == [(0, 5, low)]
    assert len(order) > 300 and all(r.keywords for r in order)


def test_license_labels_of_known_texts():
    scan = lambda t: licenses.scan(t)["labels"]
    assert scan("Licensed under the Apache License, Version 2.0") == "apache,apache-2.0"
    assert scan("GNU Lesser General Public License v2.1") == "gpl,lgpl-2.1"
    assert scan("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert scan("we met under the apache trees in spring") == "apache" or scan("a clean text about a dog") == ""


def test_license_scan_of_tables(odd, none, clashing):
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(clashing).columns[0] == "doc_id"


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for name, verdict in urls.BASE_RULES:
        domain, _, start = name.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    return host, path, best


def test_urls_match_brute_force(spark):
    rng = random.Random(9)
    hosts = ["net", "a.net", "example.net", "EXAMPLE.com", "x.example.com", "notexample.net", "org", "b.org:80", "", "ads.example.org", "casino.x"]
    tails = ["", "/", "/en/1", "/de/", "/DE/x", "/fr/?q", "?/en/", "#/fr/", "/en", "//en/", "/ads/1/banner?x", "/a?affid=3", "/ads/policy/"]
    made = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', ':/', '://'])}{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(600)]
    made += [None, "", "://", "a://b://c/", "http://é.net/x"]
    rules = urls.all_rules()
    index = urls.RuleIndex(rules, {})
    for url in made:
        host, path, best = brute_url(url)
        got = index.judge(url)
        assert got[:2] == (host, path) and (got[2], got[3] if best else None) == (best or (None, None))
        lowered = urls.url_parts(url)[2]
        own = sorted((r for r in rules if not r.base and re.search(r.regex, lowered, re.DOTALL)), key=lambda r: (r.verdict != "allow", r.name))
        if not best:
            assert (got[3], got[4]) == ((own[0].verdict, own[0].name) if own else ("allow", None))


def test_rules_are_filed_under_their_rarest_token():
    rules = [urls.base_rule("example.net/en/", "allow"), urls.pattern_rule("/ads/*/banner^")]
    index = urls.RuleIndex(rules, {"example": 100, "net": 90, "en": 5, "ads": 3, "banner": 4})
    assert set(index.by_token) == {"en", "ads"} and not index.always
    assert urls.pattern_rule("banner*").tokens == () and urls.RuleIndex([urls.pattern_rule("banner*")], {}).judge("http://a/xbanner1")[3] == "block"


def test_url_tables(spark):
    pages = spark.createDataFrame([(1, None, "p"), (1, None, "p"), (None, "http://x.net/a", "p")], "page_id long, url string, host string")
    got = sorted((tuple(r)[:5] for r in urls.judge_urls(pages).collect()), key=repr)
    assert got == [(1, "", "", None, "allow"), (1, "", "", None, "allow"), (None, "x.net", "/a", "net/", "block")]
    assert urls.judge_urls(pages.limit(0)).count() == 0
