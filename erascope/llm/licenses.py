"""License scans with ordered signature rules.

A text is reduced to its words joined by single spaces. Several hundred regular expressions run over that, each
only if its keyword is among the words. Rules are ordered by priority: a detection is suppressed if it lies
within the interval of one of higher priority, or of an earlier and at least as long one of equal priority. What
stays gives the labels. The three base phrases are rules like the others, except that their places are counted
and their labels given whether or not a wider signature covers them.

The rules come from two tables written by hand: license families with their names and versions, and forms of
reference ("licensed under the ...", "spdx license identifier ...", and so on).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, names as regular expressions over lower-case words, versions (if any).
FAMILIES: list[tuple[str, str, str]] = [
    ("agpl", "(?:gnu )?affero general public license|gnu agpl|agpl", "1 3"),
    ("lgpl", "(?:gnu )?lesser general public license|(?:gnu )?library general public license|gnu lgpl|lgpl", "2 2.1 3"),
    ("gpl", "gnu general public license|gnu gpl|gpl", "1 2 3"),
    ("gfdl", "(?:gnu )?free documentation license|gfdl", "1.1 1.2 1.3"),
    ("apache", "apache(?: software)? license|apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla public license|mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public license|epl", "1.0 2.0"),
    ("cddl", "common development and distribution license|cddl", "1.0 1.1"),
    ("cpl", "common public license|cpl", "1.0"),
    ("eupl", "european union public licen[cs]e|eupl", "1.0 1.1 1.2"),
    ("osl", "open software license|osl", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free license|afl", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic license|artistic", "1.0 2.0"),
    ("bsl", "boost software license|bsl", "1.0"),
    ("busl", "business source license|busl", "1.1"),
    ("cecill", "cecill(?: free software)?(?: license)?", "1.0 1.1 2.0 2.1"),
    ("ofl", "sil open font license|open font license|ofl", "1.0 1.1"),
    ("psf", "python software foundation license|psf", "2"),
    ("php", "php license|php", "3.0 3.01"),
    ("zpl", "zope public license|zpl", "1.1 2.0 2.1"),
    ("apsl", "apple public source license|apsl", "1.0 1.1 1.2 2.0"),
    ("ncsa", "university of illinois ncsa open source license|ncsa open source license|ncsa", ""),
    ("cc-by", "creative commons attribution(?: international)?|cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: international)?|cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: international)?|cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: international)?|cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: international)?|cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: international)?|cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc0", "cc0|creative commons zero", "1.0"),
    ("odbl", "open (?:data commons open )?database license|odbl", "1.0"),
    ("wtfpl", "do what the fuck you want to public license|wtfpl", "1 2"),
    ("unlicense", "the unlicense|unlicense", ""),
    ("isc", "isc license|isc", ""),
    ("zlib", "zlib libpng license|zlib license|zlib", ""),
    ("mit", "mit license|expat license|mit", ""),
    ("bsd-0-clause", "(?:0|zero) clause bsd license|0bsd", ""),
    ("bsd-2-clause", "(?:2|two) clause bsd license|simplified bsd license|freebsd license|bsd 2 clause", ""),
    ("bsd-3-clause", "(?:3|three) clause bsd license|(?:new|revised|modified) bsd license|bsd 3 clause", ""),
    ("bsd-4-clause", "(?:4|four) clause bsd license|original bsd license|bsd 4 clause", ""),
    ("sspl", "server side public license|sspl", "1"),
    ("elastic", "elastic license", "2.0"),
    ("ms-pl", "microsoft public license|ms pl", ""),
    ("ms-rl", "microsoft reciprocal license|ms rl", ""),
    ("upl", "universal permissive license|upl", "1.0"),
    ("openssl", "openssl license|openssl", ""),
    ("postgresql", "postgresql license|postgresql", ""),
    ("curl", "curl license|curl", ""),
    ("vim", "vim license|vim", ""),
    ("ruby", "ruby license|ruby", ""),
    ("x11", "x11 license|x11", ""),
]
# Wording of the licenses' own texts: label, keyword, expression.
CLAUSES: list[tuple[str, str, str]] = [
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "copy", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", "endorse", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache", "apache", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "affero", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("proprietary", "reserved", "proprietary and confidential|confidential and proprietary all rights reserved"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"),
    ("ofl", "reserved", "with reserved font name"),
    ("bsl", "boost", "distributed under the boost software license"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("psf", "psf", "psf license agreement for python"),
]
# Forms of reference: how a name is framed, priority, confidence.
FORMS: list[tuple[str, int, float]] = [
    ("(?:licensed|released|distributed|available|published|covered|offered|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 80, 0.95),
    ("subject to (?:the )?(?:terms of )?(?:the )?{name}", 70, 0.9),
    ("under (?:the )?(?:terms of )?(?:the )?{name}", 60, 0.85),
    ("license (?:is )?(?:the )?{name}", 50, 0.8),
]
# Names that mean something else as well: they need a form of reference, or "license" behind them.
AMBIGUOUS = {"apache", "artistic", "php", "mit", "psf", "ruby", "vim", "curl", "x11", "zlib", "openssl", "postgresql", "isc"}
# Words that are too common to be a rule's keyword.
COMMON = set("a and by free general in is license licence of open public software source the this to under with".split())
# A-Z to a-z, digits and bytes above 127 as they are, anything else to a space.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: frozenset[bytes]  # every match has one of these words
    regex: re.Pattern
    priority: int
    score: float
    base: bool = False


def alternatives(names: str) -> list[str]:
    """The alternatives of an expression at its top level."""
    depth, parts = 0, [""]
    for c in names:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def keywords(names: str) -> frozenset[bytes]:
    """Of every alternative its longest word outside groups, common ones last."""
    chosen = set()
    for part in alternatives(names):
        flat = part
        while "(" in flat:  # innermost groups first, with what repeats them
            flat = re.sub(r"\([^()]*\)(?:\{[^}]*\}|[?*+])?", " ", flat)
        words = re.findall("[a-z0-9]+", re.sub(r"[a-z]*\[[^]]*\][a-z+*]*|[a-z]* ?\?[a-z]*", " ", flat))
        chosen.add(max(words, key=lambda w: (w not in COMMON, len(w))).encode())
    return frozenset(chosen)


def _rule(label: str, keys: frozenset[bytes], body: str, priority: int, score: float, base: bool = False) -> Rule:
    # whole words only: the text has one space between words and at both ends
    return Rule(label, keys, re.compile(rf"(?<= )(?:{body})(?= )".encode()), priority, score, base)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: by falling priority, then as written."""
    made = [_rule(label, frozenset([phrase.split()[0].encode()]), phrase, 40, 0.75, True) for phrase, label in BASE.items()]
    for label, names, versions in FAMILIES:
        every = keywords(names)
        sure = [n for n in alternatives(names) if n not in AMBIGUOUS]
        short = label.replace("-", " ")
        made.append(_rule(label, frozenset([b"spdx"]), f"spdx license identifier {short}(?: [0-9]+){{0,2}}(?: only| or later)?", 90, 1.0))
        for frame, priority, score in FORMS:
            made.append(_rule(label, every, frame.format(name=f"(?:{names})(?: license)?"), priority, score))
        for version in versions.split():
            number = version.replace(".", " ").removesuffix(" 0")
            exact = rf"(?:{'|'.join(sure)})(?: license)?(?: version| v)? v?{number}(?: 0)?"
            made.append(_rule(f"{label}-{version}", keywords("|".join(sure)), exact, 85, 0.95))
        full = [n for n in sure if "licen" in n or "commons" in n]
        if full:
            made.append(_rule(label, keywords("|".join(full)), "|".join(full), 30, 0.7))
    made += [_rule(label, frozenset([keyword.encode()]), body, 95, 1.0) for label, keyword, body in CLAUSES]
    return tuple(sorted(made, key=lambda r: -r.priority))


@cache
def by_keyword() -> dict[bytes, list[int]]:
    index: dict[bytes, list[int]] = defaultdict(list)
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            index[word].append(i)
    return dict(index)


def suppressed(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of detections ``start, end, rule`` those that no detection of an earlier rank contains.

    A detection outranks another by priority; at equal priority by an earlier start, a later end, an earlier
    rule. One sweep by start suffices, with the furthest end seen so far per priority.
    """
    order = rules()
    kept, furthest = [], dict[int, int]()
    for start, end, rule in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        priority = order[rule].priority
        if all(far < end for p, far in furthest.items() if p >= priority):
            kept.append((start, end, rule))
        furthest[priority] = max(furthest.get(priority, 0), end)
    return kept


def scan(text: str | None) -> dict:
    """All columns of the scan for one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    index = by_keyword()
    tried = sorted({i for w in index.keys() & set(words) for i in index[w]})
    line = b" " + b" ".join(words) + b" " if tried else b""
    order = rules()
    spans = [(m.start(), m.end(), i) for i in tried for m in order[i].regex.finditer(line)]
    base = [s for s in spans if order[s[2]].base]
    kept = suppressed(spans)
    first, last = (min(base)[0], max(base)[0]) if base else (0, 0)
    base_labels = {order[i].label for _, _, i in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": line.count(b" ", 0, first) - 1 if base else None,
        "last_word": line.count(b" ", 0, last) - 1 if base else None,
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | {order[i].label for _, _, i in kept})),
        "score": max((order[i].score for _, _, i in kept), default=0.0),
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``SCHEMA`` for every row of ``docs``.

    Null text counts as empty: no words, no places (null positions), empty label lists, score 0. Otherwise the
    score is the confidence of the surest detection that stays. Repeated rows each get a row.
    """

    @F.pandas_udf(SCHEMA)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = pd.DataFrame([scan(t) for t in texts], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scanned.asNondeterministic()("text").alias("found")).select("doc_id", "found.*")
