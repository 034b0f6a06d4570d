"""Personal data by weak supervision, with DataFrame operations only.

Candidates are spans found by regular expressions: the strict patterns of the four base kinds, and wider ones
(matches that fail their check, phone numbers without a plus sign, spelled-out addresses, access keys). Five
labelers look at each candidate and say yes, no or nothing: its format, its check digits or shape, a gazetteer,
the words before it, and what it touches. Candidates are counted by kind and answers; expectation-maximisation
over these counts estimates how reliable each labeler is, and a logistic classifier learns from the resulting
probabilities. Base spans always stay; other candidates stay if the classifier says so and no base span overlaps.

The counts have at most ``3 ** 5`` answers and four length classes per kind, whatever the corpus, so fitting on
them is a few thousand numbers on the driver; all candidates of all documents are counted.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erascope.llm.common import spare_name, staged

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
CONTEXT = 40  # characters before a candidate that the context labeler reads

# The base patterns. Possessive runs and the look-behinds keep them linear on long runs of one sort of
# character; they find the same matches as the plain forms, since a run that fails at its start fails behind it.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+){1,6}",
    "phone": r"(?<![0-9+().-])(?<![0-9+]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+.@-])[A-Za-z0-9_/+-]{16,512}+(?![A-Za-z0-9_/+@-])",
}
# What a text must contain for the patterns of a kind to run at all.
GATES = {"email": "@", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Word lists of the labelers (fixed values).
CUES = {
    "email": "e-?mail|mail|contact|write to|adresse|correo|courriel",
    "ip": r"ip|addr(?:ess)?|host|server|client|ping|subnet",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|whatsapp|contact",
    "secret": r"password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key|credential|bearer|auth",
}
COUNTER_CUES = {
    "email": "git clone",
    "ip": r"version|release|v\.?|section|chapter|rev",
    "card": "isbn|issn|order|invoice|serial|doi",
    "phone": "isbn|issn|order|invoice|serial",
    "secret": "sha-?(?:1|256)|md5|commit|checksum|digest|uuid",
}
GAZETTEERS = {
    "email": r"\.(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|de|fr|es|it|uk|us|ca|eu|ch|at|nl|be|pt|pl|se|no|dk|fi|ie|in|jp|cn|br|mx|au)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)[1-9]",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)",
    "phone": r"^(?:\+(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_|pk_|sk-|xox[abpr]-|AIza|ya29|eyJ)",
}


def found(text: Column, kind: str, pattern: str, strict: bool) -> Column:
    """All matches as an array of ``start, order, end, kind, match, before, strict``; offsets count code points.

    The pieces between the matches give the offsets: a match starts where the lengths so far add up to.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,match:string,before:string,strict:boolean>>")

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        one = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), end.alias("end"), F.lit(kind).alias("kind"),
            pair["match"].alias("match"), F.right(pair["piece"], F.lit(CONTEXT)).alias("before"), F.lit(strict).alias("strict"),
        )
        grown = F.when(pair["match"].isNull(), done["spans"]).otherwise(F.concat(done["spans"], F.array(one)))
        return F.struct(F.coalesce(end, start).alias("at"), grown.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    every = F.aggregate(pairs, start, step, lambda done: done["spans"])
    gate = F.contains(text, F.lit(GATES[kind])) if strict and kind in GATES else F.rlike(text, F.lit(pattern))
    return F.when(gate, every).otherwise(empty)


def passes(span: Column) -> Column:
    """The checks of the base kinds on a match of their own pattern."""
    digits = F.regexp_replace(span["match"], "[^0-9]", "")
    return span["strict"] & (
        F.when(span["kind"] == "ip", span["match"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(span["kind"] == "card", F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False)))
        .when(span["kind"] == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _per_kind(span: Column, patterns: dict[str, str], value: Column) -> Column:
    first, *rest = KINDS
    said = F.when(span["kind"] == first, value.rlike(patterns[first]))
    for kind in rest:
        said = said.when(span["kind"] == kind, value.rlike(patterns[kind]))
    return said


def answers(span: Column) -> Column:
    """The labelers' answers and the length class as an array of names: ``y``, ``n`` or ``-`` behind a letter each."""
    digits = F.length(F.regexp_replace(span["match"], "[^0-9]", ""))
    before = F.lower(span["before"])
    mixed = span["match"].rlike("[0-9]") & span["match"].rlike("[A-Za-z]") & (digits >= 2)
    shape = (
        F.when(span["kind"] == "secret", mixed)
        .when(span["kind"] == "email", span["match"].rlike(r"\.[A-Za-z]{2,24}$|(?i)dot"))
        .when(span["kind"] == "phone", digits.between(10, 13))
        .when(span["kind"] == "card", digits.between(15, 16))
        .otherwise(digits.between(4, 12))
    )
    plain = span["match"].rlike("^[A-Za-z/-]+$")
    form = F.when(passes(span), "y").when(span["strict"] | plain, "n").otherwise("-")
    listed = _per_kind(span, GAZETTEERS, span["match"])
    # gazetteers of key prefixes are far from complete: a miss says nothing
    gazetteer = F.when(listed, "y").when(span["kind"] == "secret", "-").otherwise("n")
    cue = F.when(_per_kind(span, {k: rf"\b(?:{v})\W{{0,12}}$" for k, v in CUES.items()}, before), "y").when(
        _per_kind(span, {k: rf"\b(?:{v})\W{{0,6}}$" for k, v in COUNTER_CUES.items()}, before), "n"
    ).otherwise("-")
    touches = F.when(span["before"].rlike(r"[\p{L}\p{N}_]$"), "n").when(span["before"].rlike(r"[=:\"'(\[<]\s?$"), "y").otherwise("-")
    size = F.least(F.floor(F.length(span["match"]) / 12), F.lit(3)).cast("string")
    named = {"f": form, "s": F.when(shape, "y").otherwise("n"), "g": gazetteer, "c": cue, "t": touches}
    return F.array(*[F.concat(F.lit(k), v) for k, v in named.items()], F.concat(F.lit("l"), size))


def candidates(text: Column) -> Column:
    """All candidates of a text in order, as ``start, order, end, kind, base, answers``; base ones first where equal."""
    text = F.coalesce(text, F.lit(""))
    spans = F.concat(*[found(text, k, p, True) for k, p in STRICT.items()], *[found(text, k, p, False) for k, p in WIDER.items()])
    described = F.transform(
        spans,
        lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"], F.coalesce(passes(s), F.lit(False)).alias("base"), answers(s).alias("answers")),
    )
    return F.array_sort(described)


def fit(spans: DataFrame) -> dict[str, float]:
    """Weights by feature name, from the candidates in the column ``spans`` of all documents."""
    every = spans.select(F.explode("spans").alias("s"))
    counts = every.groupBy("s.kind", F.array_join("s.answers", " ").alias("answers")).agg(F.count(F.lit(1)).alias("n"))
    return train(estimate([(r["kind"], tuple(r["answers"].split()), r["n"]) for r in counts.collect()]))


def estimate(counts: list[tuple[str, tuple[str, ...], int]], rounds: int = 60) -> list[tuple[str, tuple[str, ...], int, float]]:
    """Probability that candidates with these answers are personal data, by expectation-maximisation per kind.

    Labelers are taken as independent given the truth. Prior counts that favour right answers keep the two
    classes from changing places and make a kind without candidates harmless.
    """
    done = []
    # the format labeler has check digits and octets to go by: it is trusted as far as many candidates would show
    prior = {
        truth: [{"y": w, "n": 1.0, "-": 4.0} if truth else {"y": 1.0, "n": w, "-": 4.0} for w in (400.0, 8.0, 8.0, 8.0, 8.0)]
        for truth in (True, False)
    }
    for kind in KINDS:
        rows = sorted((a, n) for k, a, n in counts if k == kind)
        total = sum(n for _, n in rows)
        share = 0.5
        says: dict[tuple[bool, int], dict[str, float]] = {
            (truth, j): {v: w / sum(p[j].values()) for v, w in p[j].items()} for truth, p in prior.items() for j in range(5)
        }
        chances: list[float] = []
        for _ in range(rounds):
            chances = []
            for a, _n in rows:
                odds = math.log(share / (1 - share)) + sum(math.log(says[True, j][a[j][1]] / says[False, j][a[j][1]]) for j in range(5))
                chances.append(1 / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
            share = (1 + sum(p * n for p, (_, n) in zip(chances, rows, strict=True))) / (2 + total)
            for truth, weights in prior.items():
                for j in range(5):
                    sums = defaultdict(float, weights[j])
                    for p, (a, n) in zip(chances, rows, strict=True):
                        sums[a[j][1]] += n * (p if truth else 1 - p)
                    whole = sum(sums.values())
                    says[truth, j] = {v: sums[v] / whole for v in "yn-"}
        done += [(kind, a, n, p) for p, (a, n) in zip(chances, rows, strict=True)]
    return done


def train(rows: list[tuple[str, tuple[str, ...], int, float]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Logistic weights per kind and answer, and per kind, fitted to the estimated probabilities by gradient steps.

    Counts are damped by their square root, so that a frequent answer does not drown the rest.
    """
    weights: dict[str, float] = {}
    for kind in KINDS:
        own = [(a, math.sqrt(n), p) for k, a, n, p in rows if k == kind]
        whole = sum(n for _, n, _ in own) or 1.0
        w: dict[str, float] = defaultdict(float)
        for _ in range(rounds):
            slope: dict[str, float] = defaultdict(float)
            for a, n, p in own:
                z = w["bias"] + sum(w[x] for x in a)
                error = n / whole * (p - 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
                for x in ("bias", *a):
                    slope[x] += error
            for x, g in slope.items():
                w[x] += rate * (g - decay * w[x])
        weights |= {f"{kind} {x}": v for x, v in w.items()}
    return weights


def decided(spans: Column, weights: dict[str, float]) -> Column:
    """Of the candidates: the base spans and those the classifier accepts that no base span overlaps, in order."""
    known = F.create_map(*[F.lit(x) for pair in sorted({"": 0.0, **weights}.items()) for x in pair])

    def accepted(s: Column) -> Column:
        names = F.concat(F.array(F.lit("bias")), s["answers"])
        logit = F.aggregate(names, F.lit(0.0), lambda z, name: z + F.coalesce(F.try_element_at(known, F.concat_ws(" ", s["kind"], name)), F.lit(0.0)))
        return s["base"] | (logit > 0)

    chosen = F.filter(spans, accepted)
    overlaps = F.filter(chosen, lambda s: s["base"])
    free = F.filter(
        F.transform(chosen, lambda s: s),
        lambda s: s["base"] | ~F.exists(overlaps, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return free


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda found: found == kind


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    Null text counts as empty: no spans, and the digest of the empty text. Repeated rows each get a row; equal
    texts get equal spans. ``spans`` may have kinds beyond the base ones (``secret``).
    """
    narrow = staged(docs.select("doc_id", candidates(F.col("text")).alias("spans")), "pii-candidates")
    weights = fit(narrow)
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    digest = F.sha2(joined(base), 256).alias("base_sha256")
    return narrow.select("doc_id", *counts, digest, joined(decided(F.col("spans"), weights)).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with every span, in order of start, replaced by its kind in brackets; what overlapping spans cover goes under the first one's kind."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        piece = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        grown = F.concat(done["parts"], F.array(piece, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        fresh = s["start"] >= done["at"]
        return F.struct(
            F.greatest(s["end"], done["at"]).alias("at"), F.when(fresh, grown).otherwise(done["parts"]).alias("parts")
        )

    rest = F.aggregate(spans, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.lit(2147483647))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` masked; every row stays, other columns as they are, null stays null."""
    name = spare_name(docs, "spans")
    weights = fit(staged(docs.select(candidates(F.col("text")).alias("spans")), "pii-candidates"))
    spanned = docs.withColumn(name, decided(candidates(F.col("text")), weights))
    masked = spanned.withColumn("text", mask(F.col("text"), F.col(name)))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])
