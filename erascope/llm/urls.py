"""URL filters: pattern rules that are looked up by their rarest literal token.

A rule is written as a pattern: ``||`` anchors it at a host or one of its parent domains, ``~`` asks for a word
of the host between dots and hyphens, ``*`` is any text and ``^`` a separator or the end. Every rule is filed under the one of its literal tokens that is rarest in the
table's URLs. The tokens of a URL fetch the rules filed under them, and only those run their regular
expression. Base rules name a host and the start of a path; the longest one that fits decides. Without one,
the method's own rules do: an exception allows, a block rule blocks, and anything else is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
# The base rules of the contract.
BASE_RULES = [("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW)]
# The method's own rules: advertising, tracking, gambling, adult and download traps; "@@" marks an exception.
PATTERNS = """
||doubleclick.net^
||googlesyndication.com^
||adnxs.com^
||taboola.com^
||outbrain.com^
||popads.net^
||criteo.com^
||scorecardresearch.com^
/adserver/
/adsense/
/ads/*/banner^
/ad-frame/
/affiliate/*/click^
/sponsored-links/
/popunder.
/trackback/
/tracking/pixel^
/beacon/*.gif^
^affid=
^clickid=
^adurl=
^utm_medium=cpc^
^gclid=
/online-casino/
/free-slots/
/sports-betting/
/poker-bonus/
/xxx-video/
/adult-chat/
/escort-service/
/cracked-software/
/keygen-download/
/warez/
/payday-loan/
/cheap-viagra/
/wp-login.php^
/xmlrpc.php^
/phpmyadmin/
~casino
~bets
~betting
~poker
~jackpot
~pills
~viagra
~pharmacy
~adult
~porn
~xxx
~escort
~spam
~ads
~adserver
~warez
~payday
@@/ads/policy/
@@/help/*^affid=
@@/docs/adsense/
""".split()
TOKEN = re.compile("[a-z0-9]+")
UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    base: bool
    regex: str
    tokens: tuple[str, ...]


def base_rule(text: str, verdict: str) -> Rule:
    """A host with its subdomains and the start of a path, matched on host and path put together."""
    return Rule(text, verdict, True, r"^(?:[^/]*\.)?" + re.escape(text), tuple(TOKEN.findall(text)))


def pattern_rule(text: str) -> Rule:
    """A pattern over everything behind ``://`` in lower case; its tokens are those that end at a separator on both sides."""
    body = text.removeprefix("@@")
    if body.startswith("~"):
        word = body.removeprefix("~")
        return Rule(text, BLOCK, False, rf"^(?:[^/?#]*[.-])?{re.escape(word)}(?:[.:/?#-]|$)", (word,))
    anchored = body.startswith("||")
    body = body.removeprefix("||")
    pieces = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
    regex = (r"^(?:[^/?#]*\.)?" if anchored else "") + "".join(pieces.get(c, re.escape(c)) for c in body)
    whole = []
    for m in TOKEN.finditer(body):
        before = body[m.start() - 1] if m.start() else "^" if anchored else "*"
        after = body[m.end()] if m.end() < len(body) else "*"
        if "*" not in (before, after):
            whole.append(m.group())
    return Rule(text, ALLOW if text.startswith("@@") else BLOCK, False, regex, tuple(whole))


def all_rules() -> list[Rule]:
    return [*(base_rule(*r) for r in BASE_RULES), *(pattern_rule(p) for p in PATTERNS)]


def url_parts(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lowered), path, and all that stands behind ``://`` in lower case; empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(UPPER), rest[end:stop], rest.translate(UPPER)


class RuleIndex:
    """Rules filed under their rarest token; those without a token are tried on every URL."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules:
            key = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t), default="")
            self.by_token.setdefault(key, []).append((rule, re.compile(rule.regex, re.DOTALL)))
        self.always = self.by_token.pop("", [])

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """``host, path, rule, verdict, pattern`` of a URL."""
        host, path, lowered = url_parts(url)
        tokens = set(TOKEN.findall(lowered))
        tried = [*self.always, *(r for t in tokens & self.by_token.keys() for r in self.by_token[t])]
        fitting = [r for r, regex in tried if regex.search(host + path if r.base else lowered)]
        base = max((r for r in fitting if r.base), key=lambda r: len(r.name), default=None)
        if base:
            return host, path, base.name, base.verdict, None
        own = min((r for r in fitting if not r.base), key=lambda r: (r.verdict != ALLOW, r.name), default=None)
        return host, path, None, own.verdict if own else ALLOW, own.name if own else None


def token_frequency(urls: DataFrame, url: Column, rules: list[Rule]) -> dict[str, int]:
    """How many URLs have each token that a rule has; as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    lowered = F.translate(F.substring_index(url, "://", -1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = urls.select(F.explode(F.array_distinct(F.split(lowered, "[^a-z0-9]+"))).alias("token"))
    counted = tokens.filter(F.col("token").isin(wanted)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["token"]: r["n"] for r in counted}


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for every row of ``pages`` (``page_id, url``).

    A null URL, or one without ``://``, has empty parts and is allowed. Repeated rows each get a row.
    ``pattern`` names the method's own rule that decided, null where a base rule or none did.
    """
    rules = all_rules() if rules is None else rules
    shared = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules, token_frequency(pages, F.col("url"), rules)))

    @F.pandas_udf("host string, path string, rule string, verdict string, pattern string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([shared.value.judge(u) for u in urls], columns=["host", "path", "rule", "verdict", "pattern"])

    return pages.select("page_id", judge.asNondeterministic()("url").alias("found")).select("page_id", "found.*")
