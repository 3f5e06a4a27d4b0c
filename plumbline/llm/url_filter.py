"""URL filter: rules by host and path, and a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that reject alone, terms that reject together, and the rules of production.
STRICT = ("casino", "cheap-pills", "escorts", "link-farm", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "click", "coupon", "crack", "dating", "deal", "discount", "free", "keygen", "loan", "lottery", "pills", "poker", "promo", "replica", "sale", "spam", "torrent", "win")
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LOWER = {c: c + 32 for c in range(65, 91)}


def host_path(url: str | None) -> tuple[str, str]:
    """Host after the first :// (A-Z lower-cased) and path up to ? or #; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


class UrlJudge:
    """Rules fit a host and its subdomains when the path starts with theirs; the longest one wins. Else the vocabulary decides."""

    def __init__(self, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, rules: Sequence[tuple[str, str]] = RULES, soft_hits: int = 2):
        self.soft_hits, self.rules = soft_hits, {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.rules.setdefault(host, []).append(("/" + path, rule, verdict))
        self.terms = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                self.terms.add_word(term, (kind, term))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        fits, tail = [], host
        while tail:
            fits += [(len(rule), rule, verdict) for start, rule, verdict in self.rules.get(tail, ()) if path.startswith(start)]
            _, dot, tail = tail.partition(".")
        return max(fits)[1:] if fits else None

    def hits(self, url: str | None) -> tuple[int, int]:
        """(strict hits, distinct soft terms). A hit has no letter or digit of ASCII beside it."""
        text = (url or "").translate(LOWER)
        strict, soft = 0, set()
        if not len(self.terms):
            return 0, 0
        inner = lambda c: c.isascii() and c.isalnum()
        for last, (kind, term) in self.terms.iter(text):
            first = last - len(term) + 1
            if (first and inner(text[first - 1])) or (last + 1 < len(text) and inner(text[last + 1])):
                continue
            if kind == "strict":
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = host_path(url)
        strict, soft = self.hits(url)
        if found := self.rule(host, path):
            return host, path, *found, strict, soft
        return host, path, None, "block" if strict or soft >= self.soft_hits else "allow", strict, soft


def judge_urls(pages: DataFrame, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_terms for each row of pages (page_id, url).

    options: those of UrlJudge. A null url or one without :// has empty host and path, fits no rule and is judged by the
    vocabulary alone (null: allow). Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = UrlJudge(**options).judge
        for batch in batches:
            rows = [judge(u if isinstance(u, str) else None) for u in batch["url"]]
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "strict_hits", "soft_terms"])
            yield out.assign(page_id=batch["page_id"].to_numpy())[["page_id", *out.columns]]

    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"))
    out = rows.mapInPandas(run, "page_id string, host string, path string, rule string, verdict string, strict_hits long, soft_terms long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
