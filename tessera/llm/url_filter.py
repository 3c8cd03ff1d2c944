"""URL filtering by pattern rules behind a token index.

A rule is a regular expression over `host || path` or over the whole URL, together with the
literal tokens that every match must contain. The index files each rule under the one of its
literals that is rarest in the table being judged; a URL looks up its own tokens there, and only
the rules found run their expression. Index and rules are parameters of the operator, so their
size doesn't depend on the data; a URL is judged inside its row, without a shuffle.

Priority: host rules first (the longest that fits), then pattern rules (an allowing one beats a
blocking one), then `allow`.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule, and is
allowed by host rules; rows that repeat are judged each for itself; URLs of any length are judged
whole; an empty table gives no rows; other columns pass through, but for those named as what judge
adds, which are replaced. Rules and their index are part of the plan: some hundreds, not many
thousands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    action: str
    #: "site": matched against host || path; "url": against the URL with A-Z lower-cased.
    scope: str
    literals: tuple[str, ...]


def site_rule(rule: str, action: str) -> Rule:
    """A rule like `example.net/en/`: this host and its subdomains, paths that start so."""
    host, slash, path = rule.partition("/")
    return Rule(rule, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", action, "site", tuple(re.findall("[a-z0-9]+", host.lower())))


#: Fixed values of the query's contract.
SITE_RULES = (
    site_rule("net/", "block"),
    site_rule("example.net/en/", "allow"),
    site_rule("example.com/de/", "block"),
    site_rule("org/fr/", "allow"),
)
PATTERN_RULES = (
    Rule("spam-farm", r"://([^/?#]*\.)?spam-farm\.", "block", "url", ("spam", "farm")),
    Rule("cheap-pills", r"://([^/?#]*\.)?cheap-pills\.", "block", "url", ("cheap", "pills")),
    Rule("casino", r"://([^/?#]*\.)?casino(-[a-z0-9]+)?\.", "block", "url", ("casino",)),
    Rule("adult", r"://([^/?#]*\.)?adult(-[a-z0-9]+)?\.", "block", "url", ("adult",)),
    Rule("bets", r"://([^/?#]*\.)?free-bets\.", "block", "url", ("free", "bets")),
    Rule("ads", r"://([^/?#]*\.)?ads-track\.", "block", "url", ("ads", "track")),
    Rule("session", r"[?&;]phpsessid=", "block", "url", ("phpsessid",)),
    Rule("login", r"/(wp-)?login\.php", "block", "url", ("login",)),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def tokens(url: Column) -> Column:
    lowered = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.filter(F.split(lowered, "[^a-z0-9]+"), lambda t: t != ""))


def literal_counts(urls: DataFrame, column: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs each literal of the rules occurs: one aggregate over the URL column."""
    literals = sorted({x for r in rules for x in r.literals})
    if not literals:
        return {}
    found = urls.select(tokens(F.col(column)).alias("t")).agg(
        *[F.sum(F.array_contains("t", x).cast("long")).alias(f"n{i}") for i, x in enumerate(literals)]
    ).first()
    return {x: found[i] or 0 for i, x in enumerate(literals)}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rarest literal -> numbers of the rules filed under it."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        if not rule.literals:
            raise ValueError(f"rule {rule.name} has no literal token to be filed under")
        index.setdefault(min(rule.literals, key=lambda x: (counts.get(x, 0), x)), []).append(i)
    return index


def _hits(rules: tuple[Rule, ...], scope: str, told) -> Column:
    """What told says of each rule of a scope that is a candidate and fits, null for the others.

    A rule's expression is a literal, compiled once, and runs only where the rule is a candidate.
    """
    subject = F.col("site" if scope == "site" else "lowered")
    found = [F.when(F.array_contains("candidates", i) & F.rlike(subject, F.lit(r.pattern)), told(r)) for i, r in enumerate(rules) if r.scope == scope]
    return F.array(*found) if found else F.array(F.when(F.lit(False), told(Rule("", "", "", scope, ()))))


def judge(urls: DataFrame, column: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """urls with host, path, rule (a site rule's name or null), pattern (a pattern rule's name or
    null), verdict and n_candidates, the number of rules whose expression was run. Columns of
    urls with those names are replaced."""
    index = build_index(rules, literal_counts(urls, column, rules))
    filed = F.create_map(*[x for k, v in sorted(index.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    url = F.col("row").getField(column)
    host, path = split_url(url)
    at = urls.select(F.struct("*").alias("row"))
    at = at.select("row", host.alias("host"), path.alias("path"), tokens(url).alias("tokens"), F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER).alias("lowered"))
    at = at.withColumn("site", F.concat("host", "path"))
    at = at.withColumn(
        "candidates",
        F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at(filed, t)), lambda x: x.isNotNull())),
    )
    best = F.struct(
        F.array_max(_hits(rules, "site", lambda r: F.struct(F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action")))).alias("site"),
        # "allow" sorts before "block"
        F.array_min(_hits(rules, "url", lambda r: F.struct(F.lit(r.action).alias("action"), F.lit(r.name).alias("name")))).alias("url"),
    )
    at = at.withColumn("best", best)
    new = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.col("best.site.name"),
        "pattern": F.col("best.url.name"),
        "verdict": F.coalesce("best.site.action", "best.url.action", F.lit("allow")),
        "n_candidates": F.size("candidates"),
    }
    kept = [F.col("row").getField(c).alias(c) for c in urls.columns if c not in new]
    return at.select(*kept, *[v.alias(k) for k, v in new.items()])
