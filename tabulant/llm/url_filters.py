"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is an anchored regular expression over ``host + path`` together with
the literal tokens (``[a-z0-9]+``) any matching URL must contain. The tokens'
frequencies are counted over the whole table (only tokens that occur in rules,
so the counts are as small as the rule set), and each rule is filed under its
rarest one. A URL's distinct tokens fetch the candidate rules; only these run
their regular expression.

Up to ``IN_ROW`` rules the index is a literal map inside the projection, so the
operator is a narrow scan without a shuffle. Larger rule sets (they come from
the caller and do not grow with the data) become a token -> rule table that is
joined to the exploded tokens of the distinct URLs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import let

IN_ROW = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str  # regular expression over host + path
    tokens: tuple[str, ...]  # literal tokens of any URL that matches
    listed: bool  # a listed rule beats every pattern rule; among listed ones the longest name wins


def listed(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and a path prefix."""
    tokens = re.findall(r"[a-z0-9]+", host.lower())
    # The last token of the prefix may go on in the URL, unless a separator ends it.
    tokens += [t for t in re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path) if t == t.lower()]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{_escaped(host)}{_escaped(path)}", tuple(tokens), True)


def pattern(name: str, verdict: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    return Rule(name, verdict, regex, tokens, False)


def _escaped(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)


#: The rule list of the contract.
LISTED = (
    listed("block", "com", "/en/"),
    listed("allow", "example.com", "/en/7"),
    listed("allow", "net", "/de/"),
    listed("block", "example.net", "/de/8"),
    listed("block", "org", "/es/"),
)

#: Patterns for what no listed rule decides.
PATTERNS = (
    pattern("spam-host", "block", r"^(?:[^/]*[.-])?spam[.-]", ("spam",)),
    pattern("ads-path", "block", r"^[^/]*/(?:.*/)?ads/", ("ads",)),
    pattern("login-path", "block", r"^[^/]*/(?:.*/)?login(?:[./]|\z)", ("login",)),
    pattern("cart-path", "block", r"^[^/]*/(?:.*/)?cart(?:[./]|\z)", ("cart",)),
    pattern("archive-file", "block", r"^[^/]*/.*\.zip\z", ("zip",)),
    pattern("program-file", "block", r"^[^/]*/.*\.exe\z", ("exe",)),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(target: Column) -> Column:
    low = F.translate(target, _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))


def _rarest(pages: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[Rule, str]:
    """The token under which each rule is filed. Counts cover every row; there is one per rule token."""
    literals = sorted({t for r in rules for t in r.tokens})
    target = F.concat(url_host(F.col(url_col)), url_path(F.col(url_col)))
    counted = (
        pages.select(F.explode(url_tokens(target)).alias("token"))
        .where(F.col("token").isin(literals))
        .groupBy("token")
        .count()
        .collect()
    )
    seen = {r["token"]: r["count"] for r in counted}
    return {r: min(r.tokens, key=lambda t: (seen.get(t, 0), t)) for r in rules}


def _best(hits: Column) -> Column:
    """Of matching rules: a listed one before patterns, the longest name, block before allow, then by name."""
    return F.array_max(hits)


def _entry(rule_listed, name, verdict) -> Column:
    return F.struct(
        rule_listed.cast("int").alias("listed"),
        F.when(rule_listed, F.length(name)).otherwise(0).alias("len"),
        (verdict == "block").cast("int").alias("block"),
        name.alias("name"),
        verdict.alias("verdict"),
    )


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = LISTED + PATTERNS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern_rule.

    ``rule`` names the listed rule that decides (else null); without one, the
    verdict is that of the matching pattern rules (block wins) or allow, and
    ``pattern_rule`` names the pattern. A null URL, or one without ``://``, has
    empty host and path, meets no rule and is allowed. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token to be indexed by")
    filed = _rarest(pages, url_col, rules)
    # The URL itself is fenced by a filter-proof name, so extra columns never clash.
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    rows = rows.select("page_id", "_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    if len(rules) <= IN_ROW:
        best = _in_row(rules, filed)
        judged = rows.withColumn("_best", best)
    else:
        judged = _joined(rows, rules, filed)
    on_list = F.col("_best.listed") == 1
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(on_list, F.col("_best.name")).alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit("allow")).alias("verdict"),
        F.when(~on_list, F.col("_best.name")).alias("pattern_rule"),
    )


def _in_row(rules: tuple[Rule, ...], filed: dict[Rule, str]) -> Column:
    by_token: dict[str, list[Rule]] = {}
    for r in rules:
        by_token.setdefault(filed[r], []).append(r)
    pairs: list[Column] = []
    for token, own in sorted(by_token.items()):
        entries = [
            F.struct(F.lit(r.pattern).alias("pattern"), _entry(F.lit(r.listed), F.lit(r.name), F.lit(r.verdict)).alias("hit")) for r in own
        ]
        pairs += [F.lit(token), F.array(*entries)]
    index = F.create_map(*pairs) if pairs else None
    target = F.concat(F.col("host"), F.col("path"))

    def judge(u: Column) -> Column:
        known = F.filter(url_tokens(u), lambda t: F.map_contains_key(index, t))
        fetched = F.flatten(F.transform(known, lambda t: F.element_at(index, t)))
        hits = F.filter(fetched, lambda c: F.rlike(u, c["pattern"]))
        return _best(F.transform(hits, lambda c: c["hit"]))

    if index is None:
        return F.lit(None).cast("struct<listed:int,len:int,block:int,name:string,verdict:string>")
    return let(target, judge)


def _joined(rows: DataFrame, rules: tuple[Rule, ...], filed: dict[Rule, str]) -> DataFrame:
    spark = rows.sparkSession
    index = spark.createDataFrame(
        [(filed[r], r.pattern, r.name, r.verdict, r.listed) for r in rules],
        "token string, pattern string, name string, verdict string, listed boolean",
    )
    targets = rows.select(F.concat("host", "path").alias("_target")).distinct()
    fetched = targets.select("_target", F.explode(url_tokens(F.col("_target"))).alias("token")).join(index, "token")
    hits = fetched.where(F.rlike(F.col("_target"), F.col("pattern")))
    best = hits.groupBy("_target").agg(F.max(_entry(F.col("listed"), F.col("name"), F.col("verdict"))).alias("_best"))
    return rows.withColumn("_target", F.concat("host", "path")).join(best, "_target", "left")
