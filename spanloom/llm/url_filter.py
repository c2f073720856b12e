"""URL filter: pattern rules are indexed by their rarest literal token, the tokens of a URL
fetch candidate rules, and only candidates run their regular expression.

DataFrame operations only. The rules are a parameter (at most ``MAX_RULES``), which bounds the
broadcast index; pages are never moved with more than their id and URL.

Defined cases: a null URL or one without ``://`` has an empty host and path, is fetched by no
rule and allowed. Repeated rows and repeated ids give one output row each. Columns besides the id
and the URL are not read. Among site rules that fit, the longest wins; site rules go before pattern
rules, and among these a block goes before an allow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ascii_lower, columns

MAX_RULES = 100_000
_TOKEN_BREAK = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path + the rest of the URL; ``literals`` are whole
    lower-case tokens that every matching URL holds. ``site`` is the text of a site rule."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: str | None = None


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and the paths below ``path``."""
    pattern = rf"^([^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    # The last piece of the path may go on in a URL, so it is no whole token.
    whole = re.split(_TOKEN_BREAK, f"{host}/{path.lower()}")[:-1]
    return Rule(verdict, pattern, tuple(t for t in dict.fromkeys(whole) if t), host + path)


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for a whole token anywhere in the host or the path."""
    return Rule(verdict, rf"(?i)^[^?#]*(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", (word,))


# The site rules of the registered query, and the pattern rules that judge the rest.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
PATTERN_RULES = (
    *(word_rule("block", w) for w in ("casino", "porn", "viagra", "xxx", "warez", "betting")),
    Rule("block", r"^[^/?#]*(?<![a-z0-9])spam-farm\.", ("spam", "farm")),
    Rule("block", r"(?i)^[^?#]*\.(exe|apk|dmg)([?#]|$)", ()),
    Rule("allow", r"(?i)^[^/?#]*(?<![a-z0-9])anti-spam\.", ("anti", "spam")),
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    tail = F.regexp_replace(rest, "^[^?#]*", "")
    return host, path, tail


def _tokens(host: Column, path: Column, tail: Column) -> Column:
    """Whole tokens, and the empty one that fetches rules without a literal."""
    words = F.split(F.lower(F.concat(host, path, tail)), _TOKEN_BREAK)
    return F.array_distinct(F.concat(F.array(F.lit("")), words))


def rule_index(tokens: DataFrame, rules: tuple[Rule, ...]) -> list[tuple]:
    """(rarest literal, rule number, ...) rows. Only the counts of the rules' own literals
    come to the driver: at most as many numbers as the rules have literals."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules, the index is bounded to {MAX_RULES}")
    literals = sorted({t for r in rules for t in r.literals})
    wanted = tokens.sparkSession.createDataFrame([(t,) for t in literals], "token string")
    found = tokens.join(F.broadcast(wanted), "token").groupBy("token").count().collect()
    often = {r["token"]: r["count"] for r in found}
    return [
        (
            min(r.literals, key=lambda t: (often.get(t, 0), t), default=""),
            r.verdict, r.pattern, r.site, len(r.site or ""),
        )
        for r in rules
    ]


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge each row: id, host, path, rule (the site rule or null), verdict."""
    host, path, tail = url_parts(F.col("url"))
    pages = columns(pages, id_col, url_col).withColumnRenamed(url_col, "url")
    urls = pages.select("url", host.alias("host"), path.alias("path"), tail.alias("tail"))
    tokens = urls.select(
        "url",
        F.concat("host", "path", "tail").alias("target"),
        F.explode(_tokens(F.col("host"), F.col("path"), F.col("tail"))).alias("token"),
    )
    index = pages.sparkSession.createDataFrame(
        rule_index(tokens.select("token"), rules),
        "token string, verdict string, pattern string, site string, size int",
    )
    candidates = tokens.join(F.broadcast(index), "token")
    fits = candidates.where(F.expr("target rlike pattern"))
    best = fits.groupBy("url").agg(
        F.max(F.when(F.col("site").isNotNull(), F.struct("size", "site", "verdict"))).alias("site"),
        F.max(F.when(F.col("site").isNull(), F.col("verdict") == "block")).alias("blocked"),
    )
    return (
        pages.join(best, "url", "left")
        .withColumns({"host": host, "path": path})
        .select(
            id_col,
            "host",
            "path",
            F.col("site.site").alias("rule"),
            F.coalesce(
                F.col("site.verdict"), F.when(F.col("blocked"), F.lit("block")), F.lit("allow")
            ).alias("verdict"),
        )
    )
