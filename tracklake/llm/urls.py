"""URL filters: rules indexed by their rarest literal token, regular expressions for candidates only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"
#: Rules that fit in an expression; more are joined as a table.
INLINE = 500


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls whose host and path (lower-case host, then path) match ``pattern``.

    ``tokens`` are the literal tokens that any match contains; ``name`` is given for rules of the
    fixed list and empty for patterns; among matches the higher ``rank`` wins, then the larger
    name, then the larger pattern.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, all its subdomains, and paths that start with ``path``.

    The host's labels are literal tokens; the path's last label may go on in the url and so
    counts only where a separator follows it.
    """
    name = host + path
    labels = re.findall(TOKEN, host) + re.findall(f"(?<![a-z0-9])({TOKEN})(?=[^A-Za-z0-9])", path)
    return Rule(name, verdict, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(labels), 1000 + len(name))


def word_rule(verdict: str, *words: str) -> Rule:
    """A pattern rule for hosts with these words one after another, parted by dots or dashes."""
    return Rule("", verdict, f"^(?:[^/]*[.-])?{'[.-]'.join(map(re.escape, words))}(?:[.-][^/]*)?(?:/|$)", words, len("-".join(words)))


# The rules that results must follow.
BASE = (host_rule("block", "net", "/"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/"))
#: Patterns for everything that the list leaves open.
PATTERNS = tuple(word_rule("block", *w.split()) for w in ("spam farm", "cheap pills", "free casino", "online casino", "poker", "casino", "viagra", "porn", "xxx", "link farm", "click bait", "free money", "replica watches", "payday loans", "adserver", "doubleclick"))
RULES = BASE + PATTERNS


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and where there is no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def tokens(hp: Column) -> Column:
    """Distinct runs of ASCII letters and digits, letters lowered."""
    return F.array_distinct(F.regexp_extract_all(F.translate(hp, UPPER, LOWER), F.lit(TOKEN), 0))


def rarest(df: DataFrame, hp: Column, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by the literal token of each that the fewest urls contain; ties go to the longer, then larger token.

    One pass counts, over all urls, the tokens that occur in rules; the driver gets a number a token.
    """
    known = sorted({t for r in rules for t in r.tokens})
    if len(known) <= 5 * INLINE:
        known_in = F.array(*map(F.lit, known))
        seen = df.select(F.explode(F.array_intersect(tokens(hp), known_in)).alias("t"))
    else:
        seen = df.select(F.explode(tokens(hp)).alias("t")).join(df.sparkSession.createDataFrame([(t,) for t in known], "t string"), "t", "left_semi")
    count = {r.t: r.n for r in seen.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), -len(t), t)), []).append(r)
    return index


def judge(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow", out: str = "filter") -> DataFrame:
    """Add a struct column ``out`` (host, path, rule, verdict): the strongest rule that fits each url.

    Native expressions only. Each row looks its own tokens up in the index and runs only the
    regular expressions found there: no shuffle, and nothing to skew. Null urls and urls without
    ``://`` have empty parts, no rule and the default verdict. A column named ``out`` is replaced.
    """
    if len(rules) > INLINE:
        return _judge_joined(df, url, rules, default, out)
    host, path = host_path(F.col(url))
    index = rarest(df.select(F.concat(host, path).alias("hp")), F.col("hp"), rules)
    entry = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))
    table = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, rs)))))
    keys = F.array(*(F.lit(t) for t in sorted(index)))
    hp = F.concat(host, path)
    candidates = F.flatten(F.transform(F.array_intersect(tokens(hp), keys), lambda t: F.element_at(table, t)))
    best = F.array_max(F.filter(candidates, lambda r: F.rlike(hp, r["pattern"])))
    cols = F.struct(host.alias("host"), path.alias("path"), F.nullif(best["name"], F.lit("")).alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
    return df.withColumn(out, cols)


def _judge_joined(df: DataFrame, url: str, rules: tuple[Rule, ...], default: str, out: str) -> DataFrame:
    """The same with the index as a table, for long lists: tokens of distinct urls meet rules in a join.

    Only urls that some rule fits come back, a row each, so a url of any number of rows is one
    row of that side. Names of columns cannot clash: those made here are chosen against ``df``.
    """
    u, best = unused(df, "rule_url"), unused(df, "rule_best")
    host, path = host_path(F.col(u))
    urls = df.select(F.col(url).alias(u)).distinct().filter(F.col(u).isNotNull()).withColumn("hp", F.concat(host, path))
    index = rarest(urls, F.col("hp"), rules)
    table = df.sparkSession.createDataFrame([(t, r.rank, r.name, r.pattern, r.verdict) for t, rs in index.items() for r in rs], "t string, rank int, name string, pattern string, verdict string")
    hits = urls.select(u, "hp", F.explode(tokens(F.col("hp"))).alias("t")).join(table, "t").filter(F.rlike("hp", F.col("pattern")))
    found = hits.groupBy(u).agg(F.max(F.struct("rank", "name", "pattern", "verdict")).alias(best))
    host, path = host_path(F.col(url))
    cols = F.struct(host.alias("host"), path.alias("path"), F.nullif(F.col(best)["name"], F.lit("")).alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))
    return df.join(found, F.col(url) == F.col(u), "left").withColumn(out, cols).drop(u, best)
