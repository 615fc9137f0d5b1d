"""URL filters: pattern rules indexed by their rarest literal token. DataFrame and SQL functions only.

A rule is a pattern over host and path with the literal tokens that any URL it fits must hold. Rules are a table. The
index files each rule under the token that the table's URLs hold least often; a URL's tokens fetch candidate rules from
it by a join, and only those run their pattern. Candidates are ordered by rule, so a pattern is compiled once in a task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelane.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which their table and index (a few hundred bytes each) are broadcast; more are joined by shuffle.
BROADCAST_RULES = 50_000
#: Ranks of patterns lie below those of all host and path rules.
PATTERN, PLAIN = 0, 1


@dataclass(frozen=True)
class Rule:
    """``tokens``: literal tokens that every fitting host and path holds, whole between characters other than letters and digits."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    kind: int = PATTERN


def _lower(text: str) -> str:
    """Tokens are those of URLs with A-Z lower-cased, and of no other letter."""
    return text.translate(str.maketrans(UPPER, LOWER))


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits ``host``, whose A-Z count as lower case, and its subdomains where the path starts with ``path``, as it is written."""
    host = _lower(host)
    quoted = re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", host + path)
    # the path's last token may go on in a URL, unless the prefix ends it
    ended = _lower(path)
    whole = host + ended if re.search("[^a-z0-9]$", ended) else host + re.sub("[a-z0-9]+$", "", ended)
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{quoted}", tuple(t for t in re.split("[^a-z0-9]+", whole) if t), PLAIN)


def word_rule(name: str, *words: str) -> Rule:
    """Blocks hosts that hold the words, side by side and apart from other letters and digits."""
    body = "[^a-z0-9/]+".join(words)
    return Rule(name, "block", rf"^[^/]*(?<![a-z0-9]){body}(?![a-z0-9])[^/]*(?:/|$)", words)


def path_rule(name: str, *words: str) -> Rule:
    """Blocks paths that hold the words, in either case, side by side and apart from other letters and digits."""
    body = "[^A-Za-z0-9/]+".join(words)
    return Rule(name, "block", rf"^[^/]*/(?:.*[^A-Za-z0-9])?(?i:{body})(?![A-Za-z0-9])", words)


#: The base rules; of those that fit a URL the longest decides.
BASE_RULES = [
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
]
#: The method's own rules, for URLs that no base rule fits.
PATTERN_RULES = [
    word_rule("gambling", "casino"),
    word_rule("gambling-bets", "bets"),
    word_rule("gambling-poker", "poker"),
    word_rule("gambling-slots", "slots"),
    word_rule("spam", "spam"),
    word_rule("link-farm", "link", "farm"),
    word_rule("advertising", "ads"),
    word_rule("advertising-server", "adserver"),
    word_rule("tracking", "tracker"),
    word_rule("adult", "porn"),
    word_rule("adult-x", "xxx"),
    word_rule("malware", "malware"),
    word_rule("phishing", "phishing"),
    word_rule("warez", "warez"),
    path_rule("login", "wp", "login"),
    path_rule("administration", "wp", "admin"),
    path_rule("database", "phpmyadmin"),
    path_rule("scripts", "cgi", "bin"),
    path_rule("spam-feed", "trackback"),
    path_rule("affiliates", "affiliate", "link"),
    path_rule("advertising-path", "adserver"),
    path_rule("phishing-path", "account", "verify"),
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


#: A token that every URL has: rules without a literal token of their own are filed under it, and run on all.
ANY = "*"


def tokens_of(place: Column) -> Column:
    return F.array_append(F.array_distinct(F.split(ascii_lower(place), "[^a-z0-9]+")), ANY)


def rule_table(spark: SparkSession, base: list[Rule] | None = None, patterns: list[Rule] | None = None) -> DataFrame:
    """(number, name, action, pattern, tokens) of rules; of those that fit a URL the smallest number decides.

    Base rules come first, the longest before others, ties in the order given; then patterns in theirs, which have no name.
    """
    rules = sorted(BASE_RULES if base is None else base, key=lambda r: -len(r.name)) + (PATTERN_RULES if patterns is None else patterns)
    rows = [(i, r.name if r.kind == PLAIN else None, r.action, r.pattern, list(r.tokens)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "number int, name string, action string, pattern string, tokens array<string>")


def index(rules: DataFrame, urls: DataFrame, place: Column) -> DataFrame:
    """(token, number, pattern): each rule under the token that fewest of the URLs hold, ties to the longer token.

    Tokens count in lower case; a rule without any is filed under ``ANY``, so none is lost.
    """
    own = F.array_distinct(F.filter(F.transform(F.coalesce("tokens", F.array().cast("array<string>")), ascii_lower), lambda t: t.isNotNull() & (t != "")))
    filed = rules.select(F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(ANY)))).alias("token"), "number", "pattern")
    wanted = filed.select(F.col("token").alias("_token")).distinct()
    held = urls.select(F.explode(tokens_of(place)).alias("token")).groupBy("token").count()
    counts = held.join(wanted, F.col("token") == F.col("_token")).select("_token", "count")
    ranked = filed.join(counts, F.col("token") == F.col("_token"), "left")
    order = F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("m"), F.col("token").alias("t"))
    return ranked.groupBy("number").agg(F.min_by("token", order).alias("token"), F.first("pattern").alias("pattern")).select("token", "number", "pattern")


def judge(urls: DataFrame, *, url: str = "url", rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row, over columns of those names if there are any.

    ``rules``: as ``rule_table`` gives them. The longest base rule that fits decides, and ``rule`` names it. Else ``rule``
    is null and the first pattern that fits decides, or ``default``. Null URLs and those without ``://`` have empty host
    and path, which no rule fits. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = urls.sparkSession
    rules = cut(rule_table(spark) if rules is None else rules)
    small = F.broadcast if rules.count() <= BROADCAST_RULES else lambda x: x
    place = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    filed = small(cut(index(rules, urls, place)).withColumnRenamed("token", "_token"))
    places = urls.select(place.alias("place")).where("place != ''")
    tried = places.select("place", F.explode(tokens_of(F.col("place"))).alias("token")).join(filed, F.col("token") == F.col("_token"))
    # instr keeps the last pattern it compiled; rlike would compile one for each row
    fits = tried.sortWithinPartitions("number").where(F.call_function("regexp_instr", "place", "pattern") > 0)
    best = fits.groupBy("place").agg(F.min("number").alias("_number"))
    decided = best.join(small(rules), F.col("_number") == F.col("number")).select(F.col("place").alias("__place"), F.col("name").alias("__rule"), F.col("action").alias("__action"))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parts = urls.select(*(F.col(f"`{c}`") for c in kept), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = parts.join(decided, F.concat("host", "path") == F.col("__place"), "left")
    return judged.select(*(F.col(f"`{c}`") for c in kept), "host", "path", F.col("__rule").alias("rule"), F.coalesce("__action", F.lit(default)).alias("verdict"))
