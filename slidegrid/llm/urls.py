"""URL filters: explicit rules, and a Bloom filter cascade for a list of keys.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's path; the longest rule wins.
Rules compile into one expression. Urls without a rule are judged by membership of their key (host and path) in a list.

The cascade makes that membership exact. Level 1 is a Bloom filter of the listed keys. Level 2 holds the unlisted keys of the
corpus that level 1 takes for listed; level 3 the listed keys that level 2 takes for unlisted; and so on until a level
mistakes no key. As every key of the corpus was tried, the answer is exact for every one of them, and judging a url needs some
bit tests and no join. Bits are built by hashing, grouping by word and OR, and come into the expressions as scalar subqueries.

All of it is DataFrame code. A level's bits are bounded: keys are dealt by hash into so many segments that no segment's first
level exceeds ``MOST_BITS``, and each segment is judged in a pass of its own (one segment unless the list has millions of keys).

Null urls and urls without ``://`` have empty host and path, fit no rule and are not listed. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from slidegrid.llm.words import LOWER, UPPER
from slidegrid.session import cut_lineage

PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)"
#: Bits of one segment's first level (4 MB); ten bits and four hashes per key let about one stranger in eighty pass.
MOST_BITS, BITS_PER_KEY, HASHES = 1 << 25, 10, 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number, its size in 64-bit words (a power of two), and a one-row frame with the words."""

    number: int
    words: int
    bits: DataFrame

    def positions(self, key: Column) -> list[Column]:
        return [F.xxhash64(F.lit(self.number * HASHES + i), key).bitwiseAND(F.lit(self.words * 64 - 1)) for i in range(HASHES)]

    def holds(self, key: Column) -> Column:
        words, found = self.bits.scalar(), F.lit(True)
        for at in self.positions(key):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            found = found & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found


def build_level(keys: DataFrame, number: int, size: int) -> Level:
    """The filter of the ``size`` keys in column ``key``."""
    words = 1
    while words * 64 < size * BITS_PER_KEY:
        words *= 2
    level = Level(number, words, keys)
    at = F.explode(F.array(*level.positions(F.col("key"))))
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(at & 63 AS INT))")
    set_words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "word").join(set_words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return Level(number, words, cut_lineage(row))


def cascade(universe: DataFrame) -> list[Level]:
    """Levels that tell listed from unlisted keys of ``universe`` (key, listed; distinct keys, read several times)."""
    mine, others = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    levels: list[Level] = []
    size = mine.count()
    while size:
        levels.append(build_level(mine, len(levels) + 1, size))
        others, mine = mine, cut_lineage(others.where(levels[-1].holds(F.col("key"))))
        size = mine.count()
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for every key of the universe: held by level 1 and not (held by level 2 and not (...))."""
    found = F.lit(False)
    for level in reversed(levels):
        found = level.holds(key) & ~found
    return found


def listed(rows: DataFrame, keys: DataFrame, key: str = "key", out: str = "listed", most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with a boolean column ``out``: whether their key is among ``keys`` (column ``key``); null keys are not.

    The universe is the distinct keys of ``rows``; it is found by stacking both tables and grouping once.
    """
    tagged = rows.select(F.col(key).alias("key"), F.lit(False).alias("listed")).unionByName(keys.select("key", F.lit(True).alias("listed")))
    universe = cut_lineage(tagged.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")))
    n = universe.where("listed").count()
    segments = max(1, -(-n * BITS_PER_KEY * 2 // most_bits))
    if segments == 1:
        return rows.withColumn(out, F.coalesce(is_listed(cascade(universe), F.col(key)), F.lit(False)))
    segment = lambda c: F.pmod(F.xxhash64(F.lit("segment"), F.coalesce(c, F.lit(""))), F.lit(segments))
    parts = []
    for k in range(segments):
        levels = cascade(universe.where(segment(F.col("key")) == k))
        parts.append(rows.where(segment(F.col(key)) == k).withColumn(out, F.coalesce(is_listed(levels, F.col(key)), F.lit(False))))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def judge(pages: DataFrame, blocked: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule, verdict of every page; ``blocked`` has the listed keys (host + path) in column ``key``."""
    parts = pages.select(*[F.col(c) for c in keep], host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    keyed = parts.withColumn("__key", F.when(F.col("__host") != "", F.concat("__host", "__path")))
    found = listed(keyed, blocked, "__key", "__listed")
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    method = F.when(F.col("__listed"), "block").otherwise("allow")
    return found.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def tracked_keys(pages: DataFrame, url: str = "url") -> DataFrame:
    """Keys (host + path) that some page reaches with a campaign parameter: a list that grows with the corpus."""
    campaign = F.coalesce(F.col(url), F.lit("")).contains("utm_source=")
    return pages.where(campaign).select(F.concat(host_of(F.col(url)), path_of(F.col(url))).alias("key")).where("key <> ''").distinct()
