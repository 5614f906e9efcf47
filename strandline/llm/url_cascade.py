"""URL filters: host and path rules, then a Bloom filter cascade over listed domains.

Keys are hosts; a host is listed if it or a domain above it is. The first filter holds the listed keys of
the corpus. Unlisted keys of the corpus that it lets through go
into the second filter, listed keys that the second lets through into the third, and so on until no
false positive is left. As the levels cover the corpus's complete key universe, the parity of the first
level that rejects a key tells exactly whether it is listed, and rows are judged by bit tests alone. Building it
takes one join of the distinct hosts (not of the rows) with the list.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed; rules that tie in length cannot both fit a url with one path, the later wins; very long urls are read
whole; repeated rows get equal results; empty tables give empty results; columns of any name are kept, but
``host``, ``path``, ``rule`` and ``verdict`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of one level at most: a level is sent to executors as one array (16 MB); a larger one is an error.
MAX_BITS = 1 << 27
#: Levels shrink by a constant factor; only keys of one 64-bit hash would go on for ever.
HASHES, MAX_LEVELS = 4, 64


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of (verdict, host, path) rules that fits; host rules also fit subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: Column) -> Column:
    """The host and the domains above it, as an array; none for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def level_words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the filter's bits as an array of longs. Bits are ORed before the shuffle."""
    spots = keys.select(F.explode(F.array(*[bit(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("b"))
    words = spots.select(F.shiftrightunsigned("b", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int")).alias("x"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    dense = words.unionAll(blank).groupBy("w").agg(F.bit_or("x").alias("x"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s.x).alias("words"))


def might_hold(key: Column, words: Column, level: int, bits: int) -> Column:
    tests = [F.getbit(F.element_at(words, (F.shiftrightunsigned(bit(key, level, i, bits), 6) + 1).cast("int")), F.pmod(bit(key, level, i, bits), F.lit(64)).cast("int")) == 1 for i in range(HASHES)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class Cascade:
    """Filters over a key universe: each level's table has one row, kept in the scratch folder."""

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS, bits_per_key: int = 8) -> None:
        """universe(key): distinct keys; listed(key). Keys beyond the bound of one level raise."""
        scratch = Scratch(universe.sparkSession)
        universe = universe.join(listed.select("key", F.lit(True).alias("on")).distinct(), "key", "left").select("key", F.coalesce("on", F.lit(False)).alias("on"))
        universe = scratch.write(universe, "universe")
        self.levels: list[tuple[DataFrame, int]] = []
        inside, against = universe.where("on").select("key"), universe.where("not on").select("key")
        while True:
            level = len(self.levels)
            n = inside.count()
            if not n:
                break
            if level == MAX_LEVELS:
                raise ValueError("a listed and an unlisted key have the same hash")
            bits = 64 << max(0, math.ceil(math.log2(max(1, n * bits_per_key / 64))))
            if bits > max_bits:
                raise ValueError(f"level {level} holds {n} keys: judge the table in parts, by ranges of hosts")
            words = scratch.write(level_words(inside, level, bits), f"level-{level}")
            self.levels.append((words, bits))
            passed = against.where(might_hold(F.col("key"), words.scalar(), level, bits))
            inside, against = scratch.write(passed, f"passed-{level}"), inside

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(bool(len(self.levels) % 2))
        for level in reversed(range(len(self.levels))):
            words, bits = self.levels[level]
            out = F.when(~might_hold(key, words.scalar(), level, bits), F.lit(bool(level % 2))).otherwise(out)
        return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict: the longest rule's, else block if the host is listed."""
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = split_url(F.col(url).cast("string"))
    parts = pages.withColumns({"host": host, "path": path})
    hosts = parts.where("host <> ''").select(F.col("host").alias("key")).distinct()
    named = hosts.select("key", F.explode(suffixes(F.col("key"))).alias("domain")).join(listed.select(F.col("key").alias("domain")), "domain", "left_semi").select("key")
    blocked = (F.col("host") != "") & Cascade(hosts, named).holds(F.col("host"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(found["verdict"], F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return parts.select(*[F.col(f"`{c}`") for c in parts.columns], found["rule"].alias("rule"), verdict.alias("verdict"))
