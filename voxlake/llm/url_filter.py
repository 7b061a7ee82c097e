"""URL filters by a Bloom filter cascade, in DataFrame functions alone.

The listed keys are pairs of a host and a path prefix. Level 0 of a cascade encodes the
listed keys, level 1 those keys of the corpus that level 0 takes for listed ones, level 2
the listed keys that level 1 takes for those, and so on until a level has no false
positive left. Over the universe of keys that was used for building (every key that the
corpus can ask for) a key is listed exactly if the first level that lacks it has an odd
number. Nothing is joined: a level is a bit array that the expression carries.

Size bounds: a cascade holds O(listed keys) bits per level, whatever the corpus size,
because level 0 gets ``log2(universe / listed)`` more bits a key as the universe grows and
later levels encode only the survivors. The list is what the caller passes. A list that would need
more than ``part_bits`` in a level is dealt by key hash into parts with a cascade each, so
no array grows beyond that; a key asks its own part.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, rules) -> Column:
    """The keys under which a rule that fits could be listed, longest first.

    A rule of k labels fits if it is the host's last k labels, so only label counts and path
    lengths that occur among the rules are formed; their number doesn't depend on the data.
    """
    shapes = {(h.count(".") + 1, len(p), len(h)) for _, h, p in rules}
    labels = F.size(F.split(host, r"\."))
    keys = []
    for k, n in sorted({s[:2] for s in shapes}, reverse=True):
        suffix = F.substring_index(host, ".", -k)
        fits = (labels >= k) & (F.length(path) >= n) & (F.length(host) > 0)
        keys.append(F.when(fits, F.concat(suffix, F.substring(path, 1, n))))
    return F.array_sort(
        F.array_distinct(F.array_compact(F.array(*keys))),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
    )


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(f"{level}:{j}"), key), F.lit(bits)) for j in range(hashes)]


def _hashes(rate: float) -> int:
    return max(1, round(-math.log2(rate)))


def _build(keys: DataFrame, count: int, rate: float, level: int) -> Level:
    """A Bloom filter of the distinct ``key`` column; only its bit array reaches the driver."""
    hashes = _hashes(rate)
    bits = max(64, math.ceil(count * hashes / math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    out = [0] * (bits // 64 + 1)
    for row in words.collect():
        out[row["word"]] = row["bits"]
    return Level(bits, hashes, out)


def _contains(level: Level, number: int, key: Column) -> Column:
    # One constant for Catalyst, however long: an array of literals would be a tree of as many nodes.
    words = F.from_json(F.lit(json.dumps(level.words)), "array<bigint>")
    hit = F.lit(True)
    for at in _positions(key, number, level.bits, level.hashes):
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        hit = hit & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hit


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe``; both have one column, ``key``.

    Null keys are ignored while building and are not members. An empty list has no members.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, universe_size: int, part_bits: int = 1 << 23):
        listed = listed.where(F.col("key").isNotNull()).distinct()
        universe = universe.where(F.col("key").isNotNull())
        count = listed.count()
        self.parts: list[list[Level]] = []
        if not count:
            return
        rate = min(0.5, max(count / max(2.0 * universe_size, 1), 2.0**-30))
        n = math.ceil(count * _hashes(rate) / math.log(2) / part_bits)
        for part in range(n):
            here = self._part(n) == part
            self.parts.append(self._levels(listed.where(here), universe.where(here), rate) if n > 1 else self._levels(listed, universe, rate))

    @staticmethod
    def _part(n: int, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), F.col("key") if key is None else key), F.lit(n))

    @staticmethod
    def _levels(listed: DataFrame, universe: DataFrame, rate: float) -> list[Level]:
        levels: list[Level] = []
        inside, outside, count = listed, universe, listed.count()
        # Listed keys leave the other side by the first levels' answers alone: what level 0
        # takes for listed is few keys, so the list itself can be subtracted from them.
        while count:
            levels.append(_build(inside, count, rate, len(levels)))
            passed = outside.where(_contains(levels[-1], len(levels) - 1, F.col("key"))).distinct()
            wrong = passed.exceptAll(listed) if len(levels) == 1 else passed
            inside, outside = materialize(wrong, "op9-level"), inside
            count, rate = inside.count(), 0.5
        return levels

    @staticmethod
    def _in_part(levels: list[Level], key: Column) -> Column:
        out = F.lit(len(levels) % 2 == 1)
        for number in reversed(range(len(levels))):
            out = F.when(_contains(levels[number], number, key), out).otherwise(F.lit(number % 2 == 1))
        return out

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for part, levels in enumerate(self.parts):
            own = self._in_part(levels, key)
            out = own if len(self.parts) == 1 else F.when(self._part(len(self.parts), key) == part, own).otherwise(out)
        return F.coalesce(F.when(key.isNotNull(), out), F.lit(False))


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``.

    The longest listed key among a URL's candidates is its rule; the verdict is the rule's, else
    ``default`` (not listed); of rules of one length the one that sorts first. Null URLs and URLs without ``://``
    have empty host and path, no rule and the default verdict. URLs of any length are taken whole, rows that repeat
    are judged alike, null ids don't matter. An empty table stays empty. Columns of those names in the input are replaced.
    """
    if not rules:
        raise ValueError("filter_urls needs at least one rule")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    base = pages.drop(*({"host", "path", "rule", "verdict"} - {url})).withColumns({"host": host, "path": path})
    base = base.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    shapes = len({(h.count("."), len(p)) for _, h, p in rules})
    size = max(pages.count() * max(shapes, 1), 1)

    def keys(which) -> DataFrame:
        values = [f"{h}{p}" for v, h, p in rules if which(v)]
        return spark.range(1).select(F.explode(F.array(*map(F.lit, values)).cast("array<string>")).alias("key"))

    asked = base.select(F.explode("_keys").alias("key"))
    listed = Cascade(keys(lambda v: True), asked, size)
    blocked = Cascade(keys(lambda v: v == "block"), keys(lambda v: True), max(len(rules), 1))
    base = base.withColumn("rule", F.get(F.filter("_keys", listed.contains), F.lit(0)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return base.withColumn("verdict", verdict).drop("_keys")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; awkward rows as in ``filter_urls``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH split AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS raw, rest FROM split),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN (SELECT * FROM hits WHERE k = 1) h ON u.page_id = h.page_id
"""
