"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A cascade has the listed keys in its first filter, the first filter's false positives over the corpus's
whole key universe in the second, the second's false positives among the listed keys in the third, and
so on until a filter has none. A key of the universe is listed exactly if the first filter that lacks it
is of an odd place; no join and no list is needed to tell.

Rules and listed hosts are one cascade for each verdict. The keys of an url are its host's suffixes at
dots, each with its path's prefixes of the lengths that rule paths have.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parquill.runtime import checkpoint

#: Filters of a cascade; keys still in doubt after the last are kept as they are.
MAX_LEVELS = 40
#: Listed keys of one cascade, whose filters are literals of the plan: 4 MB or so. Longer lists get several.
MAX_LISTED = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bloom:
    """One filter: its 64-bit words, number of hashes and seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        bits = 64 * len(self.words)
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        first, step = (F.pmod(F.xxhash64(key, F.lit(2 * self.seed + i)), F.lit(bits)) for i in (0, 1))
        out = F.lit(True)
        for j in range(self.hashes):
            at = F.pmod(first + F.lit(j) * step + F.lit(j * j), F.lit(bits))
            out = out & (F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
    """A filter of the n keys in column ``key`` with about this rate of false positives."""
    words = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * words
    first, step = (F.pmod(F.xxhash64(F.col("key"), F.lit(2 * seed + i)), F.lit(bits)) for i in (0, 1))
    at = keys.select(F.explode(F.array(*[F.pmod(first + F.lit(j) * step + F.lit(j * j), F.lit(bits)) for j in range(hashes)])).alias("at"))
    set_bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = [0] * words
    for r in set_bits.collect():  # as many rows as the filter has words
        out[r["word"]] = r["bits"]
    return Bloom(tuple(out), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]
    rest: tuple[str, ...]  # listed keys that all filters leave in doubt; empty but for MAX_LEVELS
    whole: bool  # whether a key that all filters have is listed

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.array_contains(_strings(self.rest), key) if self.rest else F.lit(self.whole)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def _strings(values: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _table(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    """Values that the caller holds as a table, made by Spark alone."""
    return spark.range(1).select(F.explode(_strings(values)).alias(name))


def cascade(listed: DataFrame, count: int, universe: DataFrame, size: int) -> Cascade:
    """The cascade of the ``count`` distinct keys in ``listed``'s column ``key`` over those in ``universe``'s, ``size`` in all."""
    if not count:
        return Cascade((), (), False)
    inside, others = listed, None
    counts = [count, 0]
    # As small in all as can be: the first filter lets through about 0.7 keys for each listed one, the others half.
    rate = min(0.5, math.sqrt(0.5) * count / max(1, size))
    levels: list[Bloom] = []
    while len(levels) < MAX_LEVELS:
        i = len(levels)
        now, against = (inside, others) if i % 2 == 0 else (others, inside)
        levels.append(bloom(now, counts[i % 2], rate if i == 0 else 0.5, i))
        if i == 0:
            passed = universe.filter(levels[0].has(F.col("key"))).join(listed, "key", "left_anti")
        else:
            passed = against.filter(levels[i].has(F.col("key")))
        passed = checkpoint(passed)
        n = passed.count()
        if not n:
            return Cascade(tuple(levels), (), i % 2 == 0)
        if i % 2 == 0:
            others, counts[1] = passed, n
        else:
            inside, counts[0] = passed, n
    return Cascade(tuple(levels), tuple(r[0] for r in inside.select("key").collect()), False)


@dataclass(frozen=True)
class Cascades:
    """Cascades of the parts of a list, parted by a hash of the key."""

    parts: tuple[Cascade, ...]

    def has(self, key: Column) -> Column:
        out = F.lit(False)
        for part in self.parts:
            out = out | part.has(key)
        return out


def cascades(listed: DataFrame, universe: DataFrame, size: int) -> Cascades:
    """One cascade over ``universe`` for each ``MAX_LISTED`` keys, or so, of ``listed``, whose keys may repeat."""
    keys = checkpoint(listed.filter("key is not null").distinct())
    parts = max(1, -(-keys.count() // MAX_LISTED))
    of = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts))
    some = [keys.filter(of == k) if parts > 1 else keys for k in range(parts)]
    return Cascades(tuple(cascade(x, x.count(), universe, size) for x in some))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    host = F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, *, allow: Sequence[str], block: Sequence[str], block_hosts: Sequence[str] | DataFrame = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every row's url: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    A rule is a host and a path, as in ``net/es/``; it fits that host and its subdomains where the url's
    path starts with the rule's. Of rules that fit, the longest wins, and of those the one with the
    longer host. Where none fits, ``rule`` is null and the verdict is ``block`` if the host or a parent
    of it is in ``block_hosts``, else ``allow``. ``block_hosts`` is a list, or a table with a column ``host``.

    A null url, or one without ``://``, has empty host and path: no rule fits, the verdict is allow.
    Repeated rows are judged each; null ids stay. An empty table gives an empty result; other columns
    are not looked at.
    """
    rules = {v: [(r[: r.index("/")].lower(), r[r.index("/") :]) for r in given] for v, given in (("allow", allow), ("block", block))}
    if both := {*rules["allow"]} & {*rules["block"]}:
        raise ValueError(f"both allowed and blocked: {sorted(both)}")
    spark = pages.sparkSession
    lengths = sorted({len(p) for given in rules.values() for _, p in given})
    host, path = split_url(F.col(url_col))
    cut = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]')) - i + 1), '.'))")
    heads = F.expr(f"transform(filter(array({', '.join(map(str, lengths))}), n -> n <= length(path)), n -> substring(path, 1, n))") if lengths else F.expr("cast(array() as array<string>)")
    cut = cut.withColumn("hosts", hosts).withColumn("heads", heads)
    keys = F.expr("concat(flatten(transform(hosts, h -> transform(heads, p -> concat('r', h, p)))), transform(hosts, h -> concat('h', h)))")
    universe = checkpoint(cut.select("hosts", "heads").distinct().select(F.explode(keys).alias("key")).distinct())
    size = universe.count()
    ruled = {v: _table(spark, [f"r{h}{p}" for h, p in given], "key") for v, given in rules.items()}
    given = block_hosts if isinstance(block_hosts, DataFrame) else _table(spark, block_hosts, "host")
    hosts_listed = given.select(F.concat(F.lit("h"), F.translate(F.col("host").cast("string"), UPPER, LOWER)).alias("key"))
    allowed, blocked = cascades(ruled["allow"], universe, size), cascades(ruled["block"].union(hosts_listed), universe, size)

    fits = F.flatten(F.transform("hosts", lambda h: F.transform(F.filter("heads", lambda p: allowed.has(F.concat(F.lit("r"), h, p)) | blocked.has(F.concat(F.lit("r"), h, p))), lambda p: F.struct((F.length(h) + F.length(p)).alias("n"), F.length(h).alias("m"), F.concat(h, p).alias("rule")))))
    judged = cut.withColumn("best", F.array_max(fits))
    listed = F.exists("hosts", lambda h: blocked.has(F.concat(F.lit("h"), h)))
    verdict = F.when(F.col("best").isNotNull(), F.when(allowed.has(F.concat(F.lit("r"), F.col("best.rule"))), "allow").otherwise("block")).otherwise(F.when(listed, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
