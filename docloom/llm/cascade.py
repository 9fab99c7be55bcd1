"""URL filters: prefix rules and an exact Bloom filter cascade, in DataFrame functions only (operator 5)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import settle

#: (host, path, verdict) of the rules that go before the list.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The list of the query: keys of hosts that have a label of this form. Hosts of several words are a known sign of pages
#: that are made to be found; a list of one's own is a table of keys.
LISTED_HOST = r"(^|\.)[^.]+-[^.]+(\.|$)"
#: Hash functions of a level, bits a listed key, bits of all levels of a share of the keys, and bits of all
#: shares up to which the filters are told to every task.
HASHES, BITS_A_KEY, SHARE_BITS, TOLD_BITS = 4, 8, 1 << 22, 1 << 26
#: Levels after which keys that still collide (equal hashes throughout) are listed themselves.
LEVELS = 40

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def places(key: Column, level, bits) -> list[Column]:
    """Where a level's hash functions put a key; ``level`` and ``bits`` are numbers or columns."""
    level, bits = (F.lit(x) if isinstance(x, int) else x for x in (level, bits))
    return [F.pmod(F.xxhash64(key, level * HASHES + j), bits.cast("long")) for j in range(HASHES)]


def contains(key: Column, level, bits, filled: Column) -> Column:
    """Whether a level's filter (words of 64 bits) has a key."""
    out = F.lit(True)
    for at in places(key, level, bits):
        word = F.get(filled, F.shiftright(at, 6).cast("int"))
        out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return out


def share_of(key: Column, shares: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(shares)).cast("int")


def filters_of(inside: DataFrame, level: int) -> DataFrame:
    """(share, bits, filled): the filter of each share's keys (share, key) at a level, made on the executors."""
    n = inside.groupBy("share").agg(F.count("*").alias("n"))
    sizes = n.select("share", F.greatest(F.lit(64), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") * BITS_A_KEY)))).cast("long").alias("bits"))
    hit = inside.join(F.broadcast(sizes), "share")  # a row for each share
    at = hit.select("share", "bits", F.explode(F.array(*places(F.col("key"), level, F.col("bits")))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = at.groupBy("share", "bits", F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("value"))
    none = sizes.select("share", "bits", F.explode(F.sequence(F.lit(0), (F.col("bits") / 64 - 1).cast("int"))).alias("word"), F.lit(0).cast("long").alias("value"))
    every = words.unionByName(none).groupBy("share", "bits", "word").agg(F.bit_or("value").alias("value"))
    filled = F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: x.value)
    return every.groupBy("share", "bits").agg(filled.alias("filled"))


def build(universe: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(share, levels, rest) from the distinct keys of the corpus (share, key, listed).

    Level 0 holds the listed keys, level 1 the others that level 0 lets through, level 2 the listed
    ones that level 1 lets through, and so on until none is left; all shares go through a level together.
    Keys that are left after ``levels`` have the hashes of a key of the other side: the listed ones among them are
    kept by name (``rest``).
    """
    inside, outside = universe.filter("listed").select("share", "key"), universe.filter("not listed").select("share", "key")
    made, level = None, 0
    while level < levels and not inside.isEmpty():
        own = settle(filters_of(inside, level), "filter")
        made = own.withColumn("level", F.lit(level)) if made is None else made.unionByName(own.withColumn("level", F.lit(level)))
        passed = outside.join(own, "share").filter(contains(F.col("key"), level, F.col("bits"), F.col("filled")))
        inside, outside, level = settle(passed.select("share", "key"), "passed"), inside, level + 1
    if made is None:
        return universe.sparkSession.createDataFrame([], "share int, levels array<struct<level:int,bits:bigint,filled:array<bigint>>>, rest array<string>")
    left = (inside if level % 2 == 0 else outside) if level == levels else universe.limit(0)
    rest = left.groupBy("share").agg(F.collect_set("key").alias("rest"))
    every = made.groupBy("share").agg(F.array_sort(F.collect_list(F.struct("level", "bits", "filled"))).alias("levels"))
    return settle(every.join(rest, "share", "left").select("share", "levels", F.coalesce("rest", F.array().cast("array<string>")).alias("rest")), "cascade")


def is_listed(key: Column, levels: Column, rest: Column) -> Column:
    """The first level without the key decides: at an odd place it is listed. A key in all has the last's side,
    unless keys are kept by name."""
    missed = F.array_position(F.transform(levels, lambda x, k: contains(key, k, x.bits, x.filled)), False)
    in_all = F.when(F.size(levels) < LEVELS, F.size(levels) % 2 == 1).otherwise(F.array_contains(rest, key))
    return F.coalesce(F.when(missed > 0, missed % 2 == 0).otherwise(in_all), F.lit(False))


def filter_urls(pages: DataFrame, listed: DataFrame | Column, rules=RULES, share_bits: int = SHARE_BITS, told_bits: int = TOLD_BITS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``listed`` is the list: a table with a column ``key`` (host and path together), or a condition on ``host``
    and ``path`` that the corpus's own keys are chosen by. A page's verdict is its rule's, else that
    of the cascade: block if its key is listed. Keys are dealt out to shares by hash, so that the filters of one have about
    ``share_bits``; the pages are read once, however many shares there are. Filters of ``told_bits``
    together are told to every task; beyond it the pages' keys go where their share's filters are. A
    null url has an empty host and path and no rule; repeated rows and keys give equal verdicts; of rules
    equally long the one that stands last in order of host, path and verdict holds; texts of any length count whole;
    an empty table, or an empty list, is no matter; other columns are left out, whatever their names.
    """
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("rule", name).withColumn("fixed", verdict).withColumn("key", F.concat("host", "path"))
    keys = rows.filter("fixed is null").select("key", "host", "path").distinct()
    told = keys.filter(F.coalesce(listed, F.lit(False))).select("key") if isinstance(listed, Column) else listed.select("key")
    here, there = F.lit(1).alias("here"), F.lit(0).alias("here")
    both = keys.select("key", here, F.lit(False).alias("listed")).unionByName(told.select("key", there, F.lit(True).alias("listed")))
    known = both.groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed")).filter("here = 1")
    universe = settle(known.select("key", "listed"), "universe")
    bits = 2 * BITS_A_KEY * universe.filter("listed").count()
    shares = max(1, math.ceil(bits / share_bits))
    cascade = build(universe.withColumn("share", share_of(F.col("key"), shares)))
    cascade = F.broadcast(cascade) if bits <= told_bits else cascade
    judged = rows.withColumn("share", share_of(F.col("key"), shares)).join(cascade, "share", "left")
    method = F.when(is_listed(F.col("key"), F.col("levels"), F.col("rest")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"))


def by_host(pattern: str = LISTED_HOST) -> Column:
    """The list of the query: keys whose host has a label of several words."""
    return F.col("host").rlike(pattern)
