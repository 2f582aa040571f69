"""Operator 12: URL filters, native: a Bloom filter cascade over the keys that the corpus can ask for.

A key is a host, or part of one from a dot on, and the beginning of a path. Listed keys set the bits of the first filter. Every key that
some URL can match goes through it; those that pass without being listed are its false positives, and set the bits of the second
filter. The listed keys that pass that one set the bits of the third, and so on until none passes by mistake. For every key of the corpus the
cascade then answers exactly, without a join, from bits in proportion to the listed keys. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import shared

BITS_A_KEY, HASHES = 10, 7
#: Bits of one of Spark's bitmaps, of which a filter has one or more.
_BITMAP = 32_768
#: Bytes that a filter may have to go along with the tasks; longer lists are joined instead.
MOST_BYTES = 8_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed rules of the query: host and the beginning of the path, and the verdict.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Fixed words: hosts with such a word between dots or hyphens, and all below them, are on the block list that the query draws from the pages.
WORDS = ["ads", "adult", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "track", "tracker", "tracking", "viagra", "xxx"]


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null, or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _shapes(listed: DataFrame) -> list[tuple[int, int]]:
    """(labels, code points of the path) of the listed keys: as many as there are different ones."""
    host = F.substring_index("key", "/", 1)
    return sorted(map(tuple, listed.select(F.size(F.split(host, r"\.")), F.char_length("key") - F.char_length(host)).distinct().collect()))


def _keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """An array of (length, host's length, key): what a URL can match among keys of these shapes. Longer ones are greater."""

    def one(labels: int, chars: int) -> Column:
        end = F.substring_index(host, ".", -labels)
        fits = (F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) >= labels - 1) & (F.char_length(path) >= chars)
        key = F.concat(end, F.substring(path, 1, chars))
        return F.when(fits, F.struct(F.char_length(key).alias("length"), F.char_length(end).alias("host_length"), key.alias("key")))

    if not shapes:
        return F.array().cast("array<struct<length:int,host_length:int,key:string>>")
    return F.filter(F.array(*(one(*s) for s in shapes)), lambda k: k.isNotNull())


class _Filter:
    """A Bloom filter: ``HASHES`` bits of every key are set, by double hashing with the filter's own seeds."""

    def __init__(self, keys: DataFrame, n: int, seed: int):
        self.seed, self.buckets = seed, size_of(n) // (_BITMAP // 8)
        places = keys.select(F.explode(F.array(*(self._place(F.col("key"), i) for i in range(HASHES)))).alias("place"))
        rows = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        found = {r.bucket: bytes(r.bits) for r in rows.collect()}  # the filter, of ``MOST_BYTES`` at most
        self.bits = b"".join(found.get(b, bytes(_BITMAP // 8)) for b in range(1, self.buckets + 1))

    def _place(self, key: Column, i: int) -> Column:
        """From 1."""
        first, step = F.xxhash64(key, F.lit(2 * self.seed)), F.xxhash64(key, F.lit(2 * self.seed + 1))
        # halves, so that no sum passes 64 bits
        return F.pmod(F.shiftright(first, 2) + F.lit(i) * F.shiftright(step, 6), F.lit(self.buckets * _BITMAP).cast("long")) + 1

    def passes(self, key: Column) -> Column:
        def bit(i: int) -> Column:
            at = self._place(key, i) - 1
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        return reduce(lambda a, b: a & b, (bit(i) for i in range(HASHES)))


def size_of(n: int) -> int:
    """Bytes of the filter of ``n`` keys: whole bitmaps."""
    return max(1, -(-n * BITS_A_KEY // _BITMAP)) * (_BITMAP // 8)


class Cascade:
    """Filters whose answers for every key of ``universe`` (column ``key``) are exact: whether it is one of ``listed`` (``key``, distinct)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.filters: list[_Filter] = []
        inside, outside, n = listed, None, listed.count()
        while n:
            self.filters.append(_Filter(inside, n, len(self.filters)))
            passes = self.filters[-1].passes(F.col("key"))
            if outside is None:  # the first filter: all keys of the corpus, of which those move on that pass
                wrong = universe.where(passes).distinct().join(listed.hint("merge"), "key", "left_anti")
            else:
                wrong = outside.where(passes)
            inside, outside = shared.stored(wrong, "wrong"), inside
            n = inside.count()

    def holds(self, key: Column) -> Column:
        answer = F.lit(False)
        for level in reversed(self.filters):
            answer = level.passes(key) & ~answer
        return answer


def url_verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` are (key, verdict), a key like ``example.com/en/``: it fits its host and all below, if the path starts with the key's. The longest fitting
    one wins (of equally long ones that of the longer host) and is ``rule``; one that is listed to allow and to block blocks. Without a rule, a URL is
    blocked if a key of ``listed`` (key) fits it, else allowed. Null keys are left out, keys are taken as lower case already.

    A null URL and one without ``://`` have an empty host and path; repeated rows each give one; an empty table gives no rows; columns called host, path, rule or
    verdict are replaced. Lists whose filter would pass ``most_bytes`` are joined instead, with the same answers.
    """
    host, path = parsed(F.col(url_col))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    host, path = F.col("host"), F.col("path")
    block = shared.stored(rules.where("verdict = 'block' and key is not null").select("key").distinct(), "block")
    allow = shared.stored(rules.where("verdict = 'allow' and key is not null").select("key").distinct(), "allow")
    listed = shared.stored(listed.where("key is not null").select("key").distinct(), "listed")
    if max(size_of(x.count()) for x in (block, allow, listed)) > most_bytes:
        return _joined(pages, block, allow, listed)
    ruled, of_list = sorted({*_shapes(block), *_shapes(allow)}), _shapes(listed)
    universe = lambda shapes: pages.select(F.explode(_keys(host, path, shapes)).alias("k")).select("k.key")
    blocks, allows, lists = Cascade(block, universe(ruled)), Cascade(allow, universe(ruled)), Cascade(listed, universe(of_list))
    fitting = F.filter(_keys(host, path, ruled), lambda k: blocks.holds(k["key"]) | allows.holds(k["key"]))
    judged = pages.select("*", F.explode(F.array(F.array_max(fitting)["key"])).alias("rule"))  # through a generator of one row, so it is worked out once
    by_rule = F.when(blocks.holds(F.col("rule")), "block").otherwise("allow")
    by_list = F.when(F.exists(_keys(host, path, of_list), lambda k: lists.holds(k["key"])), "block").otherwise("allow")
    return judged.withColumn("verdict", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_list))


def _joined(pages: DataFrame, block: DataFrame, allow: DataFrame, listed: DataFrame) -> DataFrame:
    """The same by joins on the keys, for lists of any length."""
    every = block.select("key", F.lit(3).alias("kind")).unionByName(allow.select("key", F.lit(2).alias("kind"))).groupBy("key").agg(F.max("kind").alias("kind"))
    every = every.unionByName(listed.select("key", F.lit(1).alias("kind")))
    places = pages.select("host", "path").distinct()
    keys = places.select("host", "path", F.explode(_keys(F.col("host"), F.col("path"), _shapes(every))).alias("k")).select("host", "path", "k.*")
    found = keys.join(every.hint("merge"), "key").groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") > 1, F.struct("length", "host_length", "key", "kind"))).alias("best"), F.max("kind").alias("kind")
    )
    found = found.select("host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.kind"), F.when(F.col("kind") == 1, 3)).alias("kind"))
    return pages.join(found.hint("merge"), ["host", "path"], "left").withColumn("verdict", F.when(F.col("kind") == 3, "block").otherwise("allow")).drop("kind")


def rules_of(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in rules))))


def hosts_with(pages: DataFrame, words: Sequence[str] = WORDS, url_col: str = "url") -> DataFrame:
    """(key): the hosts of ``pages``, from a label on that has one of ``words`` between hyphens; never from the last label on."""
    host, _ = parsed(F.col(url_col))
    labels = pages.select(host.alias("host")).distinct().select("host", F.size(F.split("host", r"\.")).alias("n"), F.posexplode(F.split("host", r"\.")).alias("place", "label"))
    bad = labels.where((F.col("place") < F.col("n") - 1) & F.arrays_overlap(F.split("label", "-"), F.array(*map(F.lit, words))))
    return bad.select(F.expr("substring_index(host, '.', place - n)").alias("key")).distinct()


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, rules_of(spark), hosts_with(pages)).select("page_id", "host", "path", "rule", "verdict")


OP12_SQL = r"""
with parts as (
    select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), urls as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(rule, verdict) as (
    values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), split_rules as (
    select rule, verdict, split_part(rule, '/', 1) as h, substr(rule, length(split_part(rule, '/', 1)) + 1) as p from rules
), judged as (
    select u.page_id, u.host, u.path, r.rule, r.verdict
    from (select *, row_number() over () as id from urls) u
    left join split_rules r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)
    qualify row_number() over (partition by u.id order by length(r.rule) desc nulls last) = 1
), bad as (
    select host, string_split(host, '.') as labels from (select distinct host from urls)
)
select page_id, host, path, rule, coalesce(verdict, case when host in (
    select host from bad where list_bool_or(list_transform(labels[1:-2], lambda x: list_has_any(string_split(x, '-'), ['ads', 'adult', 'bet', 'bets', 'casino', 'gambling', 'pills', 'poker', 'porn', 'sex', 'spam', 'track', 'tracker', 'tracking', 'viagra', 'xxx'])))
) then 'block' else 'allow' end) as verdict
from judged
"""
