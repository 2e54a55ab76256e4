"""URL rules behind a blocked Bloom filter, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A filter of more words than this is probed by a join instead of an array in the plan.
LITERAL_WORDS = 1 << 16


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty if there is no :// or no url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or #; empty if there is no :// or no url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _bits(host: Column, path: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a key, and the two 64-bit words of its mask: three bits, all in one 128-bit block."""
    h = F.xxhash64(host, path)
    block = F.pmod(F.shiftright(h, 40), F.lit(blocks)).cast("int")
    bits = [F.pmod(F.shiftright(h, s), F.lit(128)).cast("int") for s in (0, 11, 22)]
    return block, _mask(bits, 0), _mask(bits, 1)


def _mask(bits: list[Column], w: int) -> Column:
    out = F.lit(0).cast("bigint")
    for b in bits:
        inside = b - 64 * w
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), inside)
        out = out.bitwiseOR(F.when(inside.between(0, 63), bit).otherwise(F.lit(0).cast("bigint")))
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", keep: list[str] = (), bits_per_rule: int = 16) -> DataFrame:
    """The columns `keep` of pages, and host, path, rule and verdict of column url, one row for each row of pages.

    rules (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with its path; the
    longest host and path together wins, then the longer host, then block. Every listed key enters a blocked Bloom
    filter; a url's candidate keys (host suffixes at dots, path prefixes of the lengths that rules have) are probed
    there, and only possible hits, each host and path once, go to the hash join with the rules, which drops false
    positives. Urls meet their verdict by host and path, so a recomputed part gives the same rows. Urls without a rule
    get `default`. A null url, or one without ://, has an empty host and path. Repeated rows are judged each for itself;
    rules with a null are ignored, and of equal rules one counts (block first)."""
    spark = pages.sparkSession
    listed = rules.where("host is not null and path is not null and verdict is not null")
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    facts = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    n, lengths, labels = facts["n"], sorted(facts["lengths"]), facts["labels"] or 1
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n) * bits_per_rule / 128)))
    block, low, high = _bits(F.col("host"), F.col("path"), blocks)
    filled = listed.select(block.alias("block"), low.alias("low"), high.alias("high")).groupBy("block").agg(F.expr("bit_or(low)").alias("low"), F.expr("bit_or(high)").alias("high"))

    own = [F.col(f"`{c}`") for c in keep]
    base = pages.select(*own, url_host(F.col("url")).alias("_host"), url_path(F.col("url")).alias("_path"))
    parts = F.split("_host", r"\.")
    count = F.size(parts)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), count - labels + 1), count), lambda i: F.array_join(F.slice(parts, i, count), "."))
    fits = F.filter(F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>"), lambda x: x <= F.length("_path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(fits, lambda x: F.struct(h.alias("host"), F.substring(F.col("_path"), F.lit(1), x).alias("path")))))
    small = 2 * blocks <= LITERAL_WORDS
    if small:
        words = {r["block"]: (r["low"], r["high"]) for r in filled.collect()}  # at most LITERAL_WORDS longs
        lows, highs = ([words.get(i, (0, 0))[k] for i in range(blocks)] for k in (0, 1))
        table = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])

        def maybe(k):
            at, a, b = _bits(k["host"], k["path"], blocks)
            return (F.element_at(table(lows), at + 1).bitwiseAND(a) == a) & (F.element_at(table(highs), at + 1).bitwiseAND(b) == b)

        possible = F.filter(keys, maybe)
        met = base.where(F.size(possible) > 0)
        hits = met.select("_host", "_path").distinct().select("_host", "_path", F.explode(possible).alias("k")).select("_host", "_path", "k.host", "k.path")
    else:
        met = base
        probe = base.select("_host", "_path").distinct().select("_host", "_path", F.explode(keys).alias("k")).select("_host", "_path", "k.host", "k.path")
        at, a, b = _bits(F.col("host"), F.col("path"), blocks)
        probe = probe.withColumns({"block": at, "_a": a, "_b": b}).join(filled, "block")
        hits = probe.where("low & _a = _a and high & _b = _b").select("_host", "_path", "host", "path")
    exact = F.broadcast(listed) if n <= 10_000 else listed
    best = F.max(F.struct((F.length("host") + F.length("path")).alias("l"), F.length("host").alias("h"), F.col("verdict"), F.concat("host", "path").alias("rule")))
    found = hits.join(exact, ["host", "path"]).groupBy("_host", "_path").agg(best.alias("_best")).select("_host", "_path", "_best.verdict", "_best.rule")
    named = lambda df: df.select(*own, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    judged = named(met.join(found, ["_host", "_path"], "left"))
    if not small:
        return judged
    none = F.lit(None).cast("string")
    return judged.unionByName(named(base.where(F.size(possible) == 0).withColumns({"rule": none, "verdict": none})))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url under the four rules; urls that no rule fits are allowed, as the list does not hold them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules, keep=["page_id"])


OP3_SQL = """
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path,
  (select h || p from rules where (host = h or host like '%.' || h) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
  coalesce((select v from rules where (host = h or host like '%.' || h) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from parts
"""
