"""URL filters: host and path rules, and a blocked Bloom filter before an exact join, in DataFrame functions only.

The listed URLs are brought to a canonical form and hashed into 64-bit blocks, one block per URL, a few bits each. A
page whose block lacks one of its bits is surely not listed and is never shuffled; the possible hits are joined with
the list itself, which removes false positives, so the verdict is exact.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is not listed; repeated
rows are judged each on their own; null or repeated listed URLs count as none or once; empty tables and an empty list
work. All columns of the pages stay, except that the result's own columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
MAX_RULES = 1_000
#: Blocks are joined to the pages as a broadcast table up to this size, and by a shuffle on the block beyond it.
BROADCAST_BYTES = 64 << 20
BITS_PER_URL, BITS_SET = 16, 5
#: Shares into which the rows of one URL (or block) are dealt in a shuffled join.
SHARES = 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and default ports, path without closing slashes, and the query's
    parameters sorted, without those that only track. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)?$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    asked = F.array_join(kept, "&")
    whole = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(asked != "", F.concat(F.lit("?"), asked))
                     .otherwise(""))
    return F.when(host != "", whole)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule whose host is the given one or a parent domain and whose path starts the given one, as a
    struct (chars, host_chars, name, verdict), else null. Rules are a short list, held in the plan."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"At most {MAX_RULES} rules.")
    if not rules:
        return F.lit(None).cast("struct<chars:int,host_chars:int,verdict:string,name:string>")
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                   F.struct(F.lit(len(r.host + r.path)).alias("chars"), F.lit(len(r.host)).alias("host_chars"),
                            F.lit(r.verdict).alias("verdict"), F.lit(r.host + r.path).alias("name"))) for r in rules]
    return F.array_max(F.array(*fits))


def _bits(key: Column) -> Column:
    spread = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        bit = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocked filter of a column ``key``: block number and its 64 bits; empty blocks are left out."""
    placed = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), _bits(F.col("key")).alias("bits"))
    return placed.groupBy("block").agg(F.bit_or("bits").alias("word"))


def _dealt(df: DataFrame) -> DataFrame:
    return df.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url",
                listed_verdict: str = "block", other_verdict: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict and listed (whether the canonical URL is listed) to every page.

    A rule decides where one fits; else a listed URL gets ``listed_verdict`` and any other ``other_verdict``. One
    counting job sizes the filter from the number of distinct listed URLs.
    """
    keys = listed.select(canonical(F.col(f"`{listed_url}`")).alias("key")).where("key IS NOT NULL").distinct()
    blocks = max(1, keys.count() * BITS_PER_URL // 64)
    filter_ = bloom_blocks(keys, blocks).withColumnRenamed("block", "_block").withColumnRenamed("word", "_word")
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    shown = pages.withColumns({"host": host, "path": path}).withColumn(
        "_rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("_key", canonical(F.col(f"`{url}`")))
    shown = shown.withColumns({"_block": F.pmod(F.xxhash64("_key"), F.lit(blocks)), "_bits": _bits(F.col("_key"))})
    if blocks * 16 <= BROADCAST_BYTES:
        probed = shown.join(F.broadcast(filter_), "_block", "left")
    else:
        # Rows without a key get shares of their own, so they do not meet in one task.
        dealt = shown.withColumn("_share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARES)))
        probed = dealt.join(_dealt(filter_), ["_block", "_share"], "left").drop("_share")
    possible = F.coalesce((F.col("_key").isNotNull()) & (F.col("_word").bitwiseAND(F.col("_bits")) == F.col("_bits")),
                          F.lit(False))
    probed = probed.withColumn("_possible", possible)
    missed = probed.where(~F.col("_possible")).withColumn("listed", F.lit(False))
    hits = probed.where("_possible").withColumn(
        "_share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARES)))
    exact = _dealt(keys.withColumnRenamed("key", "_key")).withColumn("_found", F.lit(True))
    hits = hits.join(exact.hint("shuffle_hash"), ["_key", "_share"], "left").withColumn(
        "listed", F.coalesce("_found", F.lit(False)))
    judged = missed.unionByName(hits.select(*missed.columns))
    method = F.when(F.col("listed"), listed_verdict).otherwise(other_verdict)
    judged = judged.withColumns({"rule": F.col("_rule.name"), "verdict": F.coalesce(F.col("_rule.verdict"), method)})
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", "verdict", "listed")
