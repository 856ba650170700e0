"""URL filters: policy rules, then a blocked Bloom filter of listed canonical
URLs whose possible hits an exact hash join confirms. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.common import ascii_lower

WORDS = 8                    # 32-bit words of a Bloom block; a key sets one bit in each
KEYS_PER_BLOCK = 21          # 256 bits / about 12 bits a key: near 0.5 % false positives
BROADCAST_BLOCKS = 1 << 18   # at most 10 MB of words are broadcast; beyond it, joined by block
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|\z)"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str             # "allow" or "block"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty for a null url
    or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def canonical_url(url: Column) -> Column:
    """One spelling per address: no scheme, lower-case host without default
    port, no fragment, no trailing slashes, query parameters sorted and
    without tracking ones. Null for a null url or one without ``://``."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1),
                                 lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    args = F.array_join(kept, "&")
    return F.when(F.contains(url, F.lit("://")), F.concat(
        F.regexp_replace(host, r":(80|443)\z", ""), F.regexp_replace(path, r"/+\z", ""),
        F.when(args != "", F.concat(F.lit("?"), args)).otherwise(F.lit(""))))


def by_rule(host: Column, path: Column, rules: Sequence[Rule], value: Callable[[Rule], str]) -> Column:
    """``value`` of the rule that decides, or null."""
    out = F.lit(None).cast("string")
    for r in reversed(ordered_rules(rules)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def ordered_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Longest first; of equally long ones a block, then by name."""
    return sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "block", r.host, r.path))


def bloom_bits(key: Column, blocks: int) -> tuple[Column, Column, list[Column]]:
    """Block number of a key, its bits, and from the column ``_bits`` that
    holds them the mask of each word of the block."""
    masks = [F.expr(f"shiftleft(1, cast((shiftrightunsigned(_bits, {5 * i}) & 31) as int))") for i in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), F.xxhash64(key, F.lit("bits")), masks


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: one row per block that holds a key, with its
    eight words. Built with partial bitwise sums, so a task sends at most one
    row per block."""
    block, bits, masks = bloom_bits(F.col(key), blocks)
    return (keys.select(block.alias("_block"), bits.alias("_bits"))
            .select("_block", *[m.alias(f"_w{i}") for i, m in enumerate(masks)])
            .groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)]))


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), *,
                 id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """Judge every url of ``pages``: one row per input row (repeated rows
    included) with ``id_col, host, path, canonical, rule, listed, verdict``.

    The deciding rule is the longest that fits (its host or a subdomain of it,
    and a path that starts with the rule's). Without a rule, a page is blocked
    if its canonical URL is listed. The Bloom filter of the listed URLs passes
    few others; a hash join with the listed URLs removes those. Pages that the
    filter rules out bypass the join and its shuffle. A listed URL that a third of
    all pages carry is one build row; its probe side is split by AQE.

    Null url, or one without ``://``: host and path empty, no rule, allowed.
    Null or malformed listed URLs list nothing. Empty ``pages`` gives no rows;
    an empty list allows all that no rule blocks. Other columns of the inputs
    are not read. ``rules`` is a policy of the size of a configuration file.
    """
    keys = (listed.select(canonical_url(F.col(listed_col)).alias("_key")).where(F.col("_key").isNotNull())
            .distinct())
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"),
                        canonical_url(F.col(url_col)).alias("canonical"))
    block, bits, masks = bloom_bits(F.col("canonical"), blocks)
    probe = rows.withColumns({"_block": block, "_bits": bits})
    filter_table = bloom_filter(keys, "_key", blocks)
    if blocks <= BROADCAST_BLOCKS:
        filter_table = F.broadcast(filter_table)
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) != 0)
    possible = F.coalesce(hit, F.lit(False)) & F.col("canonical").isNotNull()
    probe = probe.join(filter_table, "_block", "left").select(F.col(id_col), "host", "path", "canonical", possible.alias("_possible"))
    hits = probe.where("_possible").join(keys.hint("shuffle_hash"), F.col("canonical") == F.col("_key"), "left")
    joined = hits.unionByName(probe.where("not _possible").withColumn("_key", F.lit(None).cast("string")))
    ruled = lambda value: by_rule(F.col("host"), F.col("path"), rules, value)
    is_listed = F.col("_key").isNotNull()
    return joined.select(
        F.col(id_col), "host", "path", "canonical", ruled(lambda r: r.host + r.path).alias("rule"),
        is_listed.alias("listed"),
        F.coalesce(ruled(lambda r: r.verdict), F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))
                   ).alias("verdict"))
