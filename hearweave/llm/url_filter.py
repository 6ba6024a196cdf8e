"""URL rules: a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearweave.llm.common import unused

#: Bits of the filter for each listed URL, and the most blocks of 256 bits (8 MB) that are broadcast.
#: A longer list fills them more, so more URLs pass to the exact join.
BITS, MAX_BLOCKS = 16, 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end; A-Z in lower case) and path (up to ? or #).

    Both are empty for null and where there is no ://.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _block(n: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), *key), F.lit(n))


def _bits(*key: str) -> list[Column]:
    """One bit in each of a block's four words."""
    h = F.xxhash64(F.lit(2), *key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(4)]


def bloom_blocks(listed: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of the key columns of listed: (block, w0..w3), and its number of blocks."""
    n = min(MAX_BLOCKS, max(1, listed.count() * BITS // 256))
    bits = listed.select(_block(n, *key).alias("block"), *(b.alias(f"b{k}") for k, b in enumerate(_bits(*key))))
    return bits.groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"w{k}") for k in range(4))), n


def possible(candidates: DataFrame, listed: DataFrame, *key: str) -> DataFrame:
    """The rows of candidates whose key the Bloom filter of listed may hold."""
    blocks, n = bloom_blocks(listed, *key)
    keyed = candidates.withColumns({"_block": _block(n, *key), **{f"_b{k}": b for k, b in enumerate(_bits(*key))}})
    passed = keyed.join(F.broadcast(blocks), keyed["_block"] == blocks["block"])
    for k in range(4):
        passed = passed.where(F.col(f"w{k}").bitwiseAND(F.col(f"_b{k}")) != 0)
    return passed.select(*candidates.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that fits, else null) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts
    with its path. The longest fitting rule wins; of rules listed twice the least verdict holds. A
    URL that is on no list has the verdict otherwise.

    Each distinct URL is looked up once, so a URL of many rows costs no more than others. Null URLs
    and those without :// have empty host and path and fit no rule but one with an empty path and
    host. An empty table stays empty; without rules every URL has the verdict otherwise. Other columns are kept; those named as the results are replaced.
    """
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    listed = rules.select(F.col("host").alias("_host"), F.col("path").alias("_start"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"))
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]

    asked, answer = unused(pages, "__url"), unused(pages, "_best")
    host, path = host_and_path(F.col("__url"))
    urls = pages.select(F.col(url).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    urls = urls.withColumns({"_whole": host, "_path": path})
    labels = F.split("_whole", r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    starts = F.transform(
        F.filter(F.array(*map(F.lit, sorted(lengths))) if lengths else F.array().cast("array<int>"), lambda k: k <= F.length("_path")),
        lambda k: F.substring(F.col("_path"), F.lit(1), k),
    )
    candidates = urls.select("__url", F.explode(hosts).alias("_host"), starts.alias("_starts"))
    candidates = candidates.select("__url", "_host", F.explode("_starts").alias("_start"))
    exact = possible(candidates, listed, "_host", "_start").join(listed, ["_host", "_start"])
    best = exact.groupBy("__url").agg(
        F.max_by(F.struct("_rule", "_verdict"), F.struct(F.length("_rule"), "_rule")).alias(answer)
    )
    best = best.withColumnRenamed("__url", asked)

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))
    joined = pages.select(*kept, host.alias("host"), path.alias("path")).join(best, F.col(url) == F.col(asked), "left")
    return joined.select(
        *kept, "host", "path", F.col(f"{answer}._rule").alias("rule"), F.coalesce(F.col(f"{answer}._verdict"), F.lit(otherwise)).alias("verdict")
    )
