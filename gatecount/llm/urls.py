"""URL filters: prefix rules, then a list of canonical URLs behind a blocked Bloom filter.

`canonical` names a page regardless of scheme, "www.", query, fragment, trailing slash and ".html". The listed canonical
URLs are hashed into blocks of eight 64-bit words, one bit per word; the filter is a table of blocks, built by one
aggregation and probed by a join on the block number, so that it is spread like any table and broadcast only while
Spark finds it below the session's threshold. Possible hits go on to an exact join with the list, which removes the
false positives. A very frequent URL is a frequent join key: the adaptive skew join splits it, as the list's side has
one row per key.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and is on no list; null list
entries are ignored and repeated ones count once; each row of a repeated page is judged; empty tables and an empty list
(everything without a rule is allowed) are fine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecount.llm.common import fresh, written

WORDS = 8
BITS_PER_URL = 16
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, CAPITALS, SMALL)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Null where there is no host."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/+)$", "")))


def by_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def masks(url: Column) -> list[Column]:
    """The bit of each word, from a second hash."""
    second = F.xxhash64(F.lit("bits"), url)
    bit = lambda i: F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit(i)) for i in range(WORDS)]


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """block, words: a row per block that has a bit set."""
    bits = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks(F.col(url)))]
    merged = listed.groupBy(block(F.col(url), blocks).alias("block")).agg(*bits)
    return merged.select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, listed_url: str = "canonical", url: str = "url") -> DataFrame:
    """`pages` plus a struct column `judged` (or the next free name): host, path, rule, verdict.

    `listed` holds canonical URLs in the column `listed_url`; what is on it is blocked unless a rule says otherwise.
    """
    out, name, number, key = (fresh(pages, n) for n in ("judged", "canonical_url", "bloom_block", "possible_url"))
    h, p = host(F.col(f"`{url}`")), path(F.col(f"`{url}`"))
    rule, verdict = by_rules(F.col(f"{out}.host"), F.col(f"{out}.path"), rules)
    parsed = (
        pages.withColumn(out, F.struct(h.alias("host"), p.alias("path")))
        .withColumn(out, F.col(out).withField("rule", rule).withField("verdict", verdict))
        .withColumn(name, F.when(F.col(f"{out}.verdict").isNull(), canonical(F.col(f"{out}.host"), F.col(f"{out}.path"))))
    )
    urls = listed.select(F.col(f"`{listed_url}`").cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    urls = written(urls, "listed")
    blocks = max(1, -(-urls.count() * BITS_PER_URL // (64 * WORDS)))
    words = fresh(parsed, "bloom_words")
    table = bloom(urls, key, blocks).select(F.col("block").alias(number), F.col("words").alias(words))
    # What need not be probed gets a block and a key of its own that match nothing, so that nulls are no frequent key.
    nowhere = -1 - F.abs(F.xxhash64(F.col(f"`{url}`")) % 1_000_000)
    probed = parsed.withColumn(number, F.coalesce(block(F.col(name), blocks), nowhere)).join(table, number, "left")
    hit = F.col(words).isNotNull()
    for i, m in enumerate(masks(F.col(name))):
        hit = hit & (F.col(words)[i].bitwiseAND(m) != 0)
    possible = probed.withColumn(key, F.when(hit, F.col(name)).otherwise(F.concat(F.lit(" "), F.col(number))))
    sure = fresh(possible, "on_list")
    exact = possible.join(urls.withColumn(sure, F.lit(True)), key, "left")
    final = F.coalesce(F.col(f"{out}.verdict"), F.when(F.col(sure), F.lit("block")).otherwise(F.lit("allow")))
    return exact.withColumn(out, F.col(out).withField("verdict", final)).drop(name, number, words, key, sure)
