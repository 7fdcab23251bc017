"""URL rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks (eight 64-bit words, one bit set in each word per URL), built by bit_or. Pages
meet the block of their URL's hash; those whose bits are all set are possible hits and go on to an exact hash join with
the list, which removes false positives. Up to ``BROADCAST_BYTES`` of blocks are broadcast (their number is counted
first); a larger filter is joined by block. Neither the list nor the filter passes through the driver.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and is not listed; nulls in a
list are ignored; repeated URLs and pages are fine; an empty list blocks nothing; very long URLs are read by position; columns
named like the added ones are replaced. Hot URLs are split by the adaptive skew join, as the list has one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.rows import packed, spread
from fitloom.plans.scratch import Scratch

BITS_PER_URL = 12
WORDS = 8
BROADCAST_BYTES = 32 << 20
#: Rules stand in the plan as a CASE, longest first.
MAX_RULES = 1000
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]*|ref)="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What stands behind the first ``://``; empty without one. Found by position: no pattern has to walk a long URL."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    page = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(page, "/")
    return F.when(at > 0, F.substr(page, at)).otherwise("")


def canonical(url: Column) -> Column:
    """Host without www., path without its last slashes, and the query's other parameters in order; null without a host."""
    page = F.substring_index(url, "#", 1)
    at = F.instr(page, "?")
    query = F.when(at > 0, F.substr(page, at + 1)).otherwise("")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    host = host_of(url)
    host = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)
    page = F.concat(host, F.rtrim(path_of(url), F.lit("/")), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", page)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host || path, and its verdict. rules: (verdict, host, path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; put single URLs in the list")
    name = verdict = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit(1))
    places = [F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def bloom(urls: DataFrame, column: str, n_blocks: int) -> DataFrame:
    """block and its words w0 to w7, of distinct non-null URLs."""
    c = F.col(column)
    bits = [b.alias(f"b{i}") for i, b in enumerate(_bits(c))]
    return urls.select(_block(c, n_blocks).alias("block"), *bits).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def listed(pages: DataFrame, urls: DataFrame, column: str = "canonical") -> DataFrame:
    """``pages`` with ``listed``: whether their ``column`` is among the column of that name in ``urls``."""
    known = Scratch(pages.sparkSession, "url-list").keep(urls.select(column).filter(F.col(column).isNotNull()).distinct(), "known")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column) + 16), F.lit(0))).first()
    n_blocks = max(1, -(-n * BITS_PER_URL // (64 * WORDS)))
    blocks = bloom(known, column, n_blocks)
    if n_blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    probe = packed(pages, url=F.col(column))
    probe = probe.withColumn("block", _block(F.coalesce("url", F.lit("")), n_blocks)).join(blocks, "block", "left")
    maybe = F.col("url").isNotNull()
    for i, bit in enumerate(_bits(F.col("url"))):
        maybe = maybe & F.coalesce(F.col(f"w{i}").bitwiseAND(bit) != 0, F.lit(False))
    # A miss has no flag, so it joins nothing; its URL still spreads it over the tasks.
    probe = probe.select("row", "url", F.when(maybe, F.lit(1)).alias("hit"))
    exact = known.select(F.col(column).alias("url"), F.lit(1).alias("hit"), F.lit(True).alias("there"))
    found = probe.join(F.broadcast(exact) if size <= BROADCAST_BYTES else exact, ["url", "hit"], "left")
    return spread(found, pages, listed=F.coalesce("there", F.lit(False)))


def judge(pages: DataFrame, urls: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, canonical, rule, listed and verdict: the longest rule's, else block if listed, else allow."""
    rows = packed(pages, host=host_of(F.col(url)), path=path_of(F.col(url)), canonical=canonical(F.col(url)))
    rows = listed(rows, urls)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return spread(rows, pages, host=F.col("host"), path=F.col("path"), canonical=F.col("canonical"), rule=rule, listed=F.col("listed"), verdict=F.coalesce(said, method))
