"""Joins of whole texts with a table of some documents' keys, that shuffle no text of which it is plain that nothing meets it.

The keys go into a blocked bit filter, which is broadcast and never larger than ``FILTER_BYTES``: about 20 million keys have 12 bits
each, more keys have fewer. A row whose bits aren't all set meets nothing and stays where it is; the others are shuffled and joined
by the keys themselves, so a chance hit costs a row's way and changes no result.

Defined results: those of Spark's own join. A null key meets nothing; repeated rows and keys, texts of any length and empty tables are
fine; columns of ``rows`` and ``wanted`` other than the key have different names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.urlfilter import BITS_PER_URL, WORDS, _bits, _block, bloom

FILTER_BYTES = 32 << 20


def flagged(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``maybe``: true for all that have their key in ``wanted``, and for few others."""
    most = FILTER_BYTES // (8 * (WORDS + 1))
    n_blocks = min(most, max(1, -(-wanted.count() * BITS_PER_URL // (64 * WORDS))))
    hashed = F.xxhash64(*key)
    blocks = bloom(wanted.select(hashed.alias("hashed")), "hashed", n_blocks)
    met = rows.withColumn("hashed", hashed).withColumn("block", _block(F.col("hashed"), n_blocks)).join(F.broadcast(blocks), "block", "left")
    maybe = F.lit(True)
    for i, bit in enumerate(_bits(F.col("hashed"))):
        maybe = maybe & F.coalesce(F.col(f"w{i}").bitwiseAND(bit) != 0, F.lit(False))
    return met.select(*rows.columns, maybe.alias("maybe"))


def sifted(rows: DataFrame, wanted: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows.join(wanted, key, how)`` with the columns of ``rows`` first. how: inner, left, left_semi or left_anti."""
    both = flagged(rows, wanted, key)
    met = both.filter("maybe").drop("maybe").join(wanted, key, how)
    added = [] if how in ("left_semi", "left_anti") else [c for c in wanted.columns if c not in key]
    met = met.select(*rows.columns, *added)
    if how in ("inner", "left_semi"):
        return met
    rest = both.filter("NOT maybe").select(*rows.columns, *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in added])
    return met.union(rest)
