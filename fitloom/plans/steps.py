"""Steps of a plan that the optimizer leaves whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each worked out once: what is asked of them later is not pushed below a generator, where all that they are made of
    would be repeated for each time they are named."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def met(given: DataFrame, key: str, **columns: Column) -> DataFrame:
    """One row per value of ``key`` with aggregates of its rows in ``given``. Values must have few rows each. Other than a grouping, whose lists are sorted and copied
    twice, before and after a shuffle, rows are sorted once by ``key``, and not at all if they lie in that order."""
    own, at = W.partitionBy(key), F.monotonically_increasing_id().alias("__at")
    found = given.select("*", at).select(key, *[c.over(own).alias(n) for n, c in columns.items()], "__at", F.max("__at").over(own).alias("__last"))
    return found.filter("__at = __last").drop("__at", "__last")
