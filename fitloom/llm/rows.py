"""Rows of any columns carried through an operator as one struct, so that no name of theirs can meet a name of its own.

Results are built by position: all columns of the rows in their order, then what the operator adds. A column that has the name of
an added one is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What is broadcast by hint, at most.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and more columns computed from them."""
    lean(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in more.items()])


def lean(spark: SparkSession) -> None:
    """Batches for Python of 8 MB, unless the session asks for another size than Spark's own: a worker's memory follows them."""
    if spark.conf.get(BATCH_BYTES, "64MB") in ("64MB", "67108864b", "67108864"):
        spark.conf.set(BATCH_BYTES, str(8 << 20))


def row_field(docs: DataFrame) -> T.StructField:
    """The field ``row`` in a result's schema."""
    return T.StructField("row", docs.schema, False)


def spread(rows: DataFrame, docs: DataFrame, **added: Column) -> DataFrame:
    """The columns of ``docs`` out of ``row``, then ``added``."""
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in added}]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in own], *[c.alias(n) for n, c in added.items()])


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has few rows and few bytes."""

    def size(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "string":
            return F.coalesce(F.octet_length(c), F.lit(0)) + 24
        if kind == "array<string>":
            return F.coalesce(F.octet_length(F.array_join(c, "")) + 24 * F.size(c), F.lit(24))
        return F.coalesce(8 * F.size(c), F.lit(0)) + 24 if kind.startswith("array") else F.lit(8)

    total = sum((size(c, kind) for c, kind in df.dtypes), F.lit(16)).cast("long")
    n, size_of = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size_of <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has few rows and few bytes."""
    return F.broadcast(df) if is_small(df) else df
