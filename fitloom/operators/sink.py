"""The sink of results: only analyses whose inputs changed are worked out and written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from fitloom.plans.parts import Parts
from fitloom.plans.scratch import Scratch


def input_fingerprint(**tables: DataFrame) -> DataFrame:
    """analysis_id and fingerprint of all rows that the named tables have for it. Neither the order of rows nor of columns matters; repeated
    rows, null fields, names of columns and which table a row is in do. Rows are summed as digests, so no group is gathered. Rows without an
    analysis_id count for none."""
    digests = None
    for name, rows in sorted(tables.items()):
        row = F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
        digest = F.sha2(F.concat(F.lit(f"{name}\n"), F.to_json(row, {"ignoreNullFields": "false"})), 256)
        mine = rows.filter("analysis_id is not null").select(F.col("analysis_id").cast("long").alias("analysis_id"), digest.alias("digest"))
        digests = mine if digests is None else digests.unionByName(mine)
    # 128 bits of each digest, in halves of hashes: sums of 32 bits stay plain longs up to 2^31 rows of an analysis.
    digests = digests.select("analysis_id", *[F.xxhash64(F.lit(i), "digest").alias(f"h{i}") for i in range(2)])
    sums = [F.sum(half(F.col(f"h{i}"))) for i in range(2) for half in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(0xFFFFFFFF))]
    return digests.groupBy("analysis_id").agg(F.concat_ws("-", F.count(F.lit(1)), *sums).alias("fingerprint"))


class Sink:
    """Results of ``compute`` by analysis under ``path``. ``compute`` takes a table of analysis_id and returns results (analysis_id, ...)
    of those analyses, one row each or none."""

    def __init__(self, spark: SparkSession, path: str, compute: Callable[[DataFrame], DataFrame]):
        self.spark, self.compute = spark, compute
        shape = compute(spark.createDataFrame([], "analysis_id long")).schema
        schema = StructType().add("analysis_id", LongType()).add("fingerprint", StringType()).add("present", BooleanType())
        self.store = Parts(spark, path, schema.add("result", StructType([f for f in shape.fields if f.name != "analysis_id"])))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """analysis_id, fingerprint, present and part of the newest row of each analysis; results aren't read for it."""
        newest = F.max(F.struct("part", "fingerprint", "present")).alias("n")
        return rows.groupBy("analysis_id").agg(newest).select("analysis_id", "n.*")

    def refresh(self, inputs: DataFrame) -> int:
        """Bring the results up to ``inputs`` (analysis_id, fingerprint; an analysis once): new and changed analyses are worked out and
        written as one part, those that inputs no longer have are marked as gone. Returns how many rows were written; without any nothing is.
        A run that breaks leaves the results as they were."""
        scratch = Scratch(self.spark, "sink")
        was = self._newest(self.store.read()).select("analysis_id", F.col("fingerprint").alias("was"), "present")
        rows = inputs.select("analysis_id", "fingerprint").join(was, "analysis_id", "full_outer")
        here = F.col("fingerprint").isNotNull()
        same = F.coalesce((F.col("fingerprint") == F.col("was")) & F.col("present"), F.lit(False))
        rows = rows.filter((here & ~same) | (~here & F.coalesce("present", F.lit(False))))
        try:
            rows = scratch.keep(rows.select("analysis_id", "fingerprint", here.alias("present")), "changed")
            count = rows.count()
            if count:
                results = self.compute(rows.filter("present").select("analysis_id"))
                names = [f.name for f in self.store.schema["result"].dataType]
                results = results.select("analysis_id", F.struct(*[F.col(f"`{n}`") for n in names]).alias("result"))
                self.store.add(rows.join(results, "analysis_id", "left"))
        finally:
            scratch.drop(*scratch.names, "changed")
        return count

    def read(self) -> DataFrame:
        """The results as they are now, with the part each came in."""
        rows = self.store.read()
        newest = self._newest(rows).filter("present").select("analysis_id", "part")
        return rows.filter(F.col("result").isNotNull()).join(newest, ["analysis_id", "part"], "left_semi").select("analysis_id", "result.*", "part")
