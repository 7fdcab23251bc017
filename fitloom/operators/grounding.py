"""Quotes against the text they are said to come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.functions import text as T

LEAST = 12
LOST = "Reported as unknown: the supporting quotes could not be found in the resume, so this match is not supported by the document."


def ground(evidence: DataFrame, resumes: DataFrame) -> DataFrame:
    """``evidence`` (resume_id, quote, ...) with grounded: whether the quote stands in the resume's raw text, in any case and
    spacing, with twelve characters at least. Texts are brought to that form once each, before the join by resume."""
    texts = resumes.select("resume_id", T.grounding_form(F.col("text")).alias("__text"))
    rows = evidence.withColumn("__quote", T.grounding_form(F.col("quote"))).join(texts, "resume_id", "left")
    there = (F.length("__quote") >= LEAST) & F.contains("__text", "__quote")
    return rows.withColumn("grounded", F.coalesce(there, F.lit(False))).drop("__text", "__quote")


def keep_supported(requirement: DataFrame, grounded: DataFrame) -> DataFrame:
    """Claimed matches that had quotes and lost all of them become unknown; claims without quotes stay."""
    counts = grounded.groupBy("analysis_id", F.col("requirement_id").alias("id")).agg(F.count_if("grounded").alias("kept"))
    rows = requirement.join(counts, ["analysis_id", "id"], "left")
    lost = F.col("status").isin("STRONG_MATCH", "PARTIAL_MATCH") & F.coalesce(F.col("kept") == 0, F.lit(False))
    return rows.withColumn("rationale", F.when(lost, LOST).otherwise(F.col("rationale"))).withColumn("status", F.when(lost, "UNKNOWN").otherwise(F.col("status"))).drop("kept")


def counts(grounded: DataFrame) -> DataFrame:
    """analysis_id, kept, dropped, ratio."""
    rows = grounded.groupBy("analysis_id").agg(F.count_if("grounded").alias("kept"), F.count_if(~F.col("grounded")).alias("dropped"))
    return rows.withColumn("ratio", F.col("dropped") / (F.col("kept") + F.col("dropped")))
