"""A judgement provider measured over cases: what it found, invented, repeated and left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE_WORDS = ['"score"', '"totalmatchscore"', '"matchpercentage"']


def evaluate(cases: DataFrame, requirement: DataFrame, again: DataFrame, quotes: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row per case (case_id, must_find, must_not_appear, max_gaps): conformance, recall with what is missing, faithfulness,
    resistance, gaps within bounds, stability between two runs, no score, and the counts of the report.

    requirement, again: case_id, text, status of both runs. quotes: case_id, grounded. drafts: case_id, raw_json, reason, ms.
    """
    texts = requirement.groupBy("case_id").agg(F.collect_list(F.lower("text")).alias("texts"), F.collect_set("text").alias("first"), F.count_if(F.col("status") == "GAP").alias("gaps"), F.count("*").alias("requirements"))
    second = again.groupBy("case_id").agg(F.collect_set("text").alias("second"))
    kept = quotes.groupBy("case_id").agg(F.count_if("grounded").alias("kept"), F.count_if(~F.col("grounded")).alias("dropped"))
    rows = cases.join(drafts, "case_id", "left").join(texts, "case_id", "left").join(second, "case_id", "left").join(kept, "case_id", "left")
    none = F.array().cast("array<string>")
    all_text = F.array_join(F.coalesce("texts", none), " ")
    missing = F.filter("must_find", lambda t: ~F.contains(all_text, F.lower(t)))
    planted = F.exists("must_not_appear", lambda t: F.contains(all_text, F.lower(t)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    shared = F.size(F.array_intersect(F.coalesce("first", none), F.coalesce("second", none)))
    return rows.select(
        "case_id",
        (F.col("raw_json").isNotNull() & F.col("reason").isNull() & (zero("requirements") > 0)).alias("conforms"),
        (F.size(missing) == 0).alias("recalls"),
        F.array_join(missing, ",").alias("missing"),
        (zero("dropped") == 0).alias("faithful"),
        (~planted).alias("resists"),
        ((F.col("max_gaps") < 0) | (zero("gaps") <= F.col("max_gaps"))).alias("disciplined"),
        F.coalesce(F.try_divide(shared, F.size(F.coalesce("first", none))), F.lit(0.0)).alias("stability"),
        (~F.exists(F.array(*map(F.lit, SCORE_WORDS)), lambda w: F.contains(F.lower(F.coalesce("raw_json", F.lit(""))), w))).alias("scoreless"),
        zero("requirements").alias("requirements"),
        zero("kept").alias("kept"),
        zero("dropped").alias("dropped"),
        "ms",
    )
