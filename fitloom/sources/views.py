"""Analysis tables derived from the driver's tables: requirements, subfactors, evidence, skills and facts about resumes.

With ``only`` (analysis_id), rows of those analyses alone: the tables are cut down to them before anything is numbered or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import rubric


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _only(rows: DataFrame, key: str, only: DataFrame | None) -> DataFrame:
    return rows if only is None else rows.join(only.select(F.col("analysis_id").alias(key)), key, "left_semi")


def requirements(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """A requirement per line item; an analysis per order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    # Numbered in one sort: rows then lie by analysis and in order for all that is gathered of them.
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order, "l_returnflag", "l_linestatus"))
    rows = _only(table(spark, sf_dir, "lineitem"), "l_orderkey", only).select("l_orderkey", *order, "l_returnflag", "l_linestatus", place.alias("ordinal"))
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    extra = F.when(supp % 11 == 0, " as a lead").when(supp % 13 == 0, " to mentor others").otherwise("")
    rows = rows.select(
        F.col("l_orderkey").alias("analysis_id"),
        "ordinal",
        F.col("l_quantity").cast("int").alias("quotes"),
        F.concat(F.lit("req-"), F.col("ordinal")).alias("id"),
        F.concat(F.lit("Work with tool"), part % 40, extra).alias("text"),
        F.when(part % 17 == 0, "LEGAL_ELIGIBILITY").otherwise("TECHNICAL").alias("kind"),
        F.when(F.col("l_returnflag") == "N", "PREFERRED").otherwise("REQUIRED").alias("importance"),
        F.when((F.col("l_linestatus") == "O") & (F.col("ordinal") % 3 == 1), "CORE").otherwise("SUPPORTING").alias("criticality"),
        F.when(line % 3 == 0, F.concat(F.lit("g"), line % 2)).alias("alternative_group_id"),
        pick(part, rubric.COVERAGE_CATEGORIES).alias("primary_category"),
        pick(part, ["STRONG_MATCH", "PARTIAL_MATCH", "GAP", "UNKNOWN"]).alias("status"),
        pick(supp, ["DIRECT", "TRANSFERABLE"]).alias("relation"),
        pick(supp, ["STRONG", "MODERATE", "WEAK", "NONE"]).alias("strength"),
        F.lit("As judged.").alias("rationale"),
    )
    # One or two quotes for each claimed match; some aren't in the resume.
    quote = lambda pos: F.struct(pos.alias("pos"), F.concat(F.lit("quote "), F.col("ordinal"), F.lit("."), pos).alias("quote"), ((F.col("analysis_id") + F.col("ordinal") + pos) % 7 != 0).alias("grounded"))
    claimed = F.when(F.col("status").isin("STRONG_MATCH", "PARTIAL_MATCH"), F.transform(F.sequence(F.lit(0), F.col("quotes") % 2), quote))
    return rows.withColumn("evidence", F.coalesce(claimed, F.array().cast("array<struct<pos:int,quote:string,grounded:boolean>>"))).drop("quotes")


def subfactors(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    names = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("category"), F.lit(s).alias("subfactor")) for i, (c, s, _) in enumerate(rubric.SUBFACTORS)])
    rows = _only(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", only).select("o_orderkey", F.explode(names).alias("s")).filter((F.col("o_orderkey") + F.col("s.k")) % 6 != 0)
    return rows.select(F.col("o_orderkey").alias("analysis_id"), "s.category", "s.subfactor", ((F.col("o_orderkey") * 7 + F.col("s.k") * 3) % 5).cast("int").alias("value"))


def evidence(requirement: DataFrame) -> DataFrame:
    """A row per quote."""
    rows = requirement.select("analysis_id", "ordinal", F.col("id").alias("requirement_id"), "relation", "primary_category", F.explode("evidence").alias("e"))
    return rows.select("analysis_id", "ordinal", "requirement_id", "relation", "primary_category", "e.*")


def _orders(spark: SparkSession, sf_dir: str, only: DataFrame | None) -> DataFrame:
    return _only(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", only).select(F.col("o_orderkey").alias("analysis_id"))


def skills(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Two skills an analysis lists; of some it shows one at work."""
    rows = _orders(spark, sf_dir, only).select("analysis_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return rows.select(
        "analysis_id",
        F.concat(F.lit("Tool"), (F.col("analysis_id") + F.when(F.col("k") == 2, 0).otherwise(F.col("k"))) % 40).alias("name"),
        F.when(F.col("k") < 2, "SKILLS_LIST").otherwise("WORK_EXPERIENCE").alias("origin"),
    ).filter("origin = 'SKILLS_LIST' or analysis_id % 3 = 0")


def resumes(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Length of each resume and whether it has a HIGH warning."""
    return _orders(spark, sf_dir, only).select("analysis_id", (F.col("analysis_id") * 37 % 5000).cast("int").alias("resume_chars"), (F.col("analysis_id") % 16 == 3).alias("high_warning"))
