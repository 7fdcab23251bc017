"""Validation, grounding and evaluation of judgements derived from the line item and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators import evaluation, grounding, validation
from fitloom.plans.steps import met
from fitloom.queries.scoring import REQUIREMENT_SQL
from fitloom.sources import views
from fitloom.sources.views import table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


QUOTE_LIST = "array<struct<requirementId:string,importance:string,status:string,relation:string,strength:string,resumeQuote:string,rationale:string,score:int>>"


FAULTS = 56
#: Texts that drafts are built with, and the JSON that takes their place: kinds that no text field of the contract has, and one that any has.
PLANTED = {"@object": '{"score":5}', "@list": "[1]", "@number": "4.4"}


def drafts(requirement: DataFrame) -> DataFrame:
    """analysis_id, raw_json: the requirements as drafts, with a fault by analysis_id % FAULTS. A text of PLANTED is put in as what it stands for."""
    k = F.col("analysis_id") % FAULTS
    first = F.col("ordinal") == 1
    claimed = F.col("status").isin("STRONG_MATCH", "PARTIAL_MATCH")
    only = lambda n, wrong, right: F.when((k == n) & first, wrong).otherwise(right)
    quote = F.struct(
        only(9, "other", F.col("id")).alias("requirementId"), only(20, "MAGIC", F.col("importance")).alias("importance"), only(21, "MAGIC", F.col("status")).alias("status"), only(22, "MAGIC", F.col("relation")).alias("relation"),
        only(23, "MAGIC", F.col("strength")).alias("strength"), F.lit("a quote of the resume").alias("resumeQuote"), only(42, "@object", None).alias("rationale"), F.when((k == 24) & first, 1).alias("score"),
    )
    row = F.struct(
        F.when((k == 6) & (F.col("ordinal") == 2), "req-1").otherwise(F.col("id")).alias("id"),
        only(7, "  ", F.col("text")).alias("requirementText"),
        only(14, "MAGIC", F.col("kind")).alias("kind"),
        only(25, "MAGIC", F.col("importance")).alias("importance"), only(26, "MAGIC", F.col("criticality")).alias("criticality"), only(27, "MAGIC", F.col("primary_category")).alias("primaryCategory"),
        only(8, None, F.col("status")).alias("status"),
        only(28, "MAGIC", F.col("relation")).alias("relation"), only(29, "MAGIC", F.col("strength")).alias("evidenceStrength"),
        F.when(claimed, F.array(quote)).otherwise(F.array().cast(QUOTE_LIST)).alias("evidence"),
        F.when((k == 41) & first, "@list").alias("rationale"), F.when((k == 13) & first, 4.5).alias("matchPercentage"),
    )
    rows = met(requirement.select("analysis_id", F.struct("ordinal", row.alias("row")).alias("r")), "analysis_id", rows=F.collect_list("r"))
    rows = rows.select("analysis_id", F.sort_array("rows")["row"].alias("rows"))
    none = F.array().cast("array<string>")
    said = lambda n: F.struct(F.when(k == n + 34, "@object").otherwise("a headline").alias("headline"), F.when(k == n + 28, F.array(F.lit("@object"))).otherwise(none).alias("supportingEvidenceIds"), F.when(k != n + 1, none).alias("concerns"), F.when(k == n, 5).alias("score"))
    rated = lambda n: F.struct(F.when(k == n, "MAGIC").otherwise("MODERATE").alias("rating"), F.when(k == n + 1, "MAGIC").otherwise("STATED_IN_POSTING").alias("basis"), F.when(k == n + 23, "@list").alias("explanation"))
    outlook = F.struct(F.when(k == 10, "STRONG").otherwise("UNKNOWN").alias("rating"), F.lit("NOT_AVAILABLE").alias("basis"), F.when(k == 17, 5).alias("score"))
    rewrites, terms = F.array(F.struct(F.when(k == 50, "@list").otherwise("a").alias("before"), F.when(k == 36, 1).alias("score"))), F.array(F.struct(F.when(k == 49, "@object").otherwise("a").alias("resumeTerm"), F.when(k == 37, 1).alias("score")))
    advice = F.struct(none.alias("reorderSuggestions"), none.alias("emphasisSuggestions"), terms.alias("terminologyAlignment"), none.alias("deemphasizeSuggestions"), rewrites.alias("faithfulRewrites"), F.when(k == 35, 1).alias("score"))
    questions = F.array(F.struct(F.when(k == 48, "@list").otherwise("why").alias("question"), none.alias("evidenceToUse"), F.when(k == 38, 1).alias("score")))
    explained = F.array(F.struct(F.when(k == 51, "@object").otherwise("a gap").alias("gap"), F.when(k == 39, 1).alias("score")))
    interview = F.struct(questions.alias("likelyQuestions"), none.alias("talkingPoints"), explained.alias("gapsToExplain"), none.alias("questionsToAsk"), F.when(k == 16, 1).alias("score"))
    judged = F.struct(F.when(k == 34, "MAGIC").otherwise("EXPERIENCE_EVIDENCE").alias("category"), F.lit("depth").alias("subfactor"), F.when(k == 12, 9).otherwise((F.col("analysis_id") % 5).cast("int")).alias("value"))
    draft = F.struct(
        F.when(k == 4, "v0").otherwise(validation.VERSION).alias("schemaVersion"),
        F.when(k == 5, F.slice("rows", 1, 0)).otherwise(F.col("rows")).alias("requirementAssessments"),
        F.array(judged).alias("subfactorJudgements"),
        said(18).alias("roleAlignment"), said(-9).alias("seniorityAlignment"),
        F.when(k != 15, F.struct(rated(30).alias("careerGrowth"), rated(32).alias("compensation"), outlook.alias("companyOutlook"))).alias("opportunityValue"),
        advice.alias("resumePositioning"), interview.alias("interviewPreparation"),
        F.when(k == 40, "@object").when(k == 47, "@number").otherwise("the rationale").alias("finalRationale"),
        F.when(k != 11, F.array(F.when(k == 54, "@list").otherwise("none"))).alias("limitations"),
        F.when(k == 3, 4.2).alias("totalMatchScore"),
    )
    text = F.to_json(draft)
    for name, planted in PLANTED.items():
        text = F.replace(text, F.lit(f'"{name}"'), F.lit(planted))
    text = F.when(k == 47, F.regexp_replace(text, '"value":([0-9])', ' "value" : "$1"')).otherwise(text)
    spoilt = F.when(k == 1, " ").when(k == 2, F.substring(text, 1, 40)).when(k == 43, F.concat(text, F.lit(" and more"))).when(k == 44, F.concat(text, F.lit("\n"), text)).when(k == 45, F.concat(text, F.lit("] x")))
    return rows.select("analysis_id", F.coalesce(spoilt, text).alias("raw_json"))


#: Faults that are only there if the first requirement has evidence.
_QUOTED_FAULTS = "9, 20, 21, 22, 23, 24, 42"
_REASON = f"""CASE WHEN r.analysis_id % {FAULTS} IN ({_QUOTED_FAULTS}) AND NOT bool_or(ordinal = 1 AND status IN ('STRONG_MATCH', 'PARTIAL_MATCH')) THEN NULL ELSE CASE r.analysis_id % {FAULTS}
  WHEN 0 THEN NULL WHEN 47 THEN NULL WHEN 1 THEN 'empty-response' WHEN 4 THEN 'schema-version' WHEN 5 THEN 'requirement-count' WHEN 6 THEN CASE WHEN count(*) >= 2 THEN 'requirement-id' END WHEN 7 THEN 'requirement-text'
  WHEN 8 THEN 'requirement-fields' WHEN 9 THEN 'evidence-requirement-mismatch' WHEN 10 THEN 'company-outlook-invented' WHEN 15 THEN 'opportunity-value' ELSE 'unreadable' END END"""


@_query(REQUIREMENT_SQL + f"SELECT analysis_id, {_REASON} AS reason FROM rq r GROUP BY analysis_id")
def va01_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VA1-VA9, IO4."""
    return validation.validate(drafts(views.requirements(spark, sf_dir))).select("analysis_id", "reason")


@_query(
    REQUIREMENT_SQL
    + f""", ok AS (SELECT analysis_id FROM rq r GROUP BY analysis_id HAVING {_REASON} IS NULL)
SELECT rq.analysis_id, ordinal, CASE WHEN status = 'GAP' AND rq.analysis_id % 3 <> 0 THEN 'UNKNOWN' ELSE status END AS status, bool_or(status = 'GAP' AND rq.analysis_id % 3 <> 0) OVER (PARTITION BY rq.analysis_id) AS limited
FROM rq JOIN ok ON ok.analysis_id = rq.analysis_id"""
)
def va10_gap_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VA10 over the drafts that are accepted; every third analysis may report gaps."""
    rows = validation.requirements_of(validation.validate(drafts(views.requirements(spark, sf_dir))))
    absence = F.when(F.col("o_orderkey") % 3 == 0, "MAY_BE_GAP").otherwise("MUST_BE_UNKNOWN")
    policy = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), absence.alias("absence")).distinct()
    changed = validation.downgrade_gaps(rows, policy)
    return changed.select("analysis_id", "ordinal", "status", F.col("limitation").isNotNull().alias("limited"))


LOWER = "abcdefghijklmnopqrstuvwxyz"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two quotes per document: as it is, in capitals, with wider spaces, too short, or of another text."""
    cut = F.substring("text", 5, 40)
    v = lambda k: F.when(k == 0, cut).when(k == 1, F.translate(cut, LOWER, LOWER.upper())).when(k == 2, F.replace(cut, F.lit(" "), F.lit(" \n "))).when(k == 3, F.substring("text", 5, 8)).otherwise(F.concat(cut, F.lit(" never said")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(2))).alias("pos"))
    quote = v((F.col("doc_id") + F.col("pos")) % 5)
    return rows.select(F.col("doc_id").alias("analysis_id"), F.col("doc_id").alias("resume_id"), F.lit("req-1").alias("requirement_id"), "pos", quote.alias("quote"))


_FORM = "lower(trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"
_QUOTED = f"""WITH qx AS (SELECT doc_id, text, pos, substr(text, 5, 40) AS cut, (doc_id + pos) % 5 AS v FROM documents, (VALUES (0), (2)) p(pos)),
qq AS (SELECT doc_id, pos, text, CASE v WHEN 0 THEN cut WHEN 1 THEN translate(cut, '{LOWER}', '{LOWER.upper()}') WHEN 2 THEN replace(cut, ' ', ' ' || chr(10) || ' ') WHEN 3 THEN substr(text, 5, 8) ELSE cut || ' never said' END AS quote FROM qx),
qg AS (SELECT doc_id, pos, length({_FORM.format('quote')}) >= 12 AND contains({_FORM.format('text')}, {_FORM.format('quote')}) AS grounded FROM qq) """


@_query(_QUOTED + "SELECT doc_id AS analysis_id, pos, grounded FROM qg")
def gr01_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1, GR2."""
    resumes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resume_id"), "text")
    return grounding.ground(_quotes(spark, sf_dir), resumes).select("analysis_id", "pos", "grounded")


@_query(
    _QUOTED
    + """, qc AS (SELECT doc_id, count(*) FILTER (WHERE grounded) AS kept, count(*) FILTER (WHERE NOT grounded) AS dropped FROM qg GROUP BY doc_id)
SELECT doc_id AS analysis_id, kept, dropped, dropped / (kept + dropped) AS ratio, CASE doc_id % 3 WHEN 2 THEN 'GAP' WHEN 0 THEN CASE WHEN kept > 0 THEN 'STRONG_MATCH' ELSE 'UNKNOWN' END ELSE CASE WHEN kept > 0 THEN 'PARTIAL_MATCH' ELSE 'UNKNOWN' END END AS status FROM qc"""
)
def gr03_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3, GR4."""
    d = table(spark, sf_dir, "documents")
    found = grounding.ground(_quotes(spark, sf_dir), d.select(F.col("doc_id").alias("resume_id"), "text"))
    status = F.when(F.col("doc_id") % 3 == 0, "STRONG_MATCH").when(F.col("doc_id") % 3 == 1, "PARTIAL_MATCH").otherwise("GAP")
    claims = d.select(F.col("doc_id").alias("analysis_id"), F.lit("req-1").alias("id"), status.alias("status"), F.lit("").alias("rationale"))
    return grounding.keep_supported(claims, found).join(grounding.counts(found), "analysis_id").select("analysis_id", "kept", "dropped", "ratio", "status")


@_query(
    REQUIREMENT_SQL
    + """, ca AS (SELECT analysis_id, 'tool' || (analysis_id % 40) AS need, analysis_id % 5 - 1 AS bound FROM ids),
tx AS (SELECT analysis_id, string_agg(lower(text), ' ' ORDER BY ordinal) AS t, count(*) FILTER (WHERE status = 'GAP') AS gaps, count(*) AS n FROM rq GROUP BY analysis_id),
st AS (SELECT analysis_id, count(DISTINCT text) AS n1, count(DISTINCT text) FILTER (WHERE text IN (SELECT text FROM rq b WHERE b.analysis_id = a.analysis_id AND NOT (b.analysis_id % 10 = 0 AND b.ordinal = 1))) AS n2 FROM rq a GROUP BY analysis_id)
SELECT ca.analysis_id AS case_id, true AS conforms, contains(t, need) AS recalls, CASE WHEN contains(t, need) THEN '' ELSE need END AS missing, coalesce(dropped, 0) = 0 AS faithful, NOT contains(t, 'mentor') AS resists,
  bound < 0 OR gaps <= bound AS disciplined, n2 / n1 AS stability, ca.analysis_id % 13 <> 0 AS scoreless, n AS requirements, coalesce(quotes - dropped, 0) AS kept, coalesce(dropped, 0) AS dropped, ca.analysis_id % 100 AS ms
FROM ca JOIN tx ON tx.analysis_id = ca.analysis_id JOIN st ON st.analysis_id = ca.analysis_id LEFT JOIN q ON q.analysis_id = ca.analysis_id"""
)
def ev01_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV1-EV8: an analysis as a case; the second run words one requirement anew in every tenth."""
    r = views.requirements(spark, sf_dir).withColumn("case_id", F.col("analysis_id"))
    tool = F.concat(F.lit("tool"), F.col("case_id") % 40)
    ids = r.select("case_id").distinct()
    cases = ids.select("case_id", F.array(tool).alias("must_find"), F.array(F.lit("MENTOR")).alias("must_not_appear"), (F.col("case_id") % 5 - 1).alias("max_gaps"))
    again = r.withColumn("text", F.when((F.col("case_id") % 10 == 0) & (F.col("ordinal") == 1), "Worded anew").otherwise(F.col("text")))
    said = ids.select("case_id", F.when(F.col("case_id") % 13 == 0, '{"Score": 4}').otherwise("{}").alias("raw_json"), F.lit(None).cast("string").alias("reason"), (F.col("case_id") % 100).alias("ms"))
    quotes = views.evidence(r).withColumn("case_id", F.col("analysis_id"))
    return evaluation.evaluate(cases, r, again, quotes, said)
