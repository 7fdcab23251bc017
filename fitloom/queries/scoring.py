"""Scoring over the order and line item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions import rubric
from fitloom.operators import scoring, sink
from fitloom.plans.scratch import Scratch
from fitloom.sources import views

QUERIES: dict = {}
ORACLES: dict = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requirements(spark, sf_dir)
    return scoring.cap_skills_list_only(r, views.skills(spark, sf_dir))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.decisions(_capped(spark, sf_dir), views.subfactors(spark, sf_dir), views.resumes(spark, sf_dir))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analysis_id, category (empty for the whole analysis) and its requirements in order."""
    rows = scoring.folded(_capped(spark, sf_dir), lists=True).select("analysis_id", "requirements")
    names = ["", *[c for c, _, _ in rubric.CATEGORIES]]
    own = F.filter("requirements", lambda r: (F.col("category") == "") | (r["primary_category"] == F.col("category")))
    return rows.withColumn("category", F.explode(F.array(*map(F.lit, names)))).select("analysis_id", "category", own.alias("own"))


@_query
def fit_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2-SC7, SC9-SC15, SC17-SC20: score before and after ceilings, label, tier, confidence and recommendation."""
    d = _decided(spark, sf_dir)
    return d.select("analysis_id", (F.col("total") / 10).alias("total"), (F.col("capped") / 10).alias("score"), "label", "meaning", "core_gaps", "eligibility", "tier", "confidence", "recommendation")


@_query
def sc01_skills_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).select("analysis_id", "ordinal", "strength", "rationale")


@_query
def sc02_weight_and_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2, SC3."""
    r = scoring.with_credit(_capped(spark, sf_dir))
    return r.select("analysis_id", "ordinal", "weight4", "credit4")


@_query
def sc04_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_alternatives(_capped(spark, sf_dir))


@_query
def sc05_requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5-SC7."""
    return scoring.requirement_coverage(_capped(spark, sf_dir))


@_query
def sc08_leadership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.asks_for_leadership(views.requirements(spark, sf_dir))


@_query
def sc09_subfactor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.subfactor_coverage(views.subfactors(spark, sf_dir), scoring.asks_for_leadership(views.requirements(spark, sf_dir)))


@_query
def sc10_category_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10, SC11, SC24, SC26."""
    rows = scoring.explanations(scoring.category_results(_capped(spark, sf_dir), views.subfactors(spark, sf_dir)))
    return rows.select("analysis_id", "category", "rated", "items", "unknown", (F.col("score") / 10).alias("score"), (F.col("applied") / 10000).alias("applied_weight"), F.col("coverage"), rubric.label_of(F.col("score")).alias("label"), "summary", "impact")


@_query
def sc14_core_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, SC14."""
    rows = scoring.gaps_and_eligibility(_capped(spark, sf_dir))
    return rows.select("analysis_id", "core_gaps", F.array_join("gap_ids", ",").alias("gap_ids"), "gap_texts", "eligibility", "n", "n_unknown")


@_query
def sc16_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15, SC16."""
    return scoring.adjustments(_decided(spark, sf_dir))


@_query
def sc21_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the whole analysis and of each category."""
    rows = _listed(spark, sf_dir)
    both = F.array(*[F.struct(F.lit(x).alias("relation"), scoring.first_quotes(F.col("own"), x).alias("quotes")) for x in ("DIRECT", "TRANSFERABLE")])
    rows = rows.select("analysis_id", "category", F.explode(both).alias("b")).select("analysis_id", "category", "b.relation", F.posexplode("b.quotes").alias("k", "q"))
    return rows.select("analysis_id", "category", "relation", (F.col("k") + 1).alias("k"), "q.requirement_id", "q.quote")


@_query
def sc22_gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical and minor gaps of the whole analysis, gaps of each category, and unknowns of both."""
    rows, top = _listed(spark, sf_dir), F.col("category") == ""
    none = F.filter(scoring.requirement_gaps(F.col("own"), "GAP"), lambda r: F.lit(False))
    lists = {"CRITICAL": F.when(top, scoring.requirement_gaps(F.col("own"), "GAP", True)).otherwise(none), "MINOR": F.when(top, scoring.requirement_gaps(F.col("own"), "GAP", False)).otherwise(none),
             "GAP": F.when(top, none).otherwise(scoring.requirement_gaps(F.col("own"), "GAP")), "UNKNOWN": scoring.requirement_gaps(F.col("own"), "UNKNOWN")}
    rows = rows.select("analysis_id", "category", F.explode(F.array(*[F.struct(F.lit(n).alias("list"), c.alias("rows")) for n, c in lists.items()])).alias("l"))
    rows = rows.select("analysis_id", "category", "l.list", F.posexplode("l.rows").alias("k", "r"))
    return rows.select("analysis_id", "category", "list", (F.col("k") + 1).alias("k"), "r.*")


@_query
def sc23_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir).filter("category <> ''").select("analysis_id", "category", F.posexplode(scoring.suggestions(F.col("own"))).alias("k", "suggestion"))
    return rows.withColumn("k", F.col("k") + 1)


@_query
def sc25_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("analysis_id", F.array_join(scoring.limitations(), "|").alias("limitations"))


@_query
def sc27_fit_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC27, IO5: the nested result, with every text of it joined into strings."""
    f = scoring.fit_analysis(views.requirements(spark, sf_dir), views.subfactors(spark, sf_dir), views.skills(spark, sf_dir), views.resumes(spark, sf_dir))
    quotes = lambda c: F.array_join(F.transform(c, lambda q: F.concat(q["requirement_id"], F.lit(":"), q["quote"])), ";")
    gaps = lambda c: F.array_join(F.transform(c, lambda g: F.concat_ws("/", g["id"], g["text"], g["importance"], g["criticality"], g["reason"], g["mitigation"])), ";")
    category = lambda c: F.concat_ws("|", c["category"], c["score"], c["label"], c["summary"], c["impact"], quotes(c["direct"]), quotes(c["transferable"]), gaps(c["gaps"]), gaps(c["unknowns"]), F.array_join(c["suggestions"], ";"))
    return f.select(
        "analysis_id", (F.col("capped") / 10).alias("score"), "label", "meaning", "tier", "confidence", "recommendation", "eligibility",
        F.array_join(F.transform("categories", category), "\n").alias("categories"),
        F.array_join(F.transform("adjustments", lambda a: F.concat_ws("/", a["rule_id"], a["before"], a["after"], a["ids"])), ";").alias("adjustments"),
        quotes(F.col("strongest")).alias("strongest"), quotes(F.col("transferable")).alias("transferable"), gaps(F.col("critical_gaps")).alias("critical_gaps"), gaps(F.col("minor_gaps")).alias("minor_gaps"),
        gaps(F.col("unknowns")).alias("unknowns"), F.array_join("limitations", "|").alias("limitations"),
    )


@_query
def io05_changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO5 as a sink: results of all analyses are written while one resume in 50 is of another length, then brought up to the tables; only
    those are worked out and written again, as part 1."""
    longer = {"by": 5000}

    def tables(only: DataFrame | None = None) -> dict[str, DataFrame]:
        resume = views.resumes(spark, sf_dir, only)
        resume = resume.withColumn("resume_chars", F.col("resume_chars") + F.when(F.col("analysis_id") % 50 == 7, longer["by"]).otherwise(0))
        return {"requirement": views.requirements(spark, sf_dir, only), "subfactor": views.subfactors(spark, sf_dir, only), "skill": views.skills(spark, sf_dir, only), "resume": resume}

    results = sink.Sink(spark, f"{Scratch(spark, 'io05').path}/results", lambda keys: scoring.fit_analysis(**tables(keys)))
    results.refresh(sink.input_fingerprint(**tables()))
    longer["by"] = 0
    results.refresh(sink.input_fingerprint(**tables()))
    return results.read().select("analysis_id", (F.col("capped") / 10).alias("score"), "label", "tier", "confidence", "recommendation", F.array_join("limitations", "|").alias("limitations"), "part")


@_query
def ev09_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV9: how many shown scores there are and how many don't follow from the shown rows."""
    d = _decided(spark, sf_dir)
    return d.groupBy("label").agg(F.count("*").alias("n"), F.count_if(scoring.off_sum(F.col("categories"))).alias("violations"))


_SUBS = ", ".join(f"({i}, '{c}', '{s}', {w})" for i, (c, s, w) in enumerate(rubric.SUBFACTORS))
_CATS = ", ".join(f"({i}, '{c}', '{n}', {w})" for i, (c, n, w) in enumerate(rubric.CATEGORIES))
_ANCHORS = " ".join(
    f"WHEN coverage <= {hi * 10**8} THEN (2 * ((coverage - {lo * 10**8}) * {b - a} + {a * (hi - lo) * 10**8}) + {(hi - lo) * 10**8}) // {2 * (hi - lo) * 10**8}"
    for (lo, a), (hi, b) in zip(rubric.ANCHORS, rubric.ANCHORS[1:])
)
_MEANING = "CASE " + " ".join(f"WHEN capped >= {low} THEN '{meaning}'" for low, _, meaning in rubric.BANDS) + " END"
_LABEL = "CASE " + " ".join(f"WHEN {{0}} >= {low} THEN '{label}'" for low, label, _ in rubric.BANDS) + " END"
#: The chain of tables that every statement below selects from.
SUBS_SQL = f"""subs(k, category, subfactor, w) AS (VALUES {_SUBS}),
"""
#: The order and line item tables as ids, rq, subs, sf, ev and rs, which the rubric reads.
_ORDERS_SQL = f"""rq0 AS (
  SELECT l_orderkey AS analysis_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS ordinal, * FROM lineitem),
rq1 AS (SELECT analysis_id, ordinal, 'req-' || ordinal AS id,
  'Work with tool' || (l_partkey % 40) || CASE WHEN l_suppkey % 11 = 0 THEN ' as a lead' WHEN l_suppkey % 13 = 0 THEN ' to mentor others' ELSE '' END AS text,
  CASE WHEN l_partkey % 17 = 0 THEN 'LEGAL_ELIGIBILITY' ELSE 'TECHNICAL' END AS kind,
  CASE WHEN l_returnflag = 'N' THEN 'PREFERRED' ELSE 'REQUIRED' END AS importance,
  CASE WHEN l_linestatus = 'O' AND ordinal % 3 = 1 THEN 'CORE' ELSE 'SUPPORTING' END AS criticality,
  CASE WHEN l_linenumber % 3 = 0 THEN 'g' || (l_linenumber % 2) END AS alternative_group_id,
  CASE l_partkey % 3 WHEN 0 THEN 'CORE_TECHNICAL_STACK' WHEN 1 THEN 'ROLE_AND_RESPONSIBILITY_ALIGNMENT' ELSE 'DOMAIN_AND_OPERATING_ENVIRONMENT' END AS primary_category,
  CASE l_partkey % 4 WHEN 0 THEN 'STRONG_MATCH' WHEN 1 THEN 'PARTIAL_MATCH' WHEN 2 THEN 'GAP' ELSE 'UNKNOWN' END AS status,
  CASE l_suppkey % 2 WHEN 0 THEN 'DIRECT' ELSE 'TRANSFERABLE' END AS relation,
  CASE l_suppkey % 4 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'WEAK' ELSE 'NONE' END AS strength0,
  l_quantity::INTEGER AS quotes FROM rq0),
ids AS (SELECT DISTINCT analysis_id FROM rq1),
lonly AS (SELECT analysis_id, 'tool' || ((analysis_id + k) % 40) AS name FROM ids, (VALUES (0), (1)) k(k)
  WHERE NOT (analysis_id % 3 = 0 AND k = 0)),
hit AS (SELECT DISTINCT r.analysis_id, r.ordinal FROM rq1 r JOIN lonly o ON o.analysis_id = r.analysis_id AND contains(lower(r.text), o.name)),
rq AS (SELECT r.*, CASE WHEN h.ordinal IS NOT NULL AND kind = 'TECHNICAL' AND strength0 IN ('STRONG', 'MODERATE') THEN 'WEAK' ELSE strength0 END AS strength,
  'As judged.' || CASE WHEN h.ordinal IS NOT NULL AND kind = 'TECHNICAL' AND strength0 IN ('STRONG', 'MODERATE') THEN '{scoring.CAP_NOTE}' ELSE '' END AS rationale
  FROM rq1 r LEFT JOIN hit h ON h.analysis_id = r.analysis_id AND h.ordinal = r.ordinal),
{SUBS_SQL}sf AS (SELECT o_orderkey AS analysis_id, category, subfactor, w, (o_orderkey * 7 + k * 3) % 5 AS value FROM orders, subs WHERE (o_orderkey + k) % 6 <> 0),
ev AS (SELECT analysis_id, ordinal, id AS requirement_id, relation, primary_category, pos, 'quote ' || ordinal || '.' || pos AS quote, (analysis_id + ordinal + pos) % 7 <> 0 AS grounded
  FROM (SELECT *, unnest(range(0, quotes % 2 + 1)) AS pos FROM rq WHERE status IN ('STRONG_MATCH', 'PARTIAL_MATCH'))),
rs AS (SELECT analysis_id, analysis_id * 37 % 5000 AS chars, analysis_id % 16 = 3 AS high FROM ids),
"""
#: From ids, rq, subs, sf, ev (analysis_id, grounded, ...) and rs (analysis_id, chars, high) to d, one row per analysis.
RUBRIC_SQL = f"""cr AS (SELECT *, CASE WHEN importance = 'REQUIRED' THEN 100 ELSE 35 END * CASE WHEN criticality = 'CORE' THEN 150 ELSE 100 END AS weight4,
  CASE status WHEN 'STRONG_MATCH' THEN 100 WHEN 'PARTIAL_MATCH' THEN CASE WHEN relation = 'TRANSFERABLE' THEN 45 ELSE 55 END WHEN 'GAP' THEN 0 END
  * CASE strength WHEN 'MODERATE' THEN 90 WHEN 'WEAK' THEN 75 ELSE 100 END AS credit4 FROM rq),
sc AS (SELECT *, primary_category AS category FROM cr UNION ALL SELECT *, 'REQUIRED_QUALIFICATION_COVERAGE' FROM cr WHERE importance = 'REQUIRED'),
alt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, category, coalesce(alternative_group_id, '#' || ordinal) ORDER BY coalesce(credit4, -1) DESC, ordinal) AS k FROM sc) WHERE k = 1),
rcov AS (SELECT analysis_id, category, count(credit4) AS items, count(*) - count(credit4) AS unknown,
  CASE WHEN count(credit4) >= 2 THEN ((sum(credit4 * weight4)::HUGEINT * 20000000000 + sum(CASE WHEN credit4 IS NOT NULL THEN weight4 END)::HUGEINT * 10000)
    // (2 * sum(CASE WHEN credit4 IS NOT NULL THEN weight4 END)::HUGEINT * 10000))::BIGINT END AS coverage FROM alt GROUP BY ALL),
leads AS (SELECT analysis_id, bool_or(regexp_matches(lower(text), 'lead|mentor|manage|staff|principal')) AS leadership FROM rq GROUP BY analysis_id),
scov AS (SELECT sf.analysis_id, category, count(*) AS items, 0::BIGINT AS unknown,
  CASE WHEN count(*) >= 2 THEN ((sum(value * w)::HUGEINT * 20000000000 + sum(w)::HUGEINT * 4) // (2 * sum(w)::HUGEINT * 4))::BIGINT END AS coverage
  FROM sf LEFT JOIN leads l ON l.analysis_id = sf.analysis_id WHERE subfactor <> 'leadership' OR coalesce(l.leadership, false) GROUP BY ALL),
cats(seq, category, display_name, nominal) AS (VALUES {_CATS}),
c0 AS (SELECT ids.analysis_id, cats.*, coalesce(v.items, 0) AS items, coalesce(v.unknown, 0) AS unknown, v.coverage
  FROM ids CROSS JOIN cats LEFT JOIN (SELECT * FROM rcov UNION ALL SELECT * FROM scov) v ON v.analysis_id = ids.analysis_id AND v.category = cats.category),
c1 AS (SELECT *, coverage IS NOT NULL AS rated, (CASE WHEN coverage IS NULL THEN 0 {_ANCHORS} END)::INTEGER AS score,
  sum(CASE WHEN coverage IS NOT NULL THEN nominal ELSE 0 END) OVER (PARTITION BY analysis_id) AS rw FROM c0),
c AS (SELECT *, CASE WHEN rated THEN (2 * nominal * 10000 + rw) // (2 * rw) ELSE 0 END AS applied FROM c1),
t AS (SELECT analysis_id, ((2 * sum(score * applied) + 10000) // 20000)::INTEGER AS total, max(CASE WHEN category = 'REQUIRED_QUALIFICATION_COVERAGE' THEN coverage END) AS rcover,
  max(CASE WHEN category = 'SENIORITY_AND_OWNERSHIP' THEN score END) AS seniority FROM c GROUP BY analysis_id),
g AS (SELECT analysis_id, count(*) FILTER (WHERE gap) AS core_gaps, coalesce(string_agg(id, ',' ORDER BY ordinal) FILTER (WHERE gap), '') AS gap_ids,
  coalesce(string_agg(text, '; ' ORDER BY ordinal) FILTER (WHERE gap), '') AS gap_texts,
  CASE WHEN bool_or(kind = 'LEGAL_ELIGIBILITY' AND importance = 'REQUIRED' AND status = 'GAP') THEN 'NOT_ELIGIBLE' ELSE 'UNKNOWN' END AS eligibility,
  count(*) AS n, count(*) FILTER (WHERE status = 'UNKNOWN') AS n_unknown
  FROM (SELECT *, importance = 'REQUIRED' AND criticality = 'CORE' AND status = 'GAP' AS gap FROM rq) GROUP BY analysis_id),
q AS (SELECT analysis_id, count(*) AS quotes, count(*) FILTER (WHERE NOT grounded) AS dropped FROM ev GROUP BY analysis_id),
d0 AS (SELECT t.*, g.* EXCLUDE (analysis_id), coalesce(q.quotes, 0) AS quotes, coalesce(q.dropped, 0) AS dropped, rs.chars, rs.high,
  eligibility = 'NOT_ELIGIBLE' AND total > 15 AS first_cap, CASE WHEN core_gaps = 1 THEN 34 WHEN core_gaps = 2 THEN 24 WHEN core_gaps > 2 THEN 19 END AS lim
  FROM t JOIN g ON g.analysis_id = t.analysis_id LEFT JOIN q ON q.analysis_id = t.analysis_id LEFT JOIN rs ON rs.analysis_id = t.analysis_id),
d1 AS (SELECT *, CASE WHEN first_cap THEN 15 ELSE total END AS after_first FROM d0),
d2 AS (SELECT *, coalesce(after_first > lim, false) AS second_cap, CASE WHEN after_first > lim THEN lim ELSE after_first END AS capped FROM d1),
d3 AS (SELECT *, {_LABEL.format("capped")} AS label, {_MEANING} AS meaning,
  CASE WHEN core_gaps > 0 THEN 'REACH' WHEN coalesce(rcover, 0) >= 9000000000 AND seniority >= 45 THEN 'SAFETY' WHEN coalesce(rcover, 0) >= 7500000000 THEN 'TARGET' ELSE 'REACH' END AS tier,
  CASE WHEN high OR chars < 1500 OR n = 0 OR 100 * n_unknown > 35 * n OR 100 * dropped > 10 * quotes THEN 'LOW'
    WHEN chars >= 2500 AND 100 * n_unknown <= 15 * n AND dropped = 0 AND n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM d2),
d AS (SELECT *, CASE WHEN eligibility = 'NOT_ELIGIBLE' OR capped < 25 THEN 'LOW_PRIORITY' WHEN core_gaps > 0 OR confidence = 'LOW' OR capped < 35 THEN 'CONDITIONAL'
  WHEN capped >= 42 THEN 'STRONG_APPLY' ELSE 'APPLY' END AS recommendation FROM d3),
"""
REQUIREMENT_SQL = f"""
WITH {_ORDERS_SQL}{RUBRIC_SQL}adj AS (SELECT analysis_id, 1 AS seq, 'NOT_ELIGIBLE' AS rule_id, total AS before, 15 AS after, '' AS triggering_ids FROM d WHERE first_cap
  UNION ALL SELECT analysis_id, 2, CASE core_gaps WHEN 1 THEN 'CORE_GAP_SINGLE' WHEN 2 THEN 'CORE_GAP_MULTIPLE' ELSE 'CORE_GAP_SEVERE' END, after_first, lim, gap_ids FROM d WHERE second_cap),
lists AS (SELECT '' AS category UNION ALL SELECT category FROM cats),
fq AS (SELECT * FROM (SELECT ev.*, l.category, row_number() OVER (PARTITION BY analysis_id, l.category, relation ORDER BY ordinal, pos) AS k
  FROM ev JOIN lists l ON l.category IN ('', ev.primary_category) WHERE grounded) WHERE k <= 8),
gl AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, category, list ORDER BY ordinal) AS k FROM (
  SELECT rq.analysis_id, l.category, rq.ordinal, CASE WHEN status = 'UNKNOWN' THEN 'UNKNOWN' WHEN l.category <> '' THEN 'GAP' WHEN criticality = 'CORE' THEN 'CRITICAL' ELSE 'MINOR' END AS list,
  rq.id, rq.text, rq.importance, rq.criticality, CASE WHEN status = 'UNKNOWN' THEN '{scoring.UNKNOWN_REASON}' ELSE '{scoring.GAP_REASON}' END AS reason,
  CASE WHEN status = 'UNKNOWN' THEN '{scoring.UNKNOWN_HELP}' ELSE '{scoring.GAP_HELP}' END AS mitigation FROM rq JOIN lists l ON l.category IN ('', rq.primary_category) WHERE status IN ('GAP', 'UNKNOWN'))),
sg AS (SELECT analysis_id, primary_category AS category, k, '{scoring.SUGGESTION[0]}' || text || '{scoring.SUGGESTION[1]}' AS suggestion
  FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, primary_category ORDER BY ordinal) AS k FROM rq WHERE status IN ('UNKNOWN', 'PARTIAL_MATCH')) WHERE k <= 3),
ct AS (SELECT *, {_LABEL.format("score")} AS label,
  CASE WHEN rated THEN display_name || ' was rated from ' || items || ' requirement' || CASE WHEN items = 1 THEN '' ELSE 's' END || ' the resume could be judged against.'
    ELSE 'There was not enough information to rate ' || display_name || '. ' || unknown || ' requirement' || CASE WHEN unknown = 1 THEN '' ELSE 's' END || ' could not be judged from the resume, so this category is shown at zero rather than guessed at.' END AS summary,
  CASE WHEN rated THEN 'The resume answers ' || ((2 * coverage + 100000000) // 200000000) || '% of the weighted requirements in this category, which maps to ' || (score // 10) || '.' || (score % 10)
    || ' on the published scale. Required qualifications count nearly three times what preferred ones do, and core requirements count half again as much. ' || unknown || ' requirement' || CASE WHEN unknown = 1 THEN '' ELSE 's' END
    || ' could not be judged and ' || CASE WHEN unknown = 1 THEN 'was' ELSE 'were' END || ' excluded from the ratio.'
    ELSE 'No score could be derived: fewer than 2 requirements in this category could be judged. Unknown requirements are excluded from the calculation rather than counted against the candidate, so nothing here has lowered the total unfairly.' END AS impact FROM c),
qj AS (SELECT analysis_id, category, relation, string_agg(requirement_id || ':' || quote, ';' ORDER BY k) AS said FROM fq GROUP BY ALL),
gj AS (SELECT analysis_id, category, list, string_agg(concat_ws('/', id, text, importance, criticality, reason, mitigation), ';' ORDER BY k) AS said FROM gl GROUP BY ALL),
sj AS (SELECT analysis_id, category, string_agg(suggestion, ';' ORDER BY k) AS said FROM sg GROUP BY ALL),
cj AS (SELECT ct.analysis_id, string_agg(concat_ws('|', ct.category, score, label, summary, impact, coalesce(q1.said, ''), coalesce(q2.said, ''), coalesce(g1.said, ''), coalesce(g2.said, ''), coalesce(sj.said, '')), chr(10) ORDER BY seq) AS said FROM ct
  LEFT JOIN qj q1 ON q1.analysis_id = ct.analysis_id AND q1.category = ct.category AND q1.relation = 'DIRECT' LEFT JOIN qj q2 ON q2.analysis_id = ct.analysis_id AND q2.category = ct.category AND q2.relation = 'TRANSFERABLE'
  LEFT JOIN gj g1 ON g1.analysis_id = ct.analysis_id AND g1.category = ct.category AND g1.list = 'GAP' LEFT JOIN gj g2 ON g2.analysis_id = ct.analysis_id AND g2.category = ct.category AND g2.list = 'UNKNOWN'
  LEFT JOIN sj ON sj.analysis_id = ct.analysis_id AND sj.category = ct.category GROUP BY ct.analysis_id),
aj AS (SELECT analysis_id, string_agg(concat_ws('/', rule_id, before, after, triggering_ids), ';' ORDER BY seq) AS said FROM adj GROUP BY ALL),
lm AS (SELECT analysis_id, CASE WHEN first_cap OR second_cap THEN '{scoring.CEILING_NOTE}|' ELSE '' END || CASE WHEN confidence = 'LOW' THEN '{scoring.LOW_NOTE}|' ELSE '' END || '{scoring.CAVEAT}' AS limitations FROM d)
"""

for _name, _sql in {
    "fit_headline": "SELECT analysis_id, total / 10 AS total, capped / 10 AS score, label, meaning, core_gaps, eligibility, tier, confidence, recommendation FROM d",
    "sc01_skills_cap": "SELECT analysis_id, ordinal, strength, rationale FROM rq",
    "sc02_weight_and_credit": "SELECT analysis_id, ordinal, weight4, credit4 FROM cr",
    "sc04_alternatives": "SELECT analysis_id, category, ordinal FROM alt",
    "sc05_requirement_coverage": "SELECT * FROM rcov",
    "sc08_leadership": "SELECT * FROM leads",
    "sc09_subfactor_coverage": "SELECT * FROM scov",
    "sc10_category_results": "SELECT analysis_id, category, rated, items, unknown, score / 10 AS score, applied / 10000 AS applied_weight, coverage, label, summary, impact FROM ct",
    "sc14_core_gaps": "SELECT * FROM g",
    "sc16_adjustments": "SELECT analysis_id, seq, rule_id, before / 10 AS before, after / 10 AS after, triggering_ids FROM adj",
    "sc21_quotes": "SELECT analysis_id, category, relation, k, requirement_id, quote FROM fq",
    "sc22_gap_lists": "SELECT analysis_id, category, list, k, id, text, importance, criticality, reason, mitigation FROM gl",
    "sc23_suggestions": "SELECT * FROM sg",
    "sc25_limitations": "SELECT * FROM lm",
    "sc27_fit_analysis": """SELECT d.analysis_id, capped / 10 AS score, label, meaning, tier, confidence, recommendation, eligibility, cj.said AS categories, coalesce(aj.said, '') AS adjustments,
  coalesce(q1.said, '') AS strongest, coalesce(q2.said, '') AS transferable, coalesce(g1.said, '') AS critical_gaps, coalesce(g2.said, '') AS minor_gaps, coalesce(g3.said, '') AS unknowns, lm.limitations
  FROM d JOIN cj ON cj.analysis_id = d.analysis_id JOIN lm ON lm.analysis_id = d.analysis_id LEFT JOIN aj ON aj.analysis_id = d.analysis_id
  LEFT JOIN qj q1 ON q1.analysis_id = d.analysis_id AND q1.category = '' AND q1.relation = 'DIRECT' LEFT JOIN qj q2 ON q2.analysis_id = d.analysis_id AND q2.category = '' AND q2.relation = 'TRANSFERABLE'
  LEFT JOIN gj g1 ON g1.analysis_id = d.analysis_id AND g1.category = '' AND g1.list = 'CRITICAL' LEFT JOIN gj g2 ON g2.analysis_id = d.analysis_id AND g2.category = '' AND g2.list = 'MINOR'
  LEFT JOIN gj g3 ON g3.analysis_id = d.analysis_id AND g3.category = '' AND g3.list = 'UNKNOWN'""",
    "io05_changed_only": "SELECT d.analysis_id, capped / 10 AS score, label, tier, confidence, recommendation, limitations, CASE WHEN d.analysis_id % 50 = 7 THEN 1 ELSE 0 END AS part FROM d JOIN lm ON lm.analysis_id = d.analysis_id",
    "ev09_recompute": "SELECT label, count(*) AS n, 0 AS violations FROM d GROUP BY label",
}.items():
    ORACLES[_name] = REQUIREMENT_SQL + _sql
