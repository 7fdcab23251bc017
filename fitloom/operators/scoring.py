"""The rubric over a table of requirements: coverage, scores, ceilings, tier, confidence, recommendation and explanations.

Every operator is keyed by analysis_id. An analysis (at most 120 requirements) is folded into one row; what is decided of it and all its lists
come from that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import rubric
from fitloom.plans.steps import met, worked_out

# What readers of a result see.
CAP_NOTE = " Evidence strength was reduced because this technology appears only in the skills list, not inside a role or project."
LEADERSHIP = "lead|mentor|manage|staff|principal"
CAVEAT = "Ratings compare the job posting with experience explicitly documented in the resume. Unlisted experience may not be reflected, and required qualifications are weighted more heavily than preferred qualifications."
CEILING_NOTE = "A score ceiling was applied. See the scoring adjustments for which requirement caused it."
LOW_NOTE = "Confidence in this analysis is low. Check the extraction warnings and confirm the documents again before relying on the result."
GAP_REASON = "The posting asks for this and the resume shows no supporting evidence."
UNKNOWN_REASON = "The resume does not say either way, so this has not counted against you."
GAP_HELP = "Be ready to explain how you would cover this, or look for adjacent experience already in your resume that speaks to it."
UNKNOWN_HELP = "Add a line to the relevant role if you have this experience."
SUGGESTION = ('If you have done this, say so explicitly: "', '". Describe it inside a role or project rather than only in a skills list.')
CELL = ["items", "unknown", "coverage"]
SUBFACTOR_CATEGORIES = ["EXPERIENCE_EVIDENCE", "SENIORITY_AND_OWNERSHIP"]
REQUIREMENT_CATEGORIES = [*rubric.COVERAGE_CATEGORIES, rubric.REQUIRED]
QUOTES = "array<struct<pos:int,quote:string,grounded:boolean>>"


def cap_skills_list_only(requirement: DataFrame, skill: DataFrame) -> DataFrame:
    """Technical requirements that name a skill which is listed but nowhere shown at work have weak evidence at most."""
    lower = skill.select("analysis_id", F.lower("name").alias("name"), "origin")
    of = lambda where: F.collect_set(F.when(where, F.col("name")))
    names = met(lower, "analysis_id", listed=of(F.col("origin") == "SKILLS_LIST"), shown=of(F.col("origin") != "SKILLS_LIST"))
    names = names.select("analysis_id", F.array_except("listed", "shown").alias("listed_only"))
    rows = requirement.join(names, "analysis_id", "left")
    named = F.coalesce(F.exists("listed_only", lambda n: F.contains(F.lower("text"), n)), F.lit(False))
    capped = (F.col("kind") == "TECHNICAL") & F.col("strength").isin("STRONG", "MODERATE") & named
    return rows.withColumn("rationale", F.when(capped, F.concat("rationale", F.lit(CAP_NOTE))).otherwise(F.col("rationale"))).withColumn("strength", F.when(capped, "WEAK").otherwise(F.col("strength"))).drop("listed_only")


def with_credit(requirement: DataFrame) -> DataFrame:
    return requirement.withColumn("weight4", rubric.weight(F.col("importance"), F.col("criticality"))).withColumn("credit4", rubric.credit(F.col("status"), F.col("relation"), F.col("strength")))


def gathered(requirement: DataFrame, lists: bool = False) -> DataFrame:
    """One row per analysis: analysis_id and rows, its requirements in order, each with what is counted of it; texts only of gaps in the core. With
    ``lists``, requirements too: all of them in order, with their texts and evidence. A requirement travels once, as one row."""
    if "evidence" not in requirement.columns:
        requirement = requirement.withColumn("evidence", F.lit(None).cast(QUOTES))
    quotes = F.coalesce(F.col("evidence"), F.array().cast(QUOTES))
    yes = lambda c: F.coalesce(c, F.lit(False))
    required, gap = F.col("importance") == "REQUIRED", F.col("status") == "GAP"
    core = yes(required & gap & (F.col("criticality") == "CORE"))
    counted = F.struct(
        "ordinal", F.col("primary_category").alias("own"), yes(required).alias("required"), F.when(F.trim("alternative_group_id") != "", F.col("alternative_group_id")).alias("group"),
        "credit4", "weight4", core.alias("core"), F.when(core, F.col("id")).alias("id"), F.when(core, F.col("text")).alias("text"),
        yes(required & gap & (F.col("kind") == "LEGAL_ELIGIBILITY")).alias("barred"), yes(F.col("status") == "UNKNOWN").alias("unknown"), yes(F.lower("text").rlike(LEADERSHIP)).alias("leads"),
        F.size(quotes).alias("quotes"), F.size(F.filter(quotes, lambda e: ~e["grounded"])).alias("dropped"),
    )
    shown = [F.struct("ordinal", "id", "text", "importance", "criticality", "primary_category", "status", "relation", quotes.alias("evidence")).alias("shown")] if lists else []
    rows = with_credit(requirement).groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", counted.alias("counted"), *shown))).alias("rows"))
    return rows.select("analysis_id", F.col("rows.counted").alias("rows"), *([F.col("rows.shown").alias("requirements")] if lists else []))


def best_of(rows: Column, category: Column) -> Column:
    """Those of an analysis's gathered rows that count in a category: its own, or the required ones; of each alternative group there the one of most
    credit, the first of equals."""
    inside = lambda r: r["own"].eqNullSafe(category) & r["own"].isin(rubric.COVERAGE_CATEGORIES) | (category == rubric.REQUIRED) & r["required"]
    worth = lambda r: F.coalesce(r["credit4"], F.lit(-1))
    beats = lambda q, r: q["group"].eqNullSafe(r["group"]) & F.coalesce(inside(q), F.lit(False)) & ((worth(q) > worth(r)) | ((worth(q) == worth(r)) & (q["ordinal"] < r["ordinal"])))
    return F.filter(rows, lambda r: F.coalesce(inside(r), F.lit(False)) & (r["group"].isNull() | ~F.exists(rows, lambda q: beats(q, r))))


def best_alternatives(requirement: DataFrame) -> DataFrame:
    """analysis_id, category, ordinal of the rows that count in each requirement category."""
    categories = F.array(*map(F.lit, REQUIREMENT_CATEGORIES))
    found = gathered(requirement).select("analysis_id", "rows", F.explode(categories).alias("category"))
    return found.select("analysis_id", "category", F.explode(best_of(F.col("rows"), F.col("category"))).alias("r")).select("analysis_id", "category", "r.ordinal")


def _sums(rows: Column) -> Column:
    """items, unknown, num and den of each requirement category, in order."""
    zero = F.lit(0).cast("long")
    none = F.struct(zero.alias("items"), zero.alias("unknown"), zero.alias("num"), zero.alias("den"))

    def add(done: Column, r: Column) -> Column:
        known = r["credit4"].isNotNull()
        part = lambda name, x: (done[name] + F.when(known, x).otherwise(zero)).alias(name)
        weight = r["weight4"].cast("long")
        return F.struct(part("items", F.lit(1).cast("long")), (done["unknown"] + F.when(known, zero).otherwise(1)).alias("unknown"), part("num", r["credit4"] * weight), part("den", weight * 10000))

    return F.transform(F.array(*map(F.lit, REQUIREMENT_CATEGORIES)), lambda c: F.aggregate(best_of(rows, c), none, add))


def _coverage(sums: Column) -> Column:
    return F.when(sums["items"] >= rubric.MINIMUM_ITEMS, rubric.ratio(sums["num"], sums["den"]))


def requirement_coverage(requirement: DataFrame) -> DataFrame:
    """analysis_id, category, items, unknown, coverage (10^-10, null under two items) of the four requirement categories."""
    rows = gathered(requirement).select("analysis_id", F.posexplode(_sums(F.col("rows"))).alias("i", "s")).filter("s.items + s.unknown > 0")
    name = F.get(F.array(*map(F.lit, REQUIREMENT_CATEGORIES)), F.col("i"))
    return rows.select("analysis_id", name.alias("category"), "s.items", "s.unknown", _coverage(F.col("s")).alias("coverage"))


def asks_for_leadership(requirement: DataFrame) -> DataFrame:
    return requirement.groupBy("analysis_id").agg(F.bool_or(F.lower("text").rlike(LEADERSHIP)).alias("leadership"))


def subfactor_coverage(subfactor: DataFrame, leadership: DataFrame) -> DataFrame:
    """Coverage of the two subfactor categories: value / 4 by weight over the subfactors that were given."""
    rows = _subfactor_sums(subfactor).join(leadership, "analysis_id", "left")
    cells = F.array(*[F.struct(F.lit(c).alias("category"), *[x.alias(n) for n, x in zip(CELL, _subfactor_cell(c))]) for c in SUBFACTOR_CATEGORIES])
    return rows.select("analysis_id", F.explode(cells).alias("c")).select("analysis_id", "c.*").filter("items > 0")


def _subfactor_sums(subfactor: DataFrame) -> DataFrame:
    """Per analysis and subfactor category, items, num and den, with those of the leadership row apart."""
    w = F.lit(None).cast("long")
    for c, s, weight in rubric.SUBFACTORS:
        w = F.when((F.col("category") == c) & (F.col("subfactor") == s), F.lit(weight).cast("long")).otherwise(w)
    rows = subfactor.withColumn("w", w).filter("w is not null")
    leads, sums = F.col("subfactor") == "leadership", []
    for i, c in enumerate(SUBFACTOR_CATEGORIES):
        here = F.col("category") == c
        for name, only in (("own", here & ~leads), ("lead", here & leads)):
            sums += [F.count_if(only).alias(f"{name}_items_{i}"), F.sum(F.when(only, F.col("value").cast("long") * F.col("w"))).alias(f"{name}_num_{i}"), F.sum(F.when(only, F.col("w") * 4)).alias(f"{name}_den_{i}")]
    return rows.groupBy("analysis_id").agg(*sums)


def _subfactor_cell(category: str) -> tuple[Column, Column, Column]:
    """items, unknown and coverage."""
    i, zero = SUBFACTOR_CATEGORIES.index(category), F.lit(0).cast("long")
    total = lambda x: F.coalesce(F.col(f"own_{x}_{i}"), zero) + F.when(F.coalesce("leadership", F.lit(False)), F.coalesce(F.col(f"lead_{x}_{i}"), zero)).otherwise(zero)
    return total("items"), zero, F.when(total("items") >= rubric.MINIMUM_ITEMS, rubric.ratio(total("num"), total("den")))


def with_evidence(requirement: DataFrame, evidence: DataFrame) -> DataFrame:
    """``requirement`` with evidence, its quotes in order: pos, quote, grounded. evidence: analysis_id, requirement_id, pos, quote, grounded."""
    said = evidence.groupBy("analysis_id", F.col("requirement_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "quote", "grounded"))).alias("evidence"))
    return requirement.drop("evidence").join(said, ["analysis_id", "id"], "left")


def folded(requirement: DataFrame, lists: bool = False) -> DataFrame:
    """One row per analysis from one pass over its requirements (with evidence): sums of the requirement categories, gaps, eligibility, counts,
    leadership, quotes; with ``lists``, requirements too. Requirements meet in one shuffle, and none if they lie by analysis."""
    rows, r = gathered(requirement, lists), F.col("rows")
    count = lambda name: F.size(F.filter(r, lambda x: x[name]))
    total = lambda name: F.aggregate(r, F.lit(0), lambda n, x: n + x[name]).cast("long")
    rows = worked_out(
        rows,
        sums=_sums(r),
        core=F.transform(F.filter(r, lambda x: x["core"]), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["id"].alias("id"), x["text"].alias("text"))),
        eligibility=F.when(F.exists(r, lambda x: x["barred"]), "NOT_ELIGIBLE").otherwise("UNKNOWN"),
        n=F.size(r).cast("long"), n_unknown=count("unknown").cast("long"), leadership=F.exists(r, lambda x: x["leads"]), quotes=total("quotes"), dropped=total("dropped"),
    )
    return rows.drop("rows")


def with_categories(fold: DataFrame, subfactor: DataFrame) -> DataFrame:
    """``fold`` with categories (six structs in order), total, required_coverage and seniority."""
    rows = fold.join(_subfactor_sums(subfactor), "analysis_id", "left")

    def cell(category: str) -> tuple[Column, Column, Column]:
        if category in SUBFACTOR_CATEGORIES:
            return _subfactor_cell(category)
        sums = F.col("sums")[REQUIREMENT_CATEGORIES.index(category)]
        return sums["items"], sums["unknown"], _coverage(sums)

    own = [c for c in fold.columns if c != "sums"]
    cells = [F.struct(F.lit(i).alias("seq"), F.lit(c).alias("category"), F.lit(n).alias("display_name"), F.lit(w).alias("nominal"), *[x.alias(name) for name, x in zip(CELL, cell(c))]) for i, (c, n, w) in enumerate(rubric.CATEGORIES)]
    # Each step is one expression over the array of categories, not six: the optimizer's time follows that.
    names = ["seq", "category", "display_name", "nominal", *CELL]
    scored = lambda c: F.struct(*[c[x].alias(x) for x in names], c["coverage"].isNotNull().alias("rated"), rubric.score_of(c["coverage"]).alias("score"))
    rows = worked_out(rows.select(*own, F.array(*cells).alias("given")), cells=F.transform("given", scored)).drop("given")
    rows = rows.withColumn("rated_weight", F.aggregate("cells", F.lit(0), lambda n, c: n + F.when(c["rated"], c["nominal"]).otherwise(0)))
    applied = lambda c: F.when(c["rated"], F.call_function("div", 2 * c["nominal"] * 10000 + F.col("rated_weight"), F.greatest(2 * F.col("rated_weight"), F.lit(1)))).otherwise(0).cast("int")
    rows = worked_out(rows, categories=F.transform("cells", lambda c: F.struct(*[c[x].alias(x) for x in [*names, "rated", "score"]], applied(c).alias("applied"))))
    total = F.aggregate("categories", F.lit(0).cast("long"), lambda n, c: n + c["score"].cast("long") * c["applied"])
    of = lambda name: F.get(F.filter("cells", lambda c: c["category"] == name), 0)
    return rows.select(*own, "categories", F.call_function("div", 2 * total + 10000, F.lit(20000)).cast("int").alias("total"), of(rubric.REQUIRED)["coverage"].alias("required_coverage"), of("SENIORITY_AND_OWNERSHIP")["score"].alias("seniority"))


def category_results(requirement: DataFrame, subfactor: DataFrame) -> DataFrame:
    """Six rows per analysis with requirements: rated, coverage, score (tenths), nominal (hundredths) and applied weight (10^-4)."""
    rows = with_categories(folded(requirement), subfactor)
    return rows.select("analysis_id", F.explode("categories").alias("c")).select("analysis_id", "c.*").drop("seq")


def gaps_and_eligibility(requirement: DataFrame) -> DataFrame:
    """Core gaps (count, ids, texts in order), eligibility, and counts of requirements and unknowns."""
    return folded(requirement).select("analysis_id", F.size("core").alias("core_gaps"), F.col("core.id").alias("gap_ids"), F.array_join("core.text", "; ").alias("gap_texts"), "eligibility", "n", "n_unknown")


def with_ceilings(rows: DataFrame) -> DataFrame:
    """``rows`` (total, core_gaps, eligibility) with the score after each ceiling that lowers it."""
    not_eligible = (F.col("eligibility") == "NOT_ELIGIBLE") & (F.col("total") > rubric.NOT_ELIGIBLE_CEILING)
    rows = rows.withColumn("first_cap", not_eligible).withColumn("after_first", F.when(not_eligible, rubric.NOT_ELIGIBLE_CEILING).otherwise(F.col("total")))
    limit = F.when(F.col("core_gaps") == 1, rubric.ONE_GAP).when(F.col("core_gaps") == 2, rubric.TWO_GAPS).when(F.col("core_gaps") > 2, rubric.MORE_GAPS)
    rows = rows.withColumn("gap_limit", limit)
    second = F.coalesce(F.col("after_first") > F.col("gap_limit"), F.lit(False))
    return rows.withColumn("second_cap", second).withColumn("capped", F.when(second, F.col("gap_limit")).otherwise(F.col("after_first")))


def adjustment_list() -> Column:
    """Of a row with ceilings: those that lowered the score, in order."""
    one = F.when(F.col("first_cap"), F.struct(F.lit(1).alias("seq"), F.lit("NOT_ELIGIBLE").alias("rule_id"), F.col("total").alias("before"), F.lit(rubric.NOT_ELIGIBLE_CEILING).alias("after"), F.lit("").alias("ids")))
    rule = F.when(F.col("core_gaps") == 1, "CORE_GAP_SINGLE").when(F.col("core_gaps") == 2, "CORE_GAP_MULTIPLE").otherwise("CORE_GAP_SEVERE")
    two = F.when(F.col("second_cap"), F.struct(F.lit(2).alias("seq"), rule.alias("rule_id"), F.col("after_first").alias("before"), F.col("gap_limit").alias("after"), F.array_join("gap_ids", ",").alias("ids")))
    return F.array_compact(F.array(one, two))


def adjustments(capped: DataFrame) -> DataFrame:
    """A row per ceiling that lowered the score, in order."""
    rows = capped.select("analysis_id", F.explode(adjustment_list()).alias("a"))
    return rows.select("analysis_id", "a.seq", "a.rule_id", (F.col("a.before") / 10).alias("before"), (F.col("a.after") / 10).alias("after"), F.col("a.ids").alias("triggering_ids"))


def decisions(requirement: DataFrame, subfactor: DataFrame, resume: DataFrame, evidence: DataFrame | None = None, lists: bool = False) -> DataFrame:
    """One row per analysis with everything that is decided from the scores; scores in tenths. Quotes come from ``evidence``, or from the
    requirements' own column of that name."""
    if evidence is not None:
        requirement = with_evidence(requirement, evidence)
    rows = with_categories(folded(requirement, lists), subfactor).join(resume, "analysis_id", "left")
    rows = rows.withColumns({"core_gaps": F.size("core"), "gap_ids": F.col("core.id"), "gap_texts": F.array_join("core.text", "; ")}).drop("core", "leadership")
    rows = with_ceilings(rows)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sure = rubric.confidence(F.coalesce("high_warning", F.lit(False)), zero("resume_chars"), F.col("n_unknown"), F.col("n"), zero("dropped"), zero("quotes"))
    rows = rows.withColumn("confidence", sure).withColumn("label", rubric.label_of(F.col("capped"))).withColumn("meaning", rubric.meaning_of(F.col("capped")))
    rows = rows.withColumn("tier", rubric.tier(F.col("core_gaps"), F.col("required_coverage"), F.col("seniority")))
    return rows.withColumn("recommendation", rubric.recommendation(F.col("capped"), F.col("core_gaps"), F.col("eligibility"), F.col("confidence")))


def first_quotes(requirements: Column, relation: str, limit: int = 8) -> Column:
    """The first grounded quotes of those requirements (an array in order) that have a relation: requirement_id, quote."""
    said = lambda r: F.transform(F.filter(r["evidence"], lambda e: e["grounded"]), lambda e: F.struct(r["id"].alias("requirement_id"), e["quote"].alias("quote")))
    return F.slice(F.flatten(F.transform(F.filter(requirements, lambda r: r["relation"] == relation), said)), 1, limit)


def requirement_gaps(requirements: Column, status: str, core: bool | None = None) -> Column:
    """Those requirements (an array in order) with a status, GAP or UNKNOWN, with reason and help; core: only core ones, or only others,
    whatever their importance."""
    unknown = status == "UNKNOWN"
    fits = lambda r: (r["status"] == status) & (F.lit(True) if core is None else (r["criticality"] == "CORE") == core)
    row = lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text"), r["importance"].alias("importance"), r["criticality"].alias("criticality"), F.lit(UNKNOWN_REASON if unknown else GAP_REASON).alias("reason"), F.lit(UNKNOWN_HELP if unknown else GAP_HELP).alias("mitigation"))
    return F.transform(F.filter(requirements, fits), row)


def suggestions(requirements: Column, limit: int = 3) -> Column:
    """Advice on the first unknown or partly matched of those requirements."""
    some = F.slice(F.filter(requirements, lambda r: r["status"].isin("UNKNOWN", "PARTIAL_MATCH")), 1, limit)
    return F.transform(some, lambda r: F.concat(F.lit(SUGGESTION[0]), r["text"], F.lit(SUGGESTION[1])))


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def explained(c: Column) -> tuple[Column, Column]:
    """A category's summary and the explanation of its score."""
    name, items, unknown = c["display_name"], c["items"], c["unknown"]
    # Strung together: a format string is read anew for each row.
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    unrated = said("There was not enough information to rate ", name, ". ", unknown, " requirement", _plural(unknown), " could not be judged from the resume, so this category is shown at zero rather than guessed at.")
    rated = said(name, " was rated from ", items, " requirement", _plural(items), " the resume could be judged against.")
    percent = F.call_function("div", 2 * c["coverage"] + F.lit(rubric.UNIT // 100), F.lit(2 * rubric.UNIT // 100))
    why = said(
        "The resume answers ", percent, "% of the weighted requirements in this category, which maps to ", F.floor(c["score"] / 10).cast("int"), ".", c["score"] % 10,
        " on the published scale. Required qualifications count nearly three times what preferred ones do, and core requirements count half again as much. ", unknown, " requirement", _plural(unknown),
        " could not be judged and ", F.when(unknown == 1, "was").otherwise("were"), " excluded from the ratio.",
    )
    none = F.lit(f"No score could be derived: fewer than {rubric.MINIMUM_ITEMS} requirements in this category could be judged. Unknown requirements are excluded from the calculation rather than counted against the candidate, so nothing here has lowered the total unfairly.")
    return F.when(c["rated"], rated).otherwise(unrated), F.when(c["rated"], why).otherwise(none)


def explanations(categories: DataFrame) -> DataFrame:
    """Each category's summary and the explanation of its score."""
    summary, impact = explained(F.struct("*"))
    return categories.withColumns({"summary": summary, "impact": impact})


def limitations(drafted: Column | None = None) -> Column:
    """Of a decided row: the draft's limitations, notes on a ceiling and on low confidence, and the caveat last."""
    lead = F.array().cast("array<string>") if drafted is None else drafted
    notes = F.array_compact(F.array(F.when(F.col("first_cap") | F.col("second_cap"), CEILING_NOTE), F.when(F.col("confidence") == "LOW", LOW_NOTE), F.lit(CAVEAT)))
    return F.concat(lead, notes)


def fit_analysis(requirement: DataFrame, subfactor: DataFrame, skill: DataFrame, resume: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One nested row per analysis: decisions, categories with their own lists, adjustments, quotes, gap lists, limitations. All lists come
    from the one row that holds the analysis, so nothing is shuffled for them."""
    decided = decisions(cap_skills_list_only(requirement, skill), subfactor, resume, evidence, lists=True)
    every = F.col("requirements")
    # A category's own requirements are told apart once for its five lists.
    owned = F.transform("categories", lambda c: F.struct(c.alias("c"), F.filter(every, lambda r: r["primary_category"] == c["category"]).alias("own")))

    def full(c: Column, own: Column) -> Column:
        summary, impact = explained(c)
        return F.struct(
            *[c[n].alias(n) for n in ("seq", "category", "display_name", "rated", "nominal", "applied", "score", "items", "unknown", "coverage")], rubric.label_of(c["score"]).alias("label"), summary.alias("summary"), impact.alias("impact"),
            first_quotes(own, "DIRECT").alias("direct"), first_quotes(own, "TRANSFERABLE").alias("transferable"), requirement_gaps(own, "GAP").alias("gaps"),
            requirement_gaps(own, "UNKNOWN").alias("unknowns"), suggestions(own).alias("suggestions"),
        )

    return decided.withColumns({
        "categories": F.transform(owned, lambda x: full(x["c"], x["own"])), "adjustments": adjustment_list(), "strongest": first_quotes(every, "DIRECT"), "transferable": first_quotes(every, "TRANSFERABLE"),
        "critical_gaps": requirement_gaps(every, "GAP", True), "minor_gaps": requirement_gaps(every, "GAP", False), "unknowns": requirement_gaps(every, "UNKNOWN"), "limitations": limitations(),
    })


def off_sum(categories: Column) -> Column:
    """Of a decided row: whether it has no ceiling and its shown score isn't the rounded sum of ``categories``' shown scores by applied weights."""
    shown = lambda c: (c["score"] / 10).cast("decimal(3,1)") * (c["applied"] / 10000).cast("decimal(5,4)")
    again = F.round(F.aggregate(categories, F.lit(0).cast("decimal(19,5)"), lambda n, c: (n + shown(c)).cast("decimal(19,5)")), 1)
    return F.coalesce(~F.col("first_cap") & ~F.col("second_cap") & ((F.col("capped") / 10).cast("decimal(3,1)") != again), F.lit(False))


def recompute_violations(decided: DataFrame, categories: DataFrame) -> DataFrame:
    """Analyses without a ceiling whose shown score isn't the rounded sum of shown category scores by applied weights."""
    again = categories.groupBy("analysis_id").agg(F.round(F.sum((F.col("score") / 10).cast("decimal(3,1)") * (F.col("applied") / 10000).cast("decimal(5,4)")), 1).alias("again"))
    rows = decided.filter(~F.col("first_cap") & ~F.col("second_cap")).join(again, "analysis_id")
    return rows.filter((F.col("capped") / 10).cast("decimal(3,1)") != F.col("again")).select("analysis_id")
