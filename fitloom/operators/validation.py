"""Judgement drafts: strict reading of raw JSON with one reason per rejected draft, and the downgrade of gaps.

Everything but the downgrade is row by row. Reasons never quote a draft. A draft is parsed once, to a variant; its kinds, as Spark spells the variant's
type, are held to a pattern made of the contract, so an unknown field, an object or list where a text belongs, or a text where an object or list
belongs is refused at any depth, as is anything behind the draft. Scalars pass for each other where nothing is lost in meaning: a number or truth value
counts as the text it is written as, "3" and 3.0 as a number, "true" as a truth value; a number is no name, and a repeated key is refused. A null or blank
draft is empty; repeated rows get equal reasons; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import text as T
from fitloom.plans.steps import worked_out

VERSION, MAX_REQUIREMENTS = "analysis-draft/v1", 120
# The contract. A string stands for a kind, a tuple for the names that a text may have, a list for a list that must be there and
# holds no null, a dict for an object that has no other field.
IMPORTANCE, CRITICALITY = ("REQUIRED", "PREFERRED"), ("CORE", "SUPPORTING")
STATUS, RELATION, STRENGTH = ("STRONG_MATCH", "PARTIAL_MATCH", "GAP", "UNKNOWN"), ("DIRECT", "TRANSFERABLE", "NONE"), ("STRONG", "MODERATE", "WEAK", "NONE")
KIND = ("TECHNICAL", "EXPERIENCE", "EDUCATION", "DOMAIN", "SOFT_SKILL", "LOGISTICS", "LEGAL_ELIGIBILITY")
CATEGORY = ("CORE_TECHNICAL_STACK", "ROLE_AND_RESPONSIBILITY_ALIGNMENT", "EXPERIENCE_EVIDENCE", "SENIORITY_AND_OWNERSHIP", "REQUIRED_QUALIFICATION_COVERAGE", "DOMAIN_AND_OPERATING_ENVIRONMENT")
RATING, BASIS = ("STRONG", "MODERATE", "LIMITED", "UNKNOWN"), ("STATED_IN_POSTING", "INFERRED_FROM_POSTING", "NOT_AVAILABLE")
EVIDENCE = {
    "requirementId": "string", "importance": IMPORTANCE, "status": STATUS, "relation": RELATION, "strength": STRENGTH, "resumeQuote": "string", "sourceLocator": "string",
    "rationale": "string", "grounded": "boolean",
}
REQUIREMENT = {
    "id": "string", "requirementText": "string", "kind": KIND, "importance": IMPORTANCE, "criticality": CRITICALITY, "alternativeGroupId": "string", "primaryCategory": CATEGORY, "status": STATUS,
    "relation": RELATION, "evidenceStrength": STRENGTH, "evidence": [EVIDENCE], "rationale": "string",
}
NARRATIVE = {"headline": "string", "detail": "string", "supportingEvidenceIds": ["string"], "concerns": ["string"]}
ASSESSMENT = {"rating": RATING, "basis": BASIS, "explanation": "string"}
DRAFT = {
    "schemaVersion": "string",
    "requirementAssessments": [REQUIREMENT],
    "subfactorJudgements": [{"category": CATEGORY, "subfactor": "string", "value": "int", "rationale": "string"}],
    "roleAlignment": NARRATIVE,
    "seniorityAlignment": NARRATIVE,
    "realisticCompetitiveness": NARRATIVE,
    "opportunityValue": {"careerGrowth": ASSESSMENT, "compensation": ASSESSMENT, "companyOutlook": ASSESSMENT},
    "resumePositioning": {
        "reorderSuggestions": ["string"], "emphasisSuggestions": ["string"], "terminologyAlignment": [{"resumeTerm": "string", "postingTerm": "string", "rationale": "string"}],
        "deemphasizeSuggestions": ["string"], "faithfulRewrites": [{"before": "string", "after": "string"}],
    },
    "interviewPreparation": {
        "likelyQuestions": [{"question": "string", "whyAsked": "string", "evidenceToUse": ["string"]}], "talkingPoints": ["string"], "gapsToExplain": [{"gap": "string", "suggestedFraming": "string"}],
        "questionsToAsk": ["string"],
    },
    "finalRationale": "string",
    "limitations": ["string"],
}
GAP_RATIONALE = "Reported as unknown rather than missing: the resume has not been confirmed as read correctly, so absent evidence cannot be treated as absent experience."
GAP_LIMITATION = "The resume was not confirmed as correctly read, so nothing missing from it is reported as a gap. Confirm the extracted resume for a sharper result."


def _blank(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ddl(contract, scalar: str | None = None) -> str:
    """The type that a contract is read as; scalar: the type of all its scalars."""
    if isinstance(contract, dict):
        return f"struct<{','.join(f'{name}:{ddl(part, scalar)}' for name, part in contract.items())}>"
    return f"array<{ddl(contract[0], scalar)}>" if isinstance(contract, list) else scalar or (contract if isinstance(contract, str) else "string")


#: What stands for each kind of scalar in a variant's type; VARIANT is one field with several kinds, of several elements of a list.
SCALARS = {"string": r"STRING|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d+,\d+\)", "int": r"BIGINT|DOUBLE|STRING|DECIMAL\(\d+,\d+\)", "boolean": "BOOLEAN|STRING"}


def _kind(contract) -> str:
    return SCALARS[contract if isinstance(contract, str) else "string"]


def type_pattern(contract) -> str:
    """A pattern that a variant's type fits if the variant has no field beyond the contract and its kinds everywhere. Null fits any kind."""
    if isinstance(contract, dict):
        fields = "".join(rf"(?:{name}: {type_pattern(part)}(?:, (?=[a-z])|(?=>)))?" for name, part in sorted(contract.items()))
        return f"(?:VOID|OBJECT<{fields}>)"
    if isinstance(contract, list):
        return f"(?:VOID|ARRAY<{type_pattern(contract[0])}>)"
    return f"(?:VOID|VARIANT|{_kind(contract)})"


# The two checks below go through the whole contract. They are spelt as SQL, parsed once, as building them column by column takes seconds on the driver.


def _mixed(found: str, contract, depth: int = 0) -> str:
    """SQL: whether a field holds anything but its kind of scalar; found: a draft as ``ddl`` with variants in place of scalars."""
    if isinstance(contract, dict):
        return "(" + " OR ".join(_mixed(f"{found}.{name}", part, depth) for name, part in contract.items()) + ")"
    if isinstance(contract, list):
        return f"coalesce(exists({found}, x{depth} -> {_mixed(f'x{depth}', contract[0], depth + 1)}), false)"
    return f"coalesce(NOT schema_of_variant({found}) RLIKE r'^(?:VOID|{_kind(contract)})$', false)"


def _breaks(found: str, contract, depth: int = 0) -> str:
    """SQL: whether a list or a list's element is missing, or a text isn't among its names, anywhere in what was read."""
    if isinstance(contract, tuple):
        return f"coalesce(NOT {found} IN ({', '.join(map(repr, contract))}), false)"
    if isinstance(contract, list):
        x = f"x{depth}"
        return f"({found} IS NULL OR coalesce(exists({found}, {x} -> {x} IS NULL OR {_breaks(x, contract[0], depth + 1)}), false))"
    if isinstance(contract, dict):
        parts = [_breaks(f"{found}.{name}", part, depth) for name, part in contract.items() if not isinstance(part, str)]
        return f"({found} IS NOT NULL AND ({' OR '.join(parts) or 'false'}))"
    return "false"


def validate(drafts: DataFrame) -> DataFrame:
    """``drafts`` (analysis_id, raw_json) with draft and reason; the first rule that fails gives the one reason."""
    raw = F.col("raw_json")
    # The draft and its own digest are the two fields of one object, and these alone: a parser stops where its value ends, and text behind it would go unseen.
    rows = worked_out(drafts, __whole=F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit(',"z":"'), F.md5(raw), F.lit('"}'))), __empty=_blank(raw))
    alone = F.try_variant_get("__whole", "$.z", "string") == F.md5(raw)
    rows = worked_out(rows, __kind=F.schema_of_variant("__whole"), __alone=alone)
    rows = worked_out(rows, __fits=F.col("__kind").rlike(f"^OBJECT<a: {type_pattern(DRAFT)}, z: STRING>$") & F.col("__alone"))
    loose = F.col("__fits") & F.contains("__kind", F.lit("VARIANT"))
    rows = worked_out(rows, draft=F.when(F.col("__fits"), F.try_variant_get("__whole", "$.a", ddl(DRAFT))), __loose=F.when(loose, F.try_variant_get("__whole", "$.a", ddl(DRAFT, "variant"))))
    d = F.col("draft")
    reqs = d["requirementAssessments"]
    bad_value = F.exists(d["subfactorJudgements"], lambda s: s["value"].isNull() | ~s["value"].between(0, 4))
    ids = reqs["id"]
    missing = lambda r: r["status"].isNull() | r["importance"].isNull() | r["criticality"].isNull() | r["primaryCategory"].isNull()

    def row_reason(r: Column, i: Column) -> Column:
        repeated = F.coalesce(F.array_position(ids, r["id"]) <= i, F.lit(False))
        return F.when(_blank(r["id"]) | repeated, "requirement-id").when(_blank(r["requirementText"]), "requirement-text").when(missing(r), "requirement-fields")

    # Which row comes first is only asked where some row has a fault.
    faulty = F.exists(reqs, lambda r: _blank(r["id"]) | _blank(r["requirementText"]) | missing(r)) | (F.size(F.array_distinct(ids)) < F.size(ids))
    rows = worked_out(rows, __first=F.when(faulty, F.get(F.array_compact(F.transform(reqs, row_reason)), 0)))
    first = F.col("__first")
    mismatch = F.exists(reqs, lambda r: F.exists(r["evidence"], lambda e: ~e["requirementId"].eqNullSafe(r["id"])))
    outlook = d["opportunityValue"]["companyOutlook"]
    reason = (
        F.when(F.col("__empty"), "empty-response")
        .when(d.isNull() | (F.col("__loose").isNotNull() & F.expr(_mixed("__loose", DRAFT))) | F.expr(_breaks("draft", DRAFT)) | _no(bad_value), "unreadable")
        .when(~d["schemaVersion"].eqNullSafe(F.lit(VERSION)), "schema-version")
        .when(~F.size(reqs).between(1, MAX_REQUIREMENTS), "requirement-count")
        .when(first.isNotNull(), first)
        .when(_no(mismatch), "evidence-requirement-mismatch")
        .when(outlook.isNull(), "opportunity-value")
        .when(~(outlook["rating"].eqNullSafe(F.lit("UNKNOWN")) & outlook["basis"].eqNullSafe(F.lit("NOT_AVAILABLE"))), "company-outlook-invented")
    )
    refused = F.col("reason").isNotNull()
    rows = worked_out(rows, reason=reason)
    return rows.select(*drafts.columns, F.when(~refused | (F.col("reason") != "unreadable"), F.col("draft")).alias("draft"), "reason")


def requirements_of(valid: DataFrame) -> DataFrame:
    """Accepted drafts as requirement rows."""
    # No filter on the reason: pushed below, it would be worked out twice.
    rows = valid.select("analysis_id", F.posexplode(F.when(F.col("reason").isNull(), F.col("draft.requirementAssessments"))).alias("i", "r"))
    return rows.select(
        "analysis_id", (F.col("i") + 1).alias("ordinal"), "r.id", F.col("r.requirementText").alias("text"), "r.kind", "r.importance", "r.criticality",
        F.col("r.alternativeGroupId").alias("alternative_group_id"), F.col("r.primaryCategory").alias("primary_category"), "r.status", "r.relation",
        F.col("r.evidenceStrength").alias("strength"), "r.rationale", "r.evidence",
    )


def downgrade_gaps(requirement: DataFrame, policy: DataFrame) -> DataFrame:
    """Under MUST_BE_UNKNOWN (policy: analysis_id, absence; a missing one counts as that) gaps become unknown, and every row of
    an analysis so changed carries the limitation."""
    rows = requirement.join(policy, "analysis_id", "left")
    hit = (F.col("status") == "GAP") & (F.coalesce("absence", F.lit("MUST_BE_UNKNOWN")) == "MUST_BE_UNKNOWN")
    rows = rows.withColumn("hit", hit).withColumn("limitation", F.when(F.bool_or("hit").over(W.partitionBy("analysis_id")), GAP_LIMITATION))
    changed = rows.withColumn("rationale", F.when(F.col("hit"), GAP_RATIONALE).otherwise(F.col("rationale")))
    return changed.withColumn("status", F.when(F.col("hit"), "UNKNOWN").otherwise(F.col("status"))).drop("absence", "hit")
