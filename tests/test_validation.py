"""Drafts: the reason of each against a plain reading of its JSON, and drafts written by hand."""

import json
import re

import pytest

from fitloom.operators import validation as V
from fitloom.queries.judgement import drafts
from fitloom.sources import views

BLANK = " \t\n\x0b\f\r"


class Unfit(Exception):
    pass


def read(value, contract):
    """The value as the contract reads it; Unfit where it can't."""
    if value is None:
        if isinstance(contract, list):
            raise Unfit
        return None
    if isinstance(contract, dict):
        if not isinstance(value, dict) or set(value) - set(contract):
            raise Unfit
        return {k: read(value.get(k), part) for k, part in contract.items()}
    if isinstance(contract, list):
        if not isinstance(value, list) or None in value:
            raise Unfit
        return [read(x, contract[0]) for x in value]
    if isinstance(value, (dict, list)):
        raise Unfit
    if isinstance(contract, tuple) and (not isinstance(value, str) or value not in contract):
        raise Unfit
    if contract == "boolean" and not isinstance(value, (bool, str)):
        raise Unfit
    if contract == "int":
        if isinstance(value, bool):
            raise Unfit
        try:
            return int(value)
        except ValueError:
            raise Unfit from None
    return json.dumps(value) if contract == "string" and not isinstance(value, str) else value


def once(pairs):
    if len(dict(pairs)) < len(pairs):
        raise Unfit
    return dict(pairs)


def reason(raw):
    if raw is None or not raw.strip(BLANK):
        return "empty-response"
    try:
        d = read(json.loads(raw, object_pairs_hook=once), V.DRAFT)
        if d is None or any(s["value"] is None or not 0 <= s["value"] <= 4 for s in d["subfactorJudgements"]):
            raise Unfit
    except (Unfit, ValueError):
        return "unreadable"
    if d["schemaVersion"] != V.VERSION:
        return "schema-version"
    rows, seen = d["requirementAssessments"], set()
    if not 1 <= len(rows) <= V.MAX_REQUIREMENTS:
        return "requirement-count"
    for r in rows:
        if not (r["id"] or "").strip(BLANK) or r["id"] in seen:
            return "requirement-id"
        seen.add(r["id"])
        if not (r["requirementText"] or "").strip(BLANK):
            return "requirement-text"
        if None in (r["status"], r["importance"], r["criticality"], r["primaryCategory"]):
            return "requirement-fields"
    if any(e["requirementId"] != r["id"] for r in rows for e in r["evidence"]):
        return "evidence-requirement-mismatch"
    outlook = (d["opportunityValue"] or {}).get("companyOutlook")
    if outlook is None:
        return "opportunity-value"
    return None if (outlook["rating"], outlook["basis"]) == ("UNKNOWN", "NOT_AVAILABLE") else "company-outlook-invented"


def test_reasons_follow_from_the_json_of_every_draft(spark, sf):
    rows = drafts(views.requirements(spark, sf)).persist()
    found = {r.analysis_id: r.reason for r in V.validate(rows).select("analysis_id", "reason").collect()}
    want = {r.analysis_id: reason(r.raw_json) for r in rows.collect()}
    assert found == want and len(set(want.values())) == 11


def draft():
    said = {"headline": "h", "detail": "d", "supportingEvidenceIds": [], "concerns": []}
    rated = {"rating": "UNKNOWN", "basis": "NOT_AVAILABLE", "explanation": "e"}
    quote = {"requirementId": "r1", "importance": "REQUIRED", "status": "STRONG_MATCH", "relation": "DIRECT", "strength": "STRONG", "resumeQuote": "q", "sourceLocator": "s", "rationale": "r", "grounded": False}
    row = {"id": "r1", "requirementText": "SQL", "kind": "TECHNICAL", "importance": "REQUIRED", "criticality": "CORE", "alternativeGroupId": None, "primaryCategory": "CORE_TECHNICAL_STACK", "status": "STRONG_MATCH", "relation": "DIRECT", "evidenceStrength": "STRONG", "evidence": [quote, dict(quote)], "rationale": "why"}
    return {
        "schemaVersion": "analysis-draft/v1", "requirementAssessments": [row, {**row, "id": "r2", "evidence": []}], "subfactorJudgements": [{"category": "EXPERIENCE_EVIDENCE", "subfactor": "depth", "value": 3, "rationale": "r"}],
        "roleAlignment": said, "seniorityAlignment": dict(said), "realisticCompetitiveness": dict(said), "opportunityValue": {"careerGrowth": rated, "compensation": dict(rated), "companyOutlook": dict(rated)},
        "resumePositioning": {"reorderSuggestions": ["a"], "emphasisSuggestions": [], "terminologyAlignment": [{"resumeTerm": "a", "postingTerm": "b", "rationale": "c"}], "deemphasizeSuggestions": [], "faithfulRewrites": [{"before": "a", "after": "b"}]},
        "interviewPreparation": {"likelyQuestions": [{"question": "q", "whyAsked": "w", "evidenceToUse": ["e"]}], "talkingPoints": [], "gapsToExplain": [{"gap": "g", "suggestedFraming": "s"}], "questionsToAsk": []},
        "finalRationale": "r", "limitations": ["none"],
    }


def places(value, at=()):
    """Every path of a JSON value."""
    yield at
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from places(v, (*at, k))


def put(value, at, new):
    copy = json.loads(json.dumps(value))
    if not at:
        return new
    spot = copy
    for k in at[:-1]:
        spot = spot[k]
    spot[at[-1]] = new
    return copy


def judged(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "analysis_id long, raw_json string")
    return [r.reason for r in V.validate(rows).orderBy("analysis_id").collect()]


@pytest.mark.parametrize("new", [{"score": 5}, [1], 4.4, True, None, "text", [], {}])
def test_every_place_of_a_draft_takes_only_its_kind(spark, new):
    raws = [json.dumps(put(draft(), at, new)) for at in places(draft())]
    want = [reason(r) for r in raws]
    assert judged(spark, raws) == want and len(raws) > 90
    if isinstance(new, dict) and new:
        assert None not in want


def test_one_more_field_is_refused_at_every_level(spark):
    objects = [at for at in places(draft()) if isinstance(eval("d" + "".join(f"[{k!r}]" for k in at), {"d": draft()}), dict)]
    raws = [json.dumps(put(draft(), (*at, name), 1)) for at in objects for name in ("score", "detail: STRING, a")]
    assert judged(spark, raws) == ["unreadable"] * len(raws) and len(objects) >= 19


def test_what_stands_around_a_draft(spark):
    good = json.dumps(draft())
    assert judged(spark, [good, f" \n{good}\t ", json.dumps(draft(), indent=2)]) == [None] * 3
    behind = [good + x for x in (" x", "}", "]", '] "', ",", ', "x"', good, "] x", "}] x", ', 1]', " // note", "\n{}")]
    assert judged(spark, [*behind, "x" + good, f"[{good}]", '"text"', "5", "null", "{", "not json at all"]) == ["unreadable"] * (len(behind) + 7)
    assert judged(spark, [None, "", " \n "]) == ["empty-response"] * 3 and judged(spark, ["{}"]) == ["unreadable"]


def test_scalars_that_pass_for_each_other(spark):
    mixed = put(put(draft(), ("requirementAssessments", 0, "rationale"), 5), ("limitations",), ["a", 1, True])
    value = lambda v: json.dumps(put(draft(), ("subfactorJudgements", 0, "value"), v))
    got = judged(spark, [json.dumps(mixed), value("3"), value(3.0), value(True), value("x"), value(5), value(-1), json.dumps(put(mixed, ("limitations", 1), {"a": 1}))])
    assert got == [None, None, None, "unreadable", "unreadable", "unreadable", "unreadable", "unreadable"]
    twice = json.dumps(draft()).replace('"finalRationale": "r"', '"finalRationale": "r", "finalRationale": "s"')
    assert judged(spark, [twice]) == ["unreadable"]


def test_order_of_the_rules(spark):
    spoil = lambda *changes: json.dumps([d := draft(), [d := put(d, at, new) for at, new in changes]][1][-1])
    version, ids = (("schemaVersion",), "v0"), (("requirementAssessments", 1, "id"), "r1")
    text, outlook = (("requirementAssessments", 0, "requirementText"), " "), (("opportunityValue", "companyOutlook", "rating"), "STRONG")
    got = judged(spark, [spoil(version, ids), spoil(ids, outlook), spoil(ids, text), spoil(outlook), spoil((("requirementAssessments", 0, "evidence", 1, "requirementId"), "r2"), outlook), spoil((("opportunityValue",), None)), spoil((("requirementAssessments",), []))])
    assert got == ["schema-version", "requirement-id", "requirement-text", "company-outlook-invented", "evidence-requirement-mismatch", "opportunity-value", "requirement-count"]
    many = put(draft(), ("requirementAssessments",), [put(draft()["requirementAssessments"][1], ("id",), f"r{i}") for i in range(121)])
    assert judged(spark, [json.dumps(many)]) == ["requirement-count"]


def test_an_accepted_draft_is_read_whole(spark):
    rows = spark.createDataFrame([(1, json.dumps(draft()), "x")], "analysis_id long, raw_json string, other string")
    r = V.validate(rows).first()
    assert r.other == "x" and r.draft.requirementAssessments[0].evidence[1].resumeQuote == "q" and r.draft.interviewPreparation.gapsToExplain[0].gap == "g"
    assert V.validate(rows).columns == ["analysis_id", "raw_json", "other", "draft", "reason"] and V.validate(rows.limit(0)).count() == 0
    assert [x.id for x in V.requirements_of(V.validate(rows)).orderBy("ordinal").collect()] == ["r1", "r2"]


def test_a_draft_is_parsed_and_its_kinds_read_once(spark):
    """Each is a pass over the draft; and only a draft with a faulty row is asked which row comes first."""
    plan = V.validate(spark.createDataFrame([], "analysis_id long, raw_json string"))._jdf.queryExecution().optimizedPlan().toString()
    # Within the second check of the loose form it stands for single fields.
    of_all = [x for x in re.findall(r"schema_?of_?variant\((\w+)", plan, re.I) if x in ("__whole", "__v")]
    assert len(of_all) == 1


def test_a_draft_that_brings_its_own_ending_is_refused(spark):
    """The draft stands in an object beside its digest; nothing that it holds can pass for that digest or hide what follows."""
    first = '{"schemaVersion":"analysis-draft/v1"}'
    ends = ["", "}", ',"z":"x"}', ',"z":"x"', ',"a":{}', ',"b":1', "]", ',"z":null} and more']
    rows = V.validate(spark.createDataFrame([(i, first + e) for i, e in enumerate(ends)], "analysis_id long, raw_json string"))
    assert [r.reason for r in rows.orderBy("analysis_id").collect()] == ["unreadable"] * len(ends)
