"""Judgements from wording: requirement tables, kinds, evidence by shared terms, subfactors, advice and prompts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import rubric
from fitloom.functions import text as T

# Words of an operating environment.
DOMAIN_HINTS = ["aws", "azure", "gcp", "cloud", "kubernetes", "docker", "terraform", "production", "reliability", "scale", "uptime", "incident", "on-call", "observability", "monitoring"]
PER_LIST, CORE = 20, 4
#: Stands between sentences.
BREAK = "\x01"
MATCHED = "Matched on wording shared between the requirement and the resume."
UNSURE = "No matching wording was found, and the resume is not confirmed, so this is reported as unknown."
UNFOUND = "No matching wording was found in the resume. Whether the experience exists under different wording is not something this provider can determine."


def kind_of(text: Column) -> Column:
    t = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    return (
        F.when(has(["degree", "bachelor", "master"]), "EDUCATION")
        .when(has(["authoriz", "authoris", "visa", "licen"]), "LEGAL_ELIGIBILITY")
        .when(t.rlike(T.ascii_edges(r"\b\d+\+?\s*years?\b")), "EXPERIENCE")
        .when(has(DOMAIN_HINTS), "DOMAIN")
        .otherwise("TECHNICAL")
    )


def requirement_table(listed: DataFrame, pairs: DataFrame) -> DataFrame:
    """analysis_id, ordinal, id, text, importance, criticality, kind, primary_category of each pair (analysis_id, posting_id,
    resume_id): the first 20 required, preferred and responsibility items; a posting without any gets one stand-in."""
    place = F.when(F.col("list") == "REQUIRED", 0).when(F.col("list") == "PREFERRED", 1).when(F.col("list") == "RESPONSIBILITY", 2)
    rows = listed.withColumn("place", place).filter((F.col("pos") <= PER_LIST) & F.col("place").isNotNull())
    rows = pairs.join(rows.withColumnRenamed("doc_id", "posting_id"), "posting_id", "left")
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("analysis_id").orderBy("place", "pos")))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("Unspecified requirements"))).withColumn("kind", kind_of(F.col("text")))
    role = F.col("place").isNull() | (F.col("place") == 2)
    own = F.when(role, "ROLE_AND_RESPONSIBILITY_ALIGNMENT").when(F.col("kind") == "DOMAIN", "DOMAIN_AND_OPERATING_ENVIRONMENT").otherwise("CORE_TECHNICAL_STACK")
    return rows.select(
        "analysis_id", "resume_id", "ordinal", F.concat(F.lit("req-"), "ordinal").alias("id"), "text", "kind",
        F.when(F.col("place") == 1, "PREFERRED").otherwise("REQUIRED").alias("importance"),
        F.when((F.col("place") == 0) & (F.col("pos") <= CORE), "CORE").otherwise("SUPPORTING").alias("criticality"),
        F.lit(None).cast("string").alias("alternative_group_id"), own.alias("primary_category"), F.col("place").isNull().alias("stand_in"),
    )


def in_one(sentences: Column) -> Column:
    """Sentences in lower case, joined; a term holds no control character, so its first place tells the first sentence that has it."""
    return F.array_join(F.transform(sentences, lambda s: F.replace(F.lower(s), F.lit(BREAK), F.lit(" "))), BREAK)


def first_with(terms: Column, sentences: Column, joined: Column) -> Column:
    """The first of ``sentences`` (``joined`` by ``in_one``) with any of ``terms``; null if there is none."""
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(joined, t)), lambda p: p > 0))
    before = F.length(F.regexp_replace(F.substr(joined, F.lit(1), first - 1), f"[^{BREAK}]+", ""))
    return F.when(first.isNotNull(), F.get(sentences, before))


def match_evidence(requirement: DataFrame, resumes: DataFrame, unsure: Column) -> DataFrame:
    """``requirement`` with status, relation, strength, quote and rationale: the first sentence of the resume (resume_id, text)
    with any distinctive term of the requirement. Sentences are lower-cased and joined once per resume, and stay in its row; each term is
    looked up once."""
    known = resumes.select("resume_id", T.sentences(F.col("text")).alias("sentences"))
    known = known.withColumn("joined", in_one(F.col("sentences")))
    rows = requirement.withColumn("terms", T.distinctive_terms(F.col("text"))).join(known, "resume_id", "left")
    rows = rows.withColumn("quote", first_with(F.col("terms"), F.col("sentences"), F.col("joined"))).drop("sentences", "joined", "terms")
    there = F.col("quote").isNotNull()
    return (
        rows.withColumn("status", F.when(there, "STRONG_MATCH").otherwise("UNKNOWN"))
        .withColumn("relation", F.when(there, "DIRECT").otherwise("NONE"))
        .withColumn("strength", F.when(there, "MODERATE").otherwise("NONE"))
        .withColumn("rationale", F.when(there, MATCHED).when(unsure | F.col("stand_in"), UNSURE).otherwise(UNFOUND))
    )


def scale(n: Column, low: int, middle: int, high: int) -> Column:
    return F.when(n >= high, 4).when(n >= middle, 3).when(n >= low, 2).when(n > 0, 1).otherwise(0)


def subfactors(facts: DataFrame) -> DataFrame:
    """analysis_id, category, subfactor, value from facts of a resume: analysis_id, roles, bullets, has_numbers and has_projects."""
    depth = scale(F.col("bullets"), 3, 6, 10)
    outcomes = F.when(F.col("has_numbers"), 3).otherwise(1)
    values = [
        depth, outcomes, F.when(F.col("has_projects"), F.least(depth + 1, F.lit(4))).otherwise(depth), F.lit(2), scale(F.col("roles"), 1, 2, 3),
        F.lit(2), depth, scale(F.col("bullets"), 2, 5, 9), scale(F.col("roles"), 1, 2, 4), outcomes, F.lit(1),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("subfactor"), v.cast("int").alias("value")) for (c, s, _), v in zip(rubric.SUBFACTORS, values)])
    return facts.select("analysis_id", F.explode(rows).alias("s")).select("analysis_id", "s.*")


def opportunity(posting: DataFrame) -> DataFrame:
    """What the posting says of pay; growth and outlook are never claimed. No score uses it."""
    pay = F.coalesce(T.strip(F.col("compensation")), F.lit("")) != ""
    return posting.select("doc_id", F.when(pay, "MODERATE").otherwise("UNKNOWN").alias("pay_rating"), F.when(pay, "STATED_IN_POSTING").otherwise("NOT_AVAILABLE").alias("pay_basis"), F.lit("UNKNOWN").alias("outlook_rating"), F.lit("NOT_AVAILABLE").alias("outlook_basis"))


def guidance(judged: DataFrame) -> DataFrame:
    """analysis_id, hints (the first three required items that aren't responsibilities), to_explain (the first three unknown core ones)."""
    first = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.struct("ordinal", "text")))), 1, 3)["text"]
    hint = (F.col("importance") == "REQUIRED") & (F.col("primary_category") != "ROLE_AND_RESPONSIBILITY_ALIGNMENT")
    core = (F.col("importance") == "REQUIRED") & (F.col("criticality") == "CORE") & (F.col("status") == "UNKNOWN")
    return judged.groupBy("analysis_id").agg(first(hint).alias("hints"), first(core).alias("to_explain"))


def prompts(pairs: DataFrame, template: str, rules: dict[str, dict[str, str]]) -> DataFrame:
    """``pairs`` with prompt: the template's ``{{name}}`` filled with columns, a fence of the row's own, and the texts that
    ``rules`` gives for a column's value; rows with a name left over are marked by ok. The template is filled in one pass, so braces inside a
    column's text stay what they are."""
    parts, ok = [], True
    for i, part in enumerate(re.split(r"\{\{(\w+)\}\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(part))
        elif part == "nonce":
            parts.append(F.substring(F.sha2(F.col("analysis_id").cast("string"), 256), 1, 16))
        elif part in rules:
            said = F.create_map(*[F.lit(x) for pair in rules[part].items() for x in pair])
            parts.append(F.coalesce(F.try_element_at(said, F.col(part)), F.lit("")))
        elif part in pairs.columns:
            parts.append(F.coalesce(F.col(part).cast("string"), F.lit("")))
        else:
            parts.append(F.lit(f"{{{{{part}}}}}"))
            ok = False
    return pairs.withColumn("prompt", F.concat(*parts)).withColumn("ok", F.lit(ok and "{{" not in re.sub(r"\{\{\w+\}\}", "", template)))


def judge(prompt: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a provider says: a function from the prompt table to (analysis_id, raw_json), such as a mapInPandas of a client."""
    return provider(prompt).select("analysis_id", "raw_json")
