"""Judgements asked of a provider: prompts that carry their data, a provider that reads them, and answers kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import text as T
from fitloom.operators import documents, matching, validation
from fitloom.plans.parts import Parts
from fitloom.plans.scratch import Scratch
from fitloom.plans.steps import worked_out

Provider = Callable[[DataFrame], DataFrame]

#: The data stands between fences of the row's own: nothing foreign stands before the first opening one or behind the last closing one.
TEMPLATE = "Fence {{nonce}}. Judge each requirement by the resume alone. {{absence}} {{source}}\n<data {{nonce}}>\n{{data}}\n</data {{nonce}}>"
DATA = "unsure boolean, resume string, requirements array<struct<ordinal int, id string, text string, kind string, importance string, criticality string, primary_category string, stand_in boolean>>"
#: What is kept of an answer.
ANSWER = f"fingerprint string, raw_json string, draft {validation.ddl(validation.DRAFT)}, reason string"


def data_of(requirement: DataFrame, resumes: DataFrame, unsure: Column) -> DataFrame:
    """analysis_id and data, the JSON a prompt carries: whether absence is unsure, the requirements (of ``requirement_table``) in order and
    the whole text of the resume (resume_id, text; null if it is missing). Requirements of an analysis number 60 at most, by that table."""
    names = ["ordinal", "id", "text", "kind", "importance", "criticality", "primary_category", "stand_in"]
    rows = requirement.groupBy("analysis_id", "resume_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("requirements"))
    rows = rows.join(resumes.select("resume_id", F.col("text").alias("resume")), "resume_id", "left")
    return rows.select("analysis_id", F.to_json(F.struct(unsure.alias("unsure"), "resume", "requirements")).alias("data"))


def by_wording(prompt: DataFrame) -> DataFrame:
    """The default provider: it reads each prompt's data and answers with what the wording shows, as raw JSON of the contract. It sees
    analysis_id and prompt and nothing else; a prompt it can't read gets a null answer. No shuffle: a prompt is answered in its row."""
    rows = worked_out(prompt.select("analysis_id", "prompt"), __nonce=F.regexp_extract("prompt", r"^Fence ([0-9a-f]{16})\.", 1))
    opening, closing = F.concat(F.lit("<data "), "__nonce", F.lit(">\n")), F.concat(F.lit("\n</data "), "__nonce", F.lit(">"))
    start = F.instr("prompt", opening) + F.length(opening)
    behind = F.length(F.call_function("substring_index", F.col("prompt"), closing, F.lit(-1)))
    length = F.length("prompt") - behind - F.length(closing) - start + 1
    rows = worked_out(rows, __d=F.from_json(F.substr("prompt", start, length), DATA))
    rows = worked_out(rows, __sentences=T.sentences(F.col("__d.resume")))
    rows = worked_out(rows, __joined=matching.in_one(F.col("__sentences")))
    d = F.col("__d")

    def judged(r: Column) -> Column:
        quote = matching.first_with(T.distinctive_terms(r["text"]), F.col("__sentences"), F.col("__joined"))
        return F.struct(r.alias("r"), quote.alias("quote"))

    def row(j: Column) -> Column:
        r, there = j["r"], j["quote"].isNotNull()
        status, relation = F.when(there, "STRONG_MATCH").otherwise("UNKNOWN"), F.when(there, "DIRECT").otherwise("NONE")
        strength = F.when(there, "MODERATE").otherwise("NONE")
        why = F.when(there, matching.MATCHED).when(d["unsure"] | r["stand_in"], matching.UNSURE).otherwise(matching.UNFOUND)
        proof = F.struct(
            r["id"].alias("requirementId"), r["importance"].alias("importance"), status.alias("status"), relation.alias("relation"), strength.alias("strength"),
            j["quote"].alias("resumeQuote"), F.lit("RESUME").alias("sourceLocator"), why.alias("rationale"), F.lit(False).alias("grounded"),
        )
        return F.struct(
            r["id"].alias("id"), r["text"].alias("requirementText"), r["kind"].alias("kind"), r["importance"].alias("importance"), r["criticality"].alias("criticality"),
            r["primary_category"].alias("primaryCategory"), status.alias("status"), relation.alias("relation"), strength.alias("evidenceStrength"),
            F.filter(F.array(proof), lambda q: q["resumeQuote"].isNotNull()).alias("evidence"), why.alias("rationale"),
        )

    rows = worked_out(rows, __judged=F.transform(d["requirements"], judged))
    unknown = F.struct(F.lit("UNKNOWN").alias("rating"), F.lit("NOT_AVAILABLE").alias("basis"))
    draft = F.struct(
        F.lit(validation.VERSION).alias("schemaVersion"), F.transform("__judged", row).alias("requirementAssessments"),
        F.array().cast("array<struct<category:string,value:int>>").alias("subfactorJudgements"), F.struct(unknown.alias("companyOutlook")).alias("opportunityValue"),
        F.array().cast("array<string>").alias("limitations"),
    )
    return rows.select("analysis_id", F.when(F.col("__judged").isNotNull(), F.to_json(draft)).alias("raw_json"))


def answered(prompt: DataFrame, provider: Provider, store: Parts, name: str, batches: int = 8, tries: int = 3) -> DataFrame:
    """analysis_id, draft and reason for each row of ``prompt`` (analysis_id, prompt), asking ``provider`` only for what ``store`` (rows of
    ANSWER) lacks. Answers are kept under the fingerprint of the prompt, the contract's version and ``name``, which says who answers.

    A distinct prompt is asked once, under its fingerprint as analysis_id, whichever and however many analyses it stands for. Prompts go in
    ``batches`` parts; each is validated and written before the next is asked, so if the provider raises, what came before is kept and the
    next run goes on from there. A refused or missing answer is kept with its reason (missing: empty-response) and asked for again by
    later runs, ``tries`` times in all. Of several answers to one prompt the smallest text counts. A null prompt is a prompt like any; no
    prompts, no rows.
    """
    spark = prompt.sparkSession
    scratch = Scratch(spark, "judging")
    mark = documents.fingerprint(F.col("prompt"), F.struct(F.lit(validation.VERSION).alias("version"), F.lit(name).alias("name")))
    keyed = prompt.select("analysis_id", "prompt").withColumn("fingerprint", mark)
    batch = F.pmod(F.xxhash64("fingerprint"), F.lit(batches)).cast("int")
    try:
        keyed = scratch.keep(keyed.withColumn("batch", batch), "prompts", "batch")
        for number in range(batches):
            known = store.read().groupBy("fingerprint").agg(F.bool_or(F.col("reason").isNull()).alias("good"), F.count(F.lit(1)).alias("n"))
            asked = keyed.filter(F.col("batch") == number).join(known.filter(F.col("good") | (F.col("n") >= tries)), "fingerprint", "left_anti")
            if asked.isEmpty():
                continue
            asked = asked.dropDuplicates(["fingerprint"])
            said = matching.judge(asked.select(F.col("fingerprint").alias("analysis_id"), "prompt"), provider)
            said = said.groupBy(F.col("analysis_id").alias("fingerprint")).agg(F.min("raw_json").alias("raw_json"))
            store.add(validation.validate(asked.select("fingerprint").join(said, "fingerprint", "left")))
        keyed = scratch.only(keyed.select("analysis_id", "fingerprint"), "keys")
    except BaseException:
        scratch.drop("prompts")
        raise
    kept = store.read()
    last = kept.groupBy("fingerprint").agg(F.max("part").alias("part"))
    kept = kept.join(last, ["fingerprint", "part"], "left_semi").select("fingerprint", "draft", "reason")
    return keyed.join(kept, "fingerprint").select("analysis_id", "draft", "reason")
