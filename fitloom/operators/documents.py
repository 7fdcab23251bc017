"""Lines, gates, warnings and fingerprints of documents and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import text as T

# Code, severity, what a reader is told ({0}: the name of the service).
WARNINGS = [
    ("LOW_TEXT_DENSITY", "WARNING", "Some pages contained very little text. Check that nothing important is missing."),
    ("POSSIBLE_MULTI_COLUMN", "HIGH", "This layout looks like it uses columns, so lines may have been read in the wrong order. Check the order of the text below carefully."),
    ("REPEATED_HEADER_FOOTER", "INFO", "The same header or footer appears on several pages and may be repeated in the text below."),
    ("BROKEN_WORDS", "WARNING", "Some words appear to be split apart. This usually comes from the PDF's letter spacing."),
    ("TEXT_TRUNCATED", "HIGH", "This document was longer than {0} processes, so the text below is incomplete."),
    ("ENCRYPTED_BUT_READABLE", "INFO", "This PDF has usage restrictions, but its text could still be read."),
    ("NO_SECTIONS_DETECTED", "HIGH", "No standard resume sections were recognised, so the structured view below may be incomplete. The full text was still extracted."),
    ("NO_ROLES_DETECTED", "HIGH", "No work experience entries could be identified. Add them in the review step, otherwise this analysis cannot judge your experience."),
    ("UNASSIGNED_TEXT_BLOCKS", "WARNING", "Some text could not be attached to a section. It is still in the full text below, but it is missing from the structured view."),
    ("NO_POSTING_SECTIONS_DETECTED", "HIGH", "No standard job posting sections were recognised, so the structured view below may be incomplete. The full text was still extracted."),
    ("STRUCTURE_RECOVERED_FROM_CONTINUOUS_TEXT", "HIGH", "This posting arrived as one continuous block of text with no line breaks, so {0} worked out where the sections and list items begin. No wording was changed, but check the split below before continuing."),
    ("NO_QUALIFICATION_SECTIONS_DETECTED", "HIGH", "No requirements or qualifications section was recognised in this posting. Check the full text and add what the role actually requires."),
    ("NO_RESPONSIBILITIES_DETECTED", "WARNING", "No responsibilities section was recognised, so the analysis has less to compare your day-to-day experience against."),
    ("REQUIRED_AND_PREFERRED_NOT_SEPARATED", "WARNING", "This posting does not clearly separate required from preferred qualifications. Anything not marked as optional was treated as required, which is the stricter reading, and the full text is used as well when judging requirements."),
    ("LOW_CONFIDENCE_STRUCTURE", "WARNING", "Some entries are missing a title, an employer or a reliable date range. Check them before running the analysis."),
    ("POSSIBLE_EMBEDDED_INSTRUCTIONS", "HIGH", "This document contains text that looks like instructions to an AI system. {0} treats document content as evidence only and ignores such instructions."),
]
SERVICE, NOT_CONFIRMED = "this service", "Both the resume and the job description must be reviewed and confirmed first."
# Codes that make a resume's or a posting's structure uncertain, and those that confirmation recomputes.
RESUME_UNCERTAIN = ["NO_SECTIONS_DETECTED", "NO_ROLES_DETECTED", "UNASSIGNED_TEXT_BLOCKS", "LOW_CONFIDENCE_STRUCTURE", "TEXT_TRUNCATED", "POSSIBLE_MULTI_COLUMN", "BROKEN_WORDS", "LOW_TEXT_DENSITY"]
POSTING_UNCERTAIN = ["NO_QUALIFICATION_SECTIONS_DETECTED", "REQUIRED_AND_PREFERRED_NOT_SEPARATED", "NO_SECTIONS_DETECTED", "TEXT_TRUNCATED"]
STRUCTURAL = ["NO_SECTIONS_DETECTED", "NO_ROLES_DETECTED", "UNASSIGNED_TEXT_BLOCKS", "LOW_CONFIDENCE_STRUCTURE"]
LIMITS = {"RESUME": (400, 500_000), "POSTING": (200, 40_000)}
MAX_CHARS, MAX_PAGES, PAGE_CHARS, USABLE_CHARS = 500_000, 15, 60, 400


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.lines(F.translate(F.col(text), "\u00a0", " "))).alias("line_no", "text"))


def length_gate(docs: DataFrame, kind: Column) -> DataFrame:
    """reason: null for a text within its kind's limits; blank counts as absent."""
    n = F.length(T.strip(F.coalesce("text", F.lit(""))))
    reason = F.lit(None).cast("string")
    for name, (low, high) in LIMITS.items():
        reason = F.when(kind == name, F.when(n < low, f"{name}_TEXT_TOO_SHORT").when(n > high, f"{name}_TEXT_TOO_LONG")).otherwise(reason)
    return docs.withColumn("n", n).withColumn("reason", reason)


def source_gate(requests: DataFrame) -> DataFrame:
    """Exactly one of url and text; a blank one is absent."""
    there = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")) != ""
    return requests.withColumn("ok", there("url") != there("text"))


def admit_files(files: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """``files`` (path, content) with reason: missing, too large or not a PDF, the first that holds."""
    size = F.coalesce(F.length("content"), F.lit(0))
    reason = F.when(size == 0, "FILE_MISSING").when(size > max_bytes, "FILE_TOO_LARGE").when(F.hex(F.substring("content", 1, 5)) != "255044462D", "FILE_TYPE_NOT_SUPPORTED")
    return files.withColumn("reason", reason)


def page_budget(pages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, n_chars, truncated, n_pages: the text kept when pages are read in order up to a number of characters."""
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = pages.withColumn("before", before).withColumn("kept", F.substring("text", F.lit(1), F.greatest(F.lit(max_chars) - F.col("before"), F.lit(0)).cast("int")))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("before") < max_chars, F.struct("page_no", "kept")))).alias("parts"), (F.sum(F.length("text")) > max_chars).alias("truncated"))
    return rows.select("doc_id", F.array_join("parts.kept", "").alias("text"), "truncated", F.size("parts").alias("n_pages"))


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Per document: too many pages, no usable text and why, repeated first or last lines, pages of images without text."""
    size = F.length(T.strip(F.col("text")))
    filled = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: x != "")
    rows = pages.select("doc_id", "page_no", "has_images", size.alias("size"), F.get(filled, 0).alias("first"), F.try_element_at(filled, F.lit(-1)).alias("last"))
    edges = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("first").alias("edge"), F.col("first").alias("line")), F.struct(F.lit("last").alias("edge"), F.col("last").alias("line")))).alias("e"))
    repeated = edges.filter("e.line is not null").groupBy("doc_id", "e.edge", "e.line").agg(F.count("*").alias("n")).groupBy("doc_id").agg((F.max("n") >= 3).alias("repeated"))
    scanned = F.col("has_images") & (F.col("size") < PAGE_CHARS)
    rows = rows.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("size").alias("total"), F.bool_or(scanned).alias("scanned"), F.count_if(scanned).alias("low_density"))
    rows = rows.join(repeated, "doc_id", "left")
    reason = F.when(F.col("total") < USABLE_CHARS, F.when(F.col("scanned"), "PDF_IMAGE_ONLY").otherwise("RESUME_TEXT_TOO_SHORT"))
    return rows.select("doc_id", "n_pages", (F.col("n_pages") > MAX_PAGES).alias("too_many"), reason.alias("reason"), ((F.col("n_pages") >= 3) & F.coalesce("repeated", F.lit(False))).alias("repeated_edge"), "low_density")


def broken_words(docs: DataFrame) -> DataFrame:
    """Whether single letters other than a and i are over 15 % of at least 50 tokens."""
    t = T.tokens(F.col("text"))
    singles = F.size(F.filter("tokens", lambda x: x.rlike(r"^\p{L}$") & ~x.isin("a", "i")))
    rows = docs.select("doc_id", t.alias("tokens"))
    return rows.select("doc_id", ((F.size("tokens") >= 50) & (100 * singles > 15 * F.size("tokens"))).alias("broken_words"))


def reading_order(pairs: DataFrame) -> DataFrame:
    """Whether two readings (text_a, text_b) agree at fewer than nine tokens of ten: the layout may have columns."""
    rows = pairs.select("doc_id", T.tokens(F.col("text_a")).alias("a"), T.tokens(F.col("text_b")).alias("b"))
    same = F.size(F.filter(F.arrays_zip("a", "b"), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False))))
    unlike = 10 * same < 9 * F.greatest(F.size("a"), F.size("b"))
    return rows.select("doc_id", ((F.size("a") >= 20) & (F.size("b") > 0) & unlike).alias("multi_column"))


def fingerprint(text: Column, structure: Column) -> Column:
    return F.sha2(F.to_json(F.struct(text.alias("rawText"), structure.alias("structure")), {"ignoreNullFields": "false"}), 256)


def drifted(submitted: DataFrame, confirmed: DataFrame) -> DataFrame:
    """doc_id and ok: whether the submitted fingerprint is the confirmed one."""
    return submitted.select("doc_id", "fingerprint").join(confirmed.select("doc_id", F.col("fingerprint").alias("was")), "doc_id", "left").select("doc_id", F.col("fingerprint").eqNullSafe(F.col("was")).alias("ok"))


def policies(docs: DataFrame, warnings: DataFrame) -> DataFrame:
    """``docs`` (doc_id, confirmed) with what absent evidence means and where requirements come from."""
    codes = warnings.groupBy("doc_id").agg(F.bool_or(F.col("code").isin(RESUME_UNCERTAIN)).alias("r"), F.bool_or(F.col("code").isin(POSTING_UNCERTAIN)).alias("p"))
    rows = docs.join(codes, "doc_id", "left")
    unsure = lambda c: ~F.coalesce("confirmed", F.lit(False)) | F.coalesce(c, F.lit(False))
    return rows.select("doc_id", F.when(unsure("r"), "MUST_BE_UNKNOWN").otherwise("MAY_BE_GAP").alias("absence"), F.when(unsure("p"), "FULL_TEXT_FALLBACK").otherwise("STRUCTURED_SECTIONS").alias("source"))


def review_gate(pairs: DataFrame) -> DataFrame:
    """``pairs`` (resume_status, posting_status) with reason and message: REVIEW_NOT_CONFIRMED unless both are CONFIRMED."""
    ok = F.coalesce((F.col("resume_status") == "CONFIRMED") & (F.col("posting_status") == "CONFIRMED"), F.lit(False))
    return pairs.withColumns({"reason": F.when(~ok, "REVIEW_NOT_CONFIRMED"), "message": F.when(~ok, NOT_CONFIRMED)})


def refresh_warnings(carried: DataFrame, structural: DataFrame, service: str = SERVICE) -> DataFrame:
    """What was carried and isn't structural, and the structural warnings computed anew; the first of each code, with severity and message."""
    rows = carried.filter(~F.col("code").isin(STRUCTURAL)).select("doc_id", "seq", "code").unionByName(structural.select("doc_id", (F.col("seq") + 1000).alias("seq"), "code"))
    told = F.create_map(*[x for c, s, m in WARNINGS for x in (F.lit(c), F.struct(F.lit(s).alias("severity"), F.lit(m.format(service)).alias("message")))])
    first = F.row_number().over(W.partitionBy("doc_id", "code").orderBy("seq"))
    return rows.withColumn("k", first).filter("k = 1").withColumn("told", told[F.col("code")]).select("doc_id", "code", "told.severity", "told.message")
