"""Structure of job postings: headings, sections, items, lists, header fields and warnings, over a table of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import text as T

# Headings by kind.
HEADINGS = {
    "RESPONSIBILITIES": ["responsibilities", "key responsibilities", "what you'll do", "what you will do", "what you'll be doing", "the role", "your impact", "duties", "day to day", "in this role", "role responsibilities"],
    "REQUIRED": [
        "required qualifications", "minimum qualifications", "basic qualifications", "requirements", "required skills", "required experience", "must have", "must-haves",
        "what you'll need", "what you need", "what we're looking for", "qualifications required", "skills required", "experience required",
    ],
    "PREFERRED": [
        "preferred qualifications", "preferred", "nice to have", "nice-to-haves", "nice to haves", "bonus points", "bonus", "desired qualifications", "assets",
        "it's a plus", "pluses", "good to have", "qualifications preferred", "preferred skills", "preferred experience",
    ],
    "AMBIGUOUS_QUALIFICATIONS": [
        "qualifications", "skills", "skills and experience", "experience", "what you bring", "who you are", "about you", "you have", "qualifications and fit", "requirements and qualifications",
        "technical skills", "what you bring to the table", "your experience", "your background", "who you'll be", "who you will be", "experience and skills",
    ],
    "ABOUT": [
        "about us", "about the company", "about the role", "about the team", "who we are", "overview", "the opportunity", "company overview", "why join", "why join us", "what we offer",
        "what you'll work on", "what you will work on", "benefits", "perks", "perks and benefits", "how to apply",
    ],
    "COMPENSATION": ["compensation", "salary", "pay range", "salary range", "compensation and benefits"],
}
# Labels that stand alone on a line.
BARE_LABELS = ["job description", "description", "job title", "title", "position", "role", "overview", "job details", "about the job", "about this role", "summary", "job summary", "job post"]
# Words that name a role.
ROLE_WORDS = [
    "engineer", "developer", "designer", "manager", "analyst", "architect", "scientist", "consultant", "specialist", "administrator", "technician", "intern", "junior", "senior",
    "intermediate", "staff", "principal", "lead", "full stack", "full-stack", "frontend", "front-end", "backend", "back-end", "devops", "programmer",
]
# What marks an item as optional.
OPTIONAL_MARKERS = ["(preferred)", "(nice to have)", "(a plus)", "(bonus)", "(optional)", "nice to have", "is a plus", "are a plus", "bonus points", "would be an asset", "is an asset", "preferred but not required"]
# The forms of a label with its field, of what parts fields, of employment types and of pay.
LABELLED = r"^([A-Za-z][A-Za-z /]{1,24}?)\s*:\s*(.*)$"
SEPARATOR = r"\s*(?:—|–|\||·|\s{3,}|,\s+(?=[A-Z][a-z]+,\s*[A-Z]{2}\b))\s*"
EMPLOYMENT = r"(?i)\b(full[\s-]?time|part[\s-]?time|contract|internship|intern|temporary|permanent|freelance)\b"
PAY = (
    r"(?:[$€£]|\b(?:CAD|USD|EUR|GBP)\s*)\s?[\d][\d,.]*(?:\s*[kK])?(?:\s*(?:-|–|—|to)\s*(?:[$€£]|\b(?:CAD|USD|EUR|GBP)\s*)?[\d][\d,.]*(?:\s*[kK])?)?"
    r"(?:\s*(?:per|/|a)\s*(?:year|annum|hour|hr|month))?"
)
BULLET = r"^-\s+"
MAX_HEADING, HEADER_LINES, MAX_FIELD = 60, 8, 120
# Fields by their labels.
LABELS = {
    "title": ["job title", "title", "position", "role"],
    "company": ["company", "employer", "organisation", "organization"],
    "location": ["location"],
    "employment_type": ["employment type", "job type"],
    "late_title": ["job description", "description"],
}


def any_in(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def heading_kind(line: Column, following: Column) -> Column:
    """Kind of the section that a line opens; null if it opens none."""
    stripped = T.strip(line)
    candidate = F.replace(F.lower(F.regexp_replace(stripped, r"[:\s]+$", "")), F.lit(" & "), F.lit(" and "))
    known = F.create_map(*[F.lit(x) for kind, names in HEADINGS.items() for n in dict.fromkeys(names) for x in (n, kind)])
    introduces = F.coalesce(T.strip(following).rlike(BULLET), F.lit(False))
    label = ~stripped.endswith(".") & ~stripped.endswith(",") & (F.size(F.split(stripped, r"\s+")) <= 6)
    kind = F.coalesce(F.try_element_at(known, candidate), F.when(candidate.rlike(r"^about\s+\S+(\s+\S+)?$"), "ABOUT"), F.when(introduces & label, "OTHER"))
    return F.when((stripped != "") & (F.length(stripped) <= MAX_HEADING) & ~stripped.rlike(BULLET), kind)


def sections(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, line_no, text) without headings and blanks, with the section's kind, heading and number."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("opens", heading_kind(F.col("text"), F.lead("text").over(order)))
    rows = rows.withColumn("section", F.coalesce(F.last("opens", True).over(so_far), F.lit("HEADER")))
    title = F.when(F.col("opens").isNotNull(), F.regexp_replace(T.strip(F.col("text")), r"[:\s]+$", ""))
    rows = rows.withColumn("heading", F.last(title, True).over(so_far)).withColumn("block_no", F.count("opens").over(so_far))
    return rows.filter(F.col("opens").isNull() & (T.strip(F.col("text")) != "")).drop("opens")


def items(sectioned: DataFrame) -> DataFrame:
    """doc_id, block_no, section, heading, item_no, text: lines joined with those that continue them; lines that give
    instructions to an automated reader, and what continues those, are left out."""
    # Blocks, islands and items follow each other in the document, so all windows have its one order: lines are sorted once.
    order = W.partitionBy("doc_id").orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("block_no") != F.lag("block_no").over(order), F.lit(True))
    stripped = T.strip(F.col("text"))
    rows = sectioned.withColumn("bullet", stripped.rlike(BULLET)).withColumn("body", T.strip(F.regexp_replace(stripped, BULLET, "")))
    rows = rows.withColumn("imperative", T.is_imperative(stripped)).withColumn("continues", ~F.col("bullet") & F.col("body").rlike(r"^\p{Ll}")).withColumn("fresh", fresh)
    # An island is a line that starts something, kept or dropped, and the lines that continue it.
    island = F.when(~F.col("continues") | F.col("imperative") | F.col("fresh"), F.col("imperative"))
    rows = rows.withColumn("gone", F.last(island, True).over(so_far)).filter("not gone").withColumn("fresh", fresh)
    # Lines that go on after a dropped one belong to it; one that continues nothing starts an item.
    rows = rows.withColumn("so_far", F.sum((~F.col("continues") | F.col("fresh")).cast("int")).over(so_far))
    rows = rows.withColumn("item_no", F.col("so_far") - F.last(F.when(F.col("fresh"), F.col("so_far") - 1), True).over(so_far))
    joined = rows.groupBy("doc_id", "block_no", "section", "heading", "item_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("ls"))
    return joined.withColumn("text", F.array_join("ls.body", " ")).withColumn("line_no", F.col("ls")[0]["line_no"]).drop("ls")


def lists(item: DataFrame) -> DataFrame:
    """doc_id, list, pos, heading, text: items by list, in document order; header and pay have no list."""
    optional = any_in(F.lower("text"), OPTIONAL_MARKERS)
    section = F.col("section")
    name = (
        F.when(section == "RESPONSIBILITIES", "RESPONSIBILITY").when(section == "REQUIRED", "REQUIRED").when(section == "PREFERRED", "PREFERRED")
        .when(section == "AMBIGUOUS_QUALIFICATIONS", F.when(optional, "PREFERRED").otherwise("REQUIRED")).when(section.isin("ABOUT", "OTHER"), "OTHER")
    )
    rows = item.withColumn("list", name).filter("list is not null")
    return rows.select("doc_id", "list", F.row_number().over(W.partitionBy("doc_id", "list").orderBy("line_no")).alias("pos"), "heading", "text")


def looks_like_role(c: Column) -> Column:
    return any_in(F.lower(c), ROLE_WORDS)


def looks_like_location(c: Column) -> Column:
    return any_in(F.lower(c), ["remote", "hybrid", "on-site", "onsite"]) | c.rlike(r",\s*[A-Z]{2}\b")


def header_fields(sectioned: DataFrame) -> DataFrame:
    """doc_id, title, company, location, employment_type, compensation, by label first and by position last."""
    first = W.partitionBy("doc_id").orderBy("line_no")
    rows = sectioned.withColumn("pay", F.nullif(T.strip(F.regexp_extract("text", PAY, 0)), F.lit("")))
    pay = rows.filter("section = 'COMPENSATION' and pay is not null").groupBy("doc_id").agg(F.min_by("pay", "line_no").alias("block_pay"))
    head = rows.filter("section = 'HEADER' and block_no = 0").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= HEADER_LINES)
    line = T.strip(F.col("text"))
    label, value = F.lower(T.strip(F.regexp_extract(line, LABELLED, 1))), T.strip(F.regexp_extract(line, LABELLED, 2))
    head = head.withColumn("label", F.when((value != "") & (F.length(value) <= MAX_FIELD), label)).withColumn("value", value)
    plain = F.regexp_replace(line, r"[:\s]+$", "")
    head = head.withColumn("candidate", F.when((plain != "") & ~F.lower(plain).isin(BARE_LABELS), plain))
    by_label = [F.min(F.when(F.col("label") == n, F.struct("k", "value")))["value"].alias(f"l_{n}") for names in LABELS.values() for n in names]
    found = head.groupBy("doc_id").agg(
        *by_label,
        F.min(F.when(F.col("candidate").isNotNull(), F.struct("k", "candidate")))["candidate"].alias("candidate"),
        F.max(F.when(F.col("k") == 2, line)).alias("second"),
        F.array_sort(F.collect_list(F.struct("k", "text"))).alias("ls"),
    )
    of = lambda key: F.coalesce(*[F.col(f"`l_{n}`") for n in LABELS[key]])
    sentence = T.strip(F.split("candidate", r"(?<=[.!?])\s+", 2)[0])
    by_place = F.when(F.length("candidate") <= MAX_FIELD, F.col("candidate")).when(F.length(sentence) <= MAX_FIELD, sentence)
    parts = F.filter(F.transform(F.split("second", SEPARATOR), T.strip), lambda p: p != "")
    a, b = F.get(parts, 0), F.get(parts, 1)
    usable = F.length("second") <= MAX_FIELD
    not_role = lambda c: F.when(~looks_like_role(c), c)
    company = F.when(usable, F.when(looks_like_location(a), None).when(F.size(parts) == 1, not_role(a)).when(looks_like_location(b), not_role(a)))
    location = F.when(usable, F.when(looks_like_location(a), a).when((F.size(parts) > 1) & looks_like_location(b), b))
    block = F.array_join("ls.text", "\n")
    labelled = of("company").isNull() & of("location").isNull()
    found = found.select(
        "doc_id",
        F.coalesce(of("title"), of("late_title"), by_place).alias("title"),
        F.coalesce(of("company"), F.when(labelled, company)).alias("company"),
        F.coalesce(of("location"), F.when(labelled, location)).alias("location"),
        F.coalesce(of("employment_type"), F.nullif(T.strip(F.regexp_extract(block, EMPLOYMENT, 0)), F.lit(""))).alias("employment_type"),
        F.nullif(T.strip(F.regexp_extract(block, PAY, 0)), F.lit("")).alias("head_pay"),
    )
    return found.join(pay, "doc_id", "full").select("doc_id", "title", "company", "location", "employment_type", F.coalesce("head_pay", "block_pay").alias("compensation"))


def warnings(docs: DataFrame, lines: DataFrame, listed: DataFrame, recovered: Column | None = None) -> DataFrame:
    """doc_id, seq, code of every document in ``docs`` (doc_id, text)."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    kinds = lines.withColumn("opens", heading_kind(F.col("text"), F.lead("text").over(order))).groupBy("doc_id").agg(
        F.bool_or(F.col("opens").isNotNull()).alias("any"), F.bool_or(F.col("opens") == "AMBIGUOUS_QUALIFICATIONS").alias("ambiguous"), F.bool_or(F.col("opens") == "PREFERRED").alias("explicit")
    )
    counts = listed.groupBy("doc_id").agg(F.bool_or(F.col("list").isin("REQUIRED", "PREFERRED")).alias("qualified"), F.bool_or(F.col("list") == "RESPONSIBILITY").alias("responsible"))
    rows = docs.withColumn("recovered", F.lit(False) if recovered is None else recovered).join(kinds, "doc_id", "left").join(counts, "doc_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    codes = [
        (F.col("recovered"), "STRUCTURE_RECOVERED_FROM_CONTINUOUS_TEXT"),
        (no("any"), "NO_POSTING_SECTIONS_DETECTED"),
        (no("qualified"), "NO_QUALIFICATION_SECTIONS_DETECTED"),
        (no("responsible"), "NO_RESPONSIBILITIES_DETECTED"),
        (~no("ambiguous") & no("explicit"), "REQUIRED_AND_PREFERRED_NOT_SEPARATED"),
        (T.speaks_to_a_reader(F.col("text")), "POSSIBLE_EMBEDDED_INSTRUCTIONS"),
    ]
    found = F.array_compact(F.array(*[F.when(c, code) for c, code in codes]))
    return rows.select("doc_id", F.posexplode(found).alias("seq", "code"))


def merge_metadata(posting: DataFrame, meta: DataFrame) -> DataFrame:
    """A page's own metadata, where not blank, before what was parsed."""
    fields = ["title", "company", "location", "employment_type", "compensation"]
    m = meta.select("doc_id", *[F.nullif(T.strip(F.col(f)), F.lit("")).alias(f"m_{f}") for f in fields])
    return posting.join(m, "doc_id", "left").select("doc_id", *[F.coalesce(f"m_{f}", f).alias(f) for f in fields])
