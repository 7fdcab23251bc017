"""Structure of resumes: sections, skills, roles with dates, education, projects, certifications, over a table of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import text as T

# Section names by their headings.
SECTIONS = {
    "SUMMARY": ["summary", "professional summary", "profile", "objective", "about", "about me", "overview"],
    "SKILLS": ["skills", "technical skills", "technologies", "core competencies", "technical proficiencies", "tools", "tech stack"],
    "EXPERIENCE": ["experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history"],
    "EDUCATION": ["education", "academic background", "academics"],
    "PROJECTS": ["projects", "selected projects", "personal projects", "side projects", "notable projects"],
    "CERTIFICATIONS": ["certifications", "certificates", "licenses", "licences", "credentials"],
}
# Words that name a credential.
CREDENTIALS = ["bachelor", "master", "b.sc", "bsc", "b.a", "b.eng", "beng", "m.sc", "msc", "mba", "ph.d", "phd", "doctorate", "diploma", "certificate", "associate", "degree"]
# Months, and the forms of dates, of ranges of dates and of what parts fields.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ENDPOINT = r"(?:(?:[A-Za-z]{3,9}\.?\s+\d{4})|(?:\d{1,2}[/.-]\d{4})|(?:\d{4}))"
PRESENT = r"(?:present|current|now|ongoing)"
RANGE = rf"(?i)({ENDPOINT})\s*(?:-|–|—|to|until)\s*({PRESENT}|{ENDPOINT})"
SEPARATOR = r"\s*(?:—|–|\||·|\t|\s{3,})\s*"
MAX_HEADING, HEADER_ALLOWANCE, STRAY = 40, 3, 3


def sections(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, line_no, text) with their section, without headings and blanks; a section that comes again goes on."""
    known = F.create_map(*[F.lit(x) for kind, names in SECTIONS.items() for n in names for x in (n, kind)])
    candidate = F.lower(F.regexp_replace(T.strip(F.col("text")), r"[:\s]+$", ""))
    heading = F.when((candidate != "") & (F.length(candidate) <= MAX_HEADING) & ~candidate.endswith("."), F.try_element_at(known, candidate))
    rows = lines.withColumn("opens", heading)
    rows = rows.withColumn("section", F.coalesce(F.last("opens", True).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)), F.lit("NONE")))
    rows = rows.filter(F.col("opens").isNull() & (T.strip(F.col("text")) != "")).drop("opens")
    rows = rows.withColumn("bullet", T.is_resume_bullet(F.col("text"))).withColumn("body", T.without_resume_bullet(F.col("text")))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "section").orderBy("line_no")))


def of_section(sectioned: DataFrame, name: str) -> DataFrame:
    return sectioned.filter(F.col("section") == name)


def summary(sectioned: DataFrame) -> DataFrame:
    rows = of_section(sectioned, "SUMMARY").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("ls"))
    return rows.select("doc_id", T.strip(F.array_join("ls.body", " ")).alias("summary"))


def provenance(section: str, start: Column, end: Column, quote: Column) -> Column:
    """Where an entry stands: its section, its first and last line, and the words there, as they are."""
    return F.struct(F.lit(section).alias("section"), start.alias("line_start"), end.alias("line_end"), quote.alias("quote")).alias("provenance")


def _own_line(section: str) -> Column:
    return provenance(section, F.col("line_no"), F.col("line_no"), T.strip(F.col("text")))


def listed_skills(sectioned: DataFrame) -> DataFrame:
    """doc_id, seq, name, line_no, provenance: what stands between separators, the first of each name."""
    body = F.when(F.col("body").rlike("^[^:]*:."), F.regexp_replace("body", "^[^:]*:", "")).otherwise(F.col("body"))
    rows = of_section(sectioned, "SKILLS").select("doc_id", "line_no", "text", F.posexplode(F.split(body, "[,;|•·/]")).alias("p", "name"))
    rows = rows.withColumn("name", T.strip(F.col("name"))).filter(F.length("name").between(2, 40))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("doc_id", F.lower("name")).orderBy("line_no", "p"))).filter("k = 1")
    return rows.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "p")).alias("seq"), "name", "line_no", _own_line("SKILLS"))


def year_month(endpoint: Column) -> Column:
    e = T.strip(endpoint)
    worded, numeric = r"^([A-Za-z]{3,9})\.?\s+(\d{4})$", r"^(\d{1,2})[/.-](\d{4})$"
    month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    named = F.try_element_at(month, F.substring(F.lower(F.regexp_extract(e, worded, 1)), 1, 3))
    number = F.regexp_extract(e, numeric, 1).try_cast("int")
    return (
        F.when(e.rlike(worded), F.concat(F.regexp_extract(e, worded, 2), F.lit("-"), named))
        .when(e.rlike(numeric), F.when(number.between(1, 12), F.concat(F.regexp_extract(e, numeric, 2), F.lit("-"), F.lpad(number.cast("string"), 2, "0"))))
        .when(e.rlike(r"^\d{4}$"), F.concat(e, F.lit("-01")))
    )


def date_range(c: Column) -> Column:
    """raw, start, end, current, confidence of the first range in a text; null where there is none."""
    raw, a, b = (T.strip(F.regexp_extract(c, RANGE, i)) for i in (0, 1, 2))
    current = F.lower(b).rlike(f"^{PRESENT}$")
    precise = ~a.rlike(r"^\d{4}$") & (current | ~b.rlike(r"^\d{4}$"))
    sure = F.when(precise & year_month(a).isNotNull(), "HIGH").otherwise("LOW")
    return F.when(raw != "", F.struct(raw.alias("raw"), year_month(a).alias("start"), F.when(~current, year_month(b)).alias("end"), current.alias("current"), sure.alias("confidence")))


def without_date(c: Column) -> Column:
    raw = T.strip(F.regexp_extract(c, RANGE, 0))
    return T.strip(F.regexp_replace(F.when(raw != "", F.replace(c, raw, F.lit(" "))).otherwise(c), r"\s{2,}", "   "))


# Shares and figures.
NUMBERS = r"\d+\s*%|\d[\d,]{2,}"


def _chunks(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SEPARATOR), T.strip), lambda p: p != "")


def roles(sectioned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roles (doc_id, role_no, title, company, location, dates, line_start, line_end, quote), their bullets (doc_id, role_no,
    pos, bullet) and per document the number of lines in no role."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    rows = of_section(sectioned, "EXPERIENCE").withColumn("anchor", ~F.col("bullet") & F.col("text").rlike(RANGE))
    # A plain line right above an anchor is that role's context, not the previous role's bullet.
    rows = rows.withColumn("context", ~F.col("bullet") & ~F.col("anchor") & F.coalesce(F.lead("anchor").over(order), F.lit(False)))
    rows = rows.withColumn("above", F.when(F.lag("context").over(order), F.lag("body").over(order)))
    rows = rows.withColumn("role_no", F.sum(F.col("anchor").cast("int")).over(order))
    inside = (F.col("role_no") > 0) & ~F.col("context")
    last = F.max(F.when(inside, F.col("line_no"))).over(W.partitionBy("doc_id", "role_no"))
    head = rows.withColumn("line_end", last).filter("anchor")
    parts = _chunks(without_date(F.col("body")))
    first = F.coalesce(F.get(parts, 0), F.col("body"))
    second, third = F.get(parts, 1), F.get(parts, 2)
    packed = first.rlike(r"^.+, ")
    title = F.when(packed, T.strip(F.regexp_extract(first, r"^(.*), (.*)$", 1))).otherwise(first)
    named = F.when(packed, T.strip(F.regexp_extract(first, r"^(.*), (.*)$", 2))).otherwise(second)
    found = head.select(
        "doc_id", "role_no", title.alias("title"), F.coalesce(named, F.col("above")).alias("company"), F.when(packed & second.isNotNull(), second).otherwise(third).alias("location"),
        date_range(F.col("body")).alias("dates"), F.col("line_no").alias("line_start"), F.greatest("line_no", "line_end").alias("line_end"), T.strip(F.col("text")).alias("quote"),
    )
    bullets = rows.filter(inside & ~F.col("anchor")).select("doc_id", "role_no", F.row_number().over(W.partitionBy("doc_id", "role_no").orderBy("line_no")).alias("pos"), F.col("body").alias("bullet"))
    stray = rows.groupBy("doc_id").agg(F.count_if((F.col("role_no") == 0) & ~F.col("context")).alias("stray"))
    return found, bullets, stray


def unassigned(sectioned: DataFrame, stray: DataFrame) -> DataFrame:
    """doc_id, n: lines in no role and header lines beyond three, where there are three or more."""
    head = of_section(sectioned, "NONE").groupBy("doc_id").agg(F.greatest(F.count("*") - HEADER_ALLOWANCE, F.lit(0)).alias("head"))
    rows = stray.join(head, "doc_id", "full").select("doc_id", (F.coalesce("stray", F.lit(0)) + F.coalesce("head", F.lit(0))).alias("n"))
    return rows.filter(F.col("n") >= STRAY)


def credential(c: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CREDENTIALS)), lambda w: F.contains(F.lower(c), w))


def education(sectioned: DataFrame) -> DataFrame:
    order = W.partitionBy("doc_id").orderBy("line_no")
    rows = of_section(sectioned, "EDUCATION").withColumn("is", credential(F.col("body")))
    plain = F.when(~F.col("is") & (F.col("body") != ""), F.col("body"))
    rows = rows.withColumn("plain", plain).withColumn("below", F.lead("plain").over(order)).withColumn("over", F.lag("plain").over(order))
    parts = _chunks(without_date(F.col("body")))
    return rows.filter("is").select(
        "doc_id", F.row_number().over(order).alias("seq"), F.coalesce(F.get(parts, 0), without_date(F.col("body"))).alias("credential"),
        F.coalesce(F.get(parts, 1), F.col("below"), F.col("over")).alias("institution"), date_range(F.col("body")).alias("dates"), "line_no", _own_line("EDUCATION"),
    )


def projects(sectioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects (doc_id, seq, name, line_no, provenance: up to the line above the next project's, the last one's own line; its name) and their
    bullets (doc_id, seq, pos, bullet)."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    opens = ~F.col("bullet") | (F.row_number().over(order) == 1)
    rows = of_section(sectioned, "PROJECTS").withColumn("opens", opens)
    rows = rows.withColumn("seq", F.sum(F.col("opens").cast("int")).over(order))
    name = without_date(F.col("body"))
    next_one = F.lead("line_no").over(order)
    found = rows.filter("opens").select("doc_id", "seq", name.alias("name"), "line_no", provenance("PROJECTS", F.col("line_no"), F.greatest(F.col("line_no"), F.coalesce(next_one - 1, F.col("line_no"))), name))
    bullets = rows.filter("not opens").select("doc_id", "seq", F.row_number().over(W.partitionBy("doc_id", "seq").orderBy("line_no")).alias("pos"), F.col("body").alias("bullet"))
    return found, bullets


def certifications(sectioned: DataFrame) -> DataFrame:
    rows = of_section(sectioned, "CERTIFICATIONS").filter("body <> ''")
    return rows.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")).alias("seq"), F.col("body").alias("name"), "line_no", _own_line("CERTIFICATIONS"))


def demonstrated(skill: DataFrame, bullets: DataFrame, origin: str) -> DataFrame:
    """doc_id, name, origin, entry, quote: the first bullet of each role or project (bullets: doc_id, entry, pos, bullet) that
    mentions a listed skill as a whole term."""
    names = skill.select("doc_id", "name", T.sided(F.lower("name")).alias("term"))
    rows = names.join(bullets.withColumn("within", T.sided(F.lower("bullet"))), "doc_id").filter(F.contains("within", "term"))
    return rows.groupBy("doc_id", "name", "entry").agg(F.min_by("bullet", "pos").alias("quote")).withColumn("origin", F.lit(origin))


def facts(docs: DataFrame, role: DataFrame, bullets: DataFrame, project: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id, text) what a judgement without a model goes by: how many roles and bullets it has, whether it has projects, and
    whether it gives numbers. A document without any has none of them; each side is counted before it is joined."""
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = docs.select("doc_id", F.coalesce(F.col("text").rlike(NUMBERS), F.lit(False)).alias("has_numbers"))
    for found in (count(role, "roles"), count(bullets, "bullets"), count(project, "projects")):
        rows = rows.join(found, "doc_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    return rows.select("doc_id", zero("roles").alias("roles"), zero("bullets").alias("bullets"), "has_numbers", (zero("projects") > 0).alias("has_projects"))


def structure_warnings(docs: DataFrame, role: DataFrame, bullets: DataFrame, sectioned: DataFrame) -> DataFrame:
    """doc_id, code, n: no roles, no sections, or so many weak roles (no title or company, no bullet, dates not sure)."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    with_bullets = bullets.select("doc_id", "role_no").distinct().withColumn("has", F.lit(True))
    rows = role.join(with_bullets, ["doc_id", "role_no"], "left")
    weak = blank(F.col("title")) | blank(F.col("company")) | F.col("has").isNull() | F.coalesce(F.col("dates.confidence") != "HIGH", F.lit(True))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("roles"), F.count_if(weak).alias("weak"))
    known = sectioned.filter("section <> 'NONE'").select("doc_id").distinct().withColumn("known", F.lit(True))
    found = docs.select("doc_id").join(counts, "doc_id", "left").join(known, "doc_id", "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), F.struct(F.lit("NO_SECTIONS_DETECTED").alias("code"), F.lit(1).cast("long").alias("n"))),
            F.when(F.col("roles").isNull(), F.struct(F.lit("NO_ROLES_DETECTED").alias("code"), F.lit(1).cast("long").alias("n"))),
            F.when(F.col("weak") > 0, F.struct(F.lit("LOW_CONFIDENCE_STRUCTURE").alias("code"), F.col("weak").alias("n"))),
        )
    )
    return found.select("doc_id", F.explode(codes).alias("w")).select("doc_id", "w.code", "w.n")
