"""Line breaks for postings that arrived as one run of text. No word is added, removed or changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import text as T

CONTINUOUS, FRAGMENT = 300, 15
# Labels that introduce a field.
FIELD_LABELS = [
    "job description", "job title", "title", "position", "role", "team", "company", "employer", "organisation", "organization", "location",
    "employment type", "job type", "department", "reports to", "salary", "compensation", "pay range", "posted",
]


def merge_fragments(parts: DataFrame) -> DataFrame:
    """doc_id, i, part: parts under 15 characters join the part before them."""
    opens = (F.col("i") == F.min("i").over(W.partitionBy("doc_id"))) | (F.length(T.strip(F.col("part"))) >= FRAGMENT)
    rows = parts.withColumn("part_no", F.sum(opens.cast("int")).over(W.partitionBy("doc_id").orderBy("i")).cast("int"))
    first = F.row_number().over(W.partitionBy("doc_id", "part_no").orderBy("i")) == 1
    rows = rows.withColumn("part", F.when(first, F.col("part")).otherwise(T.strip(F.col("part"))))
    rows = rows.groupBy("doc_id", "part_no").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("ps"))
    return rows.select("doc_id", "part_no", F.array_join("ps.part", " ").alias("part"))


def break_before_labels(c: Column) -> Column:
    """A line for each label: marked where it starts, so one label within another ("job title:") breaks there too."""
    labels = "|".join(FIELD_LABELS)
    return F.regexp_replace(c, rf"(?i)(?<=[a-zA-Z0-9.,;:)\]] )(?=(?:{labels})\s*:)", "\n")


# Words on their own that are only ever a heading, and phrases that are prose within a line.
SAFE_WORDS = ["responsibilities", "requirements", "qualifications", "benefits", "perks"]
PROSE = ["the role", "in this role", "day to day", "must have", "you have", "about you"]
# How items begin, in the order in which they are tried.
OPENERS = [
    "strong", "solid", "excellent", "experience", "experienced", "familiarity", "familiar", "proficiency", "proficient", "knowledge", "understanding", "exposure", "ability", "comfortable",
    "demonstrated", "proven", "hands-on", "bachelor", "bachelor's", "master's", "degree", "diploma", "fluency", "passion", "willingness", "must", "should", "you", "design", "develop",
    "build", "create", "implement", "integrate", "maintain", "own", "lead", "manage", "deliver", "deploy", "monitor", "document", "mentor", "ensure", "participate", "collaborate",
    "partner", "contribute", "support", "improve", "optimise", "optimize", "troubleshoot", "debug", "review", "test", "write", "work", "drive", "analyse", "analyze", "translate", "help",
    "continuously", "regularly", "actively", "proactively",
]
# Words after which a capital goes on with the same thought.
CONTINUES = [
    "with", "of", "in", "on", "at", "to", "for", "and", "or", "the", "a", "an", "as", "by", "from", "using", "such", "including", "like", "into", "across", "via", "per", "about",
    "our", "your", "their", "its", "this", "that", "these", "those", "is", "are", "be", "been", "being", "we", "you", "they",
]


def inline_phrases() -> list[str]:
    from fitloom.operators.posting import HEADINGS

    found = {p for names in HEADINGS.values() for p in names if " " in p or p in SAFE_WORDS}
    return sorted(found - set(PROSE), key=lambda p: (-len(p), p))


def break_before_headings(c: Column) -> Column:
    """Each heading within a run gets a line of its own; one right behind another is left, as nothing stands before it."""
    phrases = "|".join(p.replace("'", "\\'") for p in inline_phrases())
    about = r"(?-i:About\s+(?:the\s+)?[A-Z][\w&.'’-]{1,30}(?=[ :]))"
    return F.regexp_replace(c, rf"(?i)(?!\G)(?<=(?-i:[a-z.,;:)\]]) )({about}|(?:{phrases})(?=[ :]))[ :]+", "\n$1\n")


def break_before_openers(c: Column) -> Column:
    """A line for each item opener that isn't behind a word that goes on, if 15 characters lie between it and the break that its own opener made last.

    Openers count one after the other, and those before have put their breaks, a character each, into what is measured. Yet a decision only
    depends on breaks to its left, so one alternation marks all candidates and one fold goes over them from left to right. Of earlier breaks it holds
    those that can still matter: the ones within 15 characters."""
    forms = "|".join(o[0].upper() + o[1:] for o in sorted(OPENERS, key=len, reverse=True))
    return T.bound(F.split(c, rf"(?<=[a-z0-9)\]] )(?=(?:{forms})\s)"), _broken)


def _broken(parts: Column) -> Column:
    """The text of parts, with a line for each that is broken off."""

    def add(done: Column, part: Column) -> Column:
        at = done["at"]
        rank = F.array_position(F.array(*map(F.lit, OPENERS)), F.lower(F.regexp_extract(part, r"^(\S+)", 1)))
        word = F.lower(F.regexp_replace(F.regexp_extract(done["part"], "([^ ]*) $", 1), "[^A-Za-z']", ""))
        near = F.filter(done["near"], lambda b: at - b["at"] < FRAGMENT)
        # The last break of this opener; none: the start of the text.
        last = F.array_max(F.transform(F.filter(near, lambda b: b["rank"] == rank), lambda b: b["at"]))
        since = F.coalesce(last, F.lit(0))
        put_in = F.size(F.filter(near, lambda b: (b["rank"] < rank) & (b["at"] > since)))
        apart = F.when(last.isNull() & (at >= FRAGMENT), True).otherwise(at - since + put_in >= FRAGMENT)
        breaks = (at > 0) & ~word.isin(CONTINUES) & apart
        return F.struct(
            (at + F.length(part)).alias("at"), part.alias("part"), F.when(breaks, F.array_append(near, F.struct(at.alias("at"), rank.alias("rank")))).otherwise(near).alias("near"),
            F.array_append(done["breaks"], breaks).alias("breaks"),
        )

    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("part"), F.array().cast("array<struct<at:int,rank:bigint>>").alias("near"), F.array().cast("array<boolean>").alias("breaks"))
    joined = lambda done: F.array_join(F.zip_with(parts, done["breaks"], lambda part, b: F.when(b, F.concat(F.lit("\n"), part)).otherwise(part)), "")
    return F.when(F.size(parts) == 1, parts[0]).otherwise(F.aggregate(parts, none, add, joined))


def break_between_items(c: Column) -> Column:
    """A line for each item: at bullets that are left, finished sentences, years of experience and item openers."""
    c = F.regexp_replace(c, r"\s*[•·●▪‣⁃]\s*", "\n")
    c = F.regexp_replace(c, r"(?<=[a-z0-9)\]])\.\s+(?=[A-Z])", ".\n")
    return break_before_openers(F.regexp_replace(c, r"(?<=[a-z),.] )(?=\d+\+?\s*(?:-\s*\d+\s*)?years?\b)", "\n"))


def merged(parts: Column) -> Column:
    """An array of parts in which those under 15 characters join the part before them."""

    def add(done: Column, part: Column) -> Column:
        short = F.length(T.strip(part)) < FRAGMENT
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), T.strip(part))))
        return F.when(short, joined).otherwise(F.array_append(done, part))

    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), add)


def recovered(run: Column) -> Column:
    """The parts of one run of text, in order."""
    pieces = F.split(break_before_labels(break_before_headings(T.strip(run))), "\n")
    parts = F.transform(pieces, lambda p: F.when(F.length(p) > 4 * FRAGMENT, T.bound(F.split(break_between_items(p), "\n"), merged)).otherwise(F.array(p)))
    return T.bound(F.transform(F.flatten(parts), T.strip), lambda found: F.filter(found, lambda p: p != ""))


def recover(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, part_no, part of every line over 300 characters; docs: doc_id, line_no, text. A line is taken apart in its own row: nothing
    is shuffled. Null, empty and short lines give no rows; repeated rows give equal parts."""
    runs = docs.filter(F.length(T.strip(F.col("text"))) > CONTINUOUS)
    return runs.select("doc_id", "line_no", F.posexplode(recovered(F.col("text"))).alias("part_no", "part"))
