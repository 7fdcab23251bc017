"""Column functions over texts and lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's patterns take it, without line-specific rules.
SPACE = r"[ \t\n\x0B\f\r]"
# Bullet glyphs of postings and of resumes.
POSTING_BULLETS = "•●▪◦‣⁃·∙・−–—*"
RESUME_BULLETS = "•●▪‣·*\\-–"
# Words that identify nothing.
STOPWORDS = (
    "with and the for years year experience strong using work working ability skills knowledge understanding professional hands "
    "excellent good plus such including other must have from that this into across within their your team teams role"
).split()
# Texts that speak to an automated reader.
IMPERATIVE = [
    r"ignore (all |any )?(the )?(previous|prior|above) instructions",
    r"disregard (the )?(previous|prior|above)",
    r"(rate|score|grade) this (candidate|resume|applicant|posting) (as|a) ",
    r"you are (now )?an? (ai|assistant|language model)",
    r"(output|respond|reply|answer) (only |with )?(in )?(json|the following)",
]
DESCRIPTIVE = [r"system (prompt|message)", r"as an? (ai|language model)", r"\bprompt injection\b"]
# Personal details, in the order of redaction, with their tokens.
REDACTIONS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (
        r"(?i)\b\d{1,6}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){0,3}\s+(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|court|ct|way|"
        r"place|pl|terrace|ter|crescent|cres)\b\.?(?:\s*(?:apt|apartment|unit|suite|ste)\.?\s*[\w-]+)?",
        "[ADDRESS]",
    ),
    (r"(?<![\w-])(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)|\d{2,4})[\s.-]?\d{3}[\s.-]?\d{4}(?![\w-])", "[PHONE]"),
    (r"\b(?:[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d|\d{5}(?:-\d{4})?)\b", "[POSTAL CODE]"),
]


def ascii_edges(pattern: str) -> str:
    """``pattern`` with word edges as RE2 takes them: letters beyond ASCII are no word characters, for ``\\b`` as for ``\\w``. Java 17 counts them for
    ``\\b`` alone, so `5 stß` would hold no whole `5 st`, and `ä5` no edge before its digit."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def as_re2(pattern: str) -> str:
    """``pattern`` with what RE2 takes otherwise than Java: word edges, white space without the vertical tab, the end of the text alone for ``$``, and,
    where case doesn't matter, the long s and the Kelvin sign as letters. The pattern's letters are small ones, in classes ``A-Za-z``."""
    java = ascii_edges(pattern).replace(r"\s", r"[\t\n\f\r ]").replace("$", r"\z")
    if pattern.startswith("(?i)"):
        java = java.replace("s", "[s\u017f]").replace("k", "[k\u212a]").replace("A-Za-z", "A-Za-z\u017f\u212a").replace(r"[\w-]", "[\\w\u017f\u212a-]")
    return java


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with ``c`` worked out once however often it is used."""
    return F.get(F.transform(F.array(c), use), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def unify_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r", "\n")


def lines(c: Column) -> Column:
    """Lines without terminators; the end of the last line makes no further line, an empty text has none."""
    text = F.regexp_replace(unify_lines(c), r"\n$", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def normalise_posting(c: Column) -> Column:
    """One kind of line end, space, quote and bullet; no zero-width characters, trailing blanks or runs of blank lines."""
    text = F.translate(unify_lines(c), "\u00a0\u2018\u2019\u201c\u201d", " ''\"\"")
    text = F.regexp_replace(text, "[\u200b-\u200d\ufeff]", "")
    bullet = rf"^{SPACE}*[{POSTING_BULLETS}]{SPACE}+"
    text = F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+$", ""), bullet, "- ")), "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_resume_bullet(line: Column) -> Column:
    return line.rlike(rf"^{SPACE}*[{RESUME_BULLETS}]{SPACE}+")


def without_resume_bullet(line: Column) -> Column:
    return strip(F.regexp_replace(line, rf"^{SPACE}*[{RESUME_BULLETS}]{SPACE}+", ""))


def grounding_form(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " ")))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), rf"(?<=[.!?]){SPACE}+|\n"), strip)
    return F.filter(parts, lambda s: F.length(s) >= 20)


def distinctive_terms(c: Column, limit: int = 6) -> Column:
    words = F.filter(F.split(F.lower(c), "[^A-Za-z0-9+#.]+"), lambda w: (F.length(w) > 3) & ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(words), 1, limit)


def sided(c: Column) -> Column:
    """A text with a mark behind each place whose left side is free of letters and digits, and one before each whose right side is. A term stands in
    a text as a whole if and only if its sided form stands in the text's: so each is worked out once, and no pattern is made of a term. Characters
    beyond U+FFFF count as neither."""
    plain = F.translate(c, "\x02\x03", "  ")
    return F.concat(F.lit("\x02"), F.regexp_replace(plain, r"([^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}])", "\x03$1\x02"), F.lit("\x03"))


def has_term(text: Column, term: Column) -> Column:
    """Whether the term stands in the text with neither a letter nor a digit beside it."""
    return F.contains(sided(text), sided(term))


def is_imperative(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(IMPERATIVE))


def speaks_to_a_reader(c: Column) -> Column:
    return c.rlike(ascii_edges("(?i)" + "|".join(IMPERATIVE + DESCRIPTIVE)))


def replaced(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """What the patterns find, in their order, in exchange for their tokens."""
    for pattern, token in patterns:
        c = F.regexp_replace(c, pattern, token)
    return c


def redact(c: Column) -> Column:
    text = replaced(c, [(ascii_edges(pattern), token) for pattern, token in REDACTIONS])
    return F.when(F.coalesce(strip(c), F.lit("")) == "", "").otherwise(text)


def redact_name(c: Column, name: Column) -> Column:
    """The full name, then its parts of three letters or more as whole words; shorter names are left alone."""
    token, edge = "[CANDIDATE]", F.lit(ascii_edges(r"\b"))
    quote = lambda x: F.regexp_replace(x, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    parts = F.filter(F.split(name, f"{SPACE}+"), lambda p: F.length(p) >= 3)
    done = F.aggregate(parts, F.replace(c, name, F.lit(token)), lambda text, p: F.regexp_replace(text, F.concat(edge, quote(p), edge), F.lit(token)))
    return F.when((F.length(name) >= 3) & (strip(name) != ""), done).otherwise(c)


def candidate_name(c: Column) -> Column:
    """The first line that isn't blank, if it is short and of four words at most."""
    first = F.get(F.filter(F.transform(lines(c), strip), lambda x: x != ""), 0)
    return F.when((F.length(first) <= 60) & (F.size(F.split(first, f"{SPACE}+")) <= 4), first)
