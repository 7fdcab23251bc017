"""Recovery of runs of text against a plain version that goes through labels and openers one after the other."""

import random
import re

import pytest

from fitloom.operators import recovery as R

SPACE = " \t\n\x0b\f\r"


def headings(line):
    phrases = sorted(R.inline_phrases(), key=lambda p: (-len(p), p))
    out, rest = [], line
    while True:
        found = None
        m = re.search(r"(?<=[a-z.,;:)\]] )About\s+(?:the\s+)?[A-Z][\w&.'’-]{1,30}(?=[ :])", rest, re.A)
        if m:
            found = m.span()
        for p in phrases:
            m = re.search(rf"(?<=[a-z.,;:)\]] )(?i:{re.escape(p)})(?=[ :])", rest)
            if m and (found is None or m.start() < found[0]):
                found = m.span()
        if found is None:
            return "".join([*out, rest])
        out += [rest[: found[0]], "\n", rest[found[0] : found[1]], "\n"]
        rest = re.sub("^[ :]+", "", rest[found[1] :])


def items(part):
    part = re.sub(r"[ \t\n\x0b\f\r]*[•·●▪‣⁃][ \t\n\x0b\f\r]*", "\n", part)
    part = re.sub(r"(?<=[a-z0-9)\]])\.\s+(?=[A-Z])", ".\n", part)
    part = re.sub(r"(?<=[a-z),.] )(?=[0-9]+\+?\s*(?:-\s*[0-9]+\s*)?years?\b)", "\n", part)
    for opener in R.OPENERS:
        out, last = [], 0
        for m in re.finditer(rf"(?<=[a-z0-9)\]] ){re.escape(opener[0].upper() + opener[1:])}\b(?=\s)", part):
            before = part[: m.start() - 1]
            word = re.sub("[^A-Za-z']", "", before[before.rfind(" ") + 1 :]).lower()
            if word in R.CONTINUES or m.start() - last < 15:
                continue
            out += [part[last : m.start()], "\n"]
            last = m.start()
        part = "".join([*out, part[last:]])
    parts = part.split("\n")
    out = parts[0]
    for p in parts[1:]:
        out += " " + p.strip(SPACE) if len(p.strip(SPACE)) < 15 else "\n" + p
    return out


def plain(line):
    line = headings(line.strip(SPACE))
    for label in R.FIELD_LABELS:
        line = re.sub(rf"(?<=[a-zA-Z0-9.,;:)\]] )(?i:({label}\s*:))", r"\n\1", line)
    text = "\n".join(items(p) if len(p) > 60 else p for p in line.split("\n"))
    return [p.strip(SPACE) for p in text.split("\n") if p.strip(SPACE)]


def recovered(spark, runs):
    rows = R.recover(spark.createDataFrame([(i, 0, t) for i, t in enumerate(runs)], "doc_id long, line_no int, text string")).collect()
    out = [[] for _ in runs]
    for r in sorted(rows, key=lambda r: (r.doc_id, r.part_no)):
        out[r.doc_id].append(r.part)
    return out


def test_runs_equal_the_plain_version(spark):
    rng = random.Random(4)
    words = [*"data a of and x the systems teams with sql, go (etc) [ok] it. Spark NASA 3".split(), "5+ years", "2 - 4 years of", "Job title:", "Location :", "About Acme", "About the Team", "Requirements:", "What you'll do", "•", "Ltd."]
    openers = [o[0].upper() + o[1:] for o in R.OPENERS]
    runs = []
    for share in (0.15, 0.4, 0.8):
        for _ in range(60):
            runs.append("".join((rng.choice(openers) if rng.random() < share else rng.choice(words)) + rng.choice([" ", " ", " ", "  "]) for _ in range(rng.choice([60, 90, 200]))))
    few = ["Own", "Lead", "You", "Test"]
    runs += [" ".join(rng.choice(few) if rng.random() < 0.5 else rng.choice(["ab", "c", "with", "data"]) for _ in range(150)) for _ in range(60)]
    got = recovered(spark, runs)
    long = [len(r.strip(SPACE)) > R.CONTINUOUS for r in runs]
    assert sum(long) > 200
    for run, ok, found in zip(runs, long, got):
        assert found == (plain(run) if ok else []), run


def test_documents_equal_the_plain_version(spark, sf, duck):
    lines = [t for (t,) in duck.sql("SELECT unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL").fetchall()]
    lines = [" ".join(lines[i : i + 6]) for i in range(0, len(lines), 6)]
    got = recovered(spark, lines)
    assert sum(map(bool, got)) > 20 and all(found == (plain(t) if len(t.strip(SPACE)) > R.CONTINUOUS else []) for t, found in zip(lines, got))


@pytest.mark.parametrize("text,breaks", [("ab Own cdefghijk Own x", 1), ("ab Own cdefg Own x", 0), ("abcdefghijkl it Own cdefghijk Own x", 1), ("abcdefghijkl it Own cdefghijkl m Own x", 2), ("abcdefghijkl with Own x", 0), ("abcdefghijkl it Lead b Own it Lead x", 3), ("abcdefghijkl it Lead abc it Lead x", 1)])
def test_breaks_by_hand(spark, text, breaks):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string")
    got = row.select(R.break_before_openers(F.col("t"))).first()[0]
    assert got.replace("\n", "") == text and got.count("\n") == breaks


def test_odd_rows(spark):
    assert recovered(spark, [None, "", "x" * 300, " " * 400]) == [[], [], [], []]
    long = "word " * 60_000 + "it Own this thing and so on " * 2000
    got = recovered(spark, [long, long])
    assert got[0] == got[1] and "".join(got[0]).replace(" ", "") == long.replace(" ", "") and len(got[0]) > 1000
    assert R.recover(spark.createDataFrame([], "doc_id long, line_no int, text string")).count() == 0


def test_runs_by_hand_equal_the_plain_version():
    from fitloom.queries.documents import RUNS

    assert all(plain(run.replace("@", "qqqqq")) == [p.replace("@", "qqqqq") for p in parts] for run, parts in RUNS)
