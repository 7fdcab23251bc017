import random
import re

import pytest
from pyspark.sql import functions as F

from fitloom.llm import decontaminate, graph, jaccard, substrings

WORDS = ["the", "of", "and", "río", "x1", "The", "tree", "blue", "sky", "zeta", "omega", "kappa"]


def texts(rng, n, length, vocabulary=None):
    vocabulary = vocabulary or [f"w{i}" for i in range(400)] + WORDS * 4
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(length))) for _ in range(n)]


def with_copies(rng, base):
    """Copies, near copies and shared passages of some texts, blank ones, nulls and repeated rows."""
    rows = list(base)
    passage = "a shared passage that many different documents repeat word for word in their own text here again"
    for text in base[:25]:
        words = text.split()
        rows += [text, text.upper(), " ".join(words[: len(words) - 1] + ["end"]), text.replace(" ", "\n\t", 3)]
        for _ in range(3):
            edited = list(words)
            for _ in range(max(1, len(words) // 60)):
                if edited:
                    edited[rng.randrange(len(edited))] = "edit"
            rows.append(" ".join(edited))
        rows.append(" ".join(words[:7]) + f" {passage} " + " ".join(words[9:40]))
    return rows + [None, "", "  \n", "one", "one two", "one two", "ONE two", "a b c", "x" * 3000, "\x00 odd \x7f"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    found = with_copies(rng, texts(rng, 60, 150))
    rng.shuffle(found)
    return list(enumerate(found, 5)) + [(None, found[0]), (None, "null id"), (9, "same id, other text"), (12, found[7]), (12, found[7])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_words string").repartition(5)


def brute_sets(rows, k, num, den):
    sets = []
    for i, text in rows:
        w = words_of(lower(text))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and den * both >= num * (len(sets[x]) + len(sets[y]) - both) or rows[x][0] == rows[y][0] is not None:
                parent[find(x)] = find(y)
    return sets, [find(x) for x in range(len(rows))]


def brute_classes(rows, k, num, den):
    sets, own = brute_sets(rows, k, num, den)
    names = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            names[own[x]] = min(i, names.get(own[x], i))
    return sorted(((i, len(sets[x]), names.get(own[x])) for x, (i, _) in enumerate(rows)), key=repr)


def brute_rows(rows, k, num, den):
    """In the order of rows: id, size, class."""
    sets, own = brute_sets(rows, k, num, den)
    return [(i, len(sets[x]), own[x]) for x, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("hot", [1, 8192])
@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 60)])
def test_classes_equal_brute_force(docs, rows, k, num, hot, monkeypatch):
    # With null ids, rows that repeat an id with the same and with another text, nulls and blanks.
    monkeypatch.setattr(jaccard, "HOT", hot)
    assert sorted(map(tuple, jaccard.classes(docs, k, num, 100).collect()), key=repr) == brute_classes(rows, k, num, 100)


def test_one_of_each_keeps_the_first(spark, docs, rows):
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.keep_one_of_each(docs.limit(0)).count() == 0
    kept = jaccard.keep_one_of_each(docs.withColumn("my col.x", F.lit(1)).withColumn("row", F.lit(2)), 3, 90, 100)
    assert kept.columns == [*docs.columns, "my col.x", "row"]
    want = {}
    for (i, text), (_, n, name) in zip(rows, brute_rows(rows, 3, 90, 100)):
        if n:
            want.setdefault(name, set()).add((i is None, i))
    got = [(r.doc_id is None, r.doc_id) for r in kept.collect() if words_of(r.text)]
    assert sorted(got, key=repr) == sorted((min(v, key=lambda x: (x[0], x[1] or 0)) for v in want.values()), key=repr)
    assert sum(not words_of(r.text) for r in kept.collect()) == sum(not words_of(t) for _, t in rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (500, 499)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {499: 499, 500: 499}
    assert got == want


@pytest.mark.parametrize("hot", [False, True])
def test_removed_substrings_equal_brute_force(docs, rows, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(substrings, "HOT_LEAST", 3)
        monkeypatch.setattr(substrings, "HOT_SHARE", 1 << 40)
        monkeypatch.setattr(substrings, "CHUNK_ROWS", 7)
        monkeypatch.setattr(substrings, "PHRASES", 5)
    first = {}
    for i, text in rows:
        w = words_of(text)
        for j in range(len(w) - 12):
            if i is not None:
                g = tuple(w[j : j + 13])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, text in rows:
        w = words_of(text)
        gone = {j + x for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for x in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    cut = substrings.cut_repeats(docs)
    assert cut.columns == docs.columns
    same = {(i, t) for (i, t), w in zip(rows, want) if w[2] == 0}
    assert same <= {(r.doc_id, r.text) for r in cut.collect()}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_contamination_equals_brute_force(spark, rows, docs):
    rng = random.Random(4)
    source = [t for _, t in rows if t and len(tokens(t)) > 40]
    items = [(i, " ".join(tokens(rng.choice(source))[3 : 3 + rng.randrange(1, 30)])) for i in range(12)]
    items += [(50, "one two"), (51, "never seen words at all in here"), (52, None), (53, ""), (54, "one two"), (None, "a b c"), (55, "the the the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, text in rows:
        w, hit, found = tokens(text), set(), set()
        for item, words in ((i2, tokens(t)) for i2, t in items):
            n = min(len(words), 10)
            windows = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in decontaminate.contamination(docs, table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(w[2] == 0 for w in want)
    assert {r.n_hit for r in decontaminate.contamination(docs, table.limit(0)).collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), table).count() == 0


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta, alpha"), (4, "alpha")], "doc_id long, text string")
    found = decontaminate.phrases(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    index = decontaminate.PositionalIndex.build(docs, decontaminate.terms_of(found))
    assert {r.doc_id for r in decontaminate.near_matches(index, found, slop=3).collect()} == {1, 3}


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        after = after.cache()
        assert 0 < after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert set(docs.columns) < set(last.columns) and last.filter("taken <> copies * size(regexp_extract_all(text, '[^ \\\\t-\\\\r]+', 0))").count() == 0
    assert last.join(start, "doc_id", "left_anti").count() == 0
