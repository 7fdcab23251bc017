"""The filtering stages of the pipeline against a plain version, over whole tables of the smallest scale."""

import re

from fitloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def good(text):
    words = WORD.findall(text)
    total = max(1, sum(map(len, words)))

    def repeated(n):
        seen = {}
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + j for starts in seen.values() if len(starts) > 1 for i in starts for j in range(n)}

    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    if len(words) < 20 or 100 * len(repeated(8)) > 30 * len(words):
        return False
    if any(sum(len(words[j]) for j in repeated(n)) / total > limit for n, limit in quality.MAX_COVERAGE.items()):
        return False
    if sum(len(w) for x in again for w in WORD.findall(x)) / total > quality.MAX_LINE_COVERAGE:
        return False
    return sum(c in "#*$%&|<>" for c in text) <= quality.MAX_SYMBOLS * sum(map(len, words))


def one_of_each(docs, k=5):
    sets = {}
    for i, text in docs.items():
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def without_repeats(docs, n=13):
    first = {}
    for i in sorted(docs):
        w = WORD.findall(docs[i])
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, text in docs.items():
        w = WORD.findall(text)
        gone = {j + x for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for x in range(n)}
        if not gone or len(gone) < len(w):
            out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


def clean(words, items, window=10):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(" ".join(words)))
    for item in items:
        t = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        n = min(len(t), window)
        grams = {tuple(t[j : j + n]) for j in range(len(t) - n + 1)} if n else set()
        if n and any(tuple(own[j : j + n]) in grams for j in range(len(own) - n + 1)):
            return False
    return True


def test_stages_equal_the_plain_version(spark, sf):
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in frame.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = one_of_each({i: t for i, t in docs.items() if good(t)})
    want = {i: w for i, w in without_repeats(kept).items() if clean(w, items)}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
    got = {r.doc_id: WORD.findall(r.text) for r in frame.collect()}
    assert got == want and len(got) < len(docs)
    mixed = corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()
    assert {r.doc_id for r in mixed} <= set(want) and all(1 <= r.copies <= 3 and r.taken == r.copies * len(want[r.doc_id]) for r in mixed)
