"""What the automata of substring dedup are made of, and windows of other sizes."""

import random

from ahocorasick import Automaton
import numpy as np
import pyarrow as pa
import pytest

from fitloom.llm import substrings
from fitloom.llm.textarrays import BASE, INVERSE, Powers


def test_a_node_has_few_edges_and_only_what_may_go_is_streamed(monkeypatch):
    firsts, streamed = set(), []

    class Counted:
        def __init__(self):
            self.own = Automaton()

        def add_word(self, word, value):
            firsts.add(word[0])
            self.own.add_word(word, value)

        def make_automaton(self):
            self.own.make_automaton()

        def iter(self, text):
            streamed.append(len(text))
            return self.own.iter(text)

    monkeypatch.setattr(substrings.ahocorasick, "Automaton", Counted)
    n = 3000
    shared = ["".join(f"w{i * 13 + j} " for j in range(13)) for i in range(n)]
    alone = ["".join(f"v{i * 13 + j} " for j in range(13)) for i in range(3 * n)]
    rows = [(1, s) for s in shared] + [(2, s + "more ") for s in shared] + [(3, s) for s in alone]
    chunk = pa.RecordBatch.from_arrays(
        [
            pa.array(np.zeros(len(rows), np.int64)), pa.array(np.zeros(len(rows), np.int32)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
            pa.array(np.zeros(len(rows), np.int32)), pa.array([r[1] for r in rows]), pa.array([False] * len(rows)),
        ],
        ["key", "salt", "doc_id", "h", "at", "words", "known"],
    )
    found, _ = substrings._located(chunk, {}, 13, Powers(BASE, INVERSE))
    assert found.to_pylist() == [{"doc_id": 2, "h": 2, "lo": 0, "hi": 13}] * n
    assert len(firsts) <= 100
    assert sum(streamed) < 3 * 25 * n  # the second half of what is shared, three characters a place, and room between


@pytest.mark.parametrize("window", [1, 3, 5, 6, 11, 12, 17])
def test_windows_of_other_sizes_equal_brute_force(spark, window, monkeypatch):
    monkeypatch.setattr(substrings, "PHRASES", 7)
    rng = random.Random(window)
    base = [" ".join(rng.choice(["a", "b", "é", "ab"]) for _ in range(rng.randrange(60))) for _ in range(12)]
    base += [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(8)]
    rows = list(enumerate(base + [" ".join(t.split()[rng.randrange(9) :] + ["end"] + rng.choice(base).split()[:30]) for t in base]))
    first = {}
    for i, text in rows:
        w = text.split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    want = []
    for i, text in rows:
        w = text.split()
        gone = {j + x for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for x in range(window)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, *r.dedup) for r in substrings.remove_repeats(docs, window).collect()) == want
