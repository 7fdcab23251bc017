"""Hot lists of the similarity join: equal to brute force, and no task holds a group of near copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fitloom.llm import jaccard, rows, sift
from fitloom.llm.textarrays import BASE, INVERSE, Powers, texts_of
from tests.llm.test_large_operators import brute_classes

LIMIT = 16


@pytest.fixture(scope="module")
def group():
    """200 near copies of one text, some far from each other; 60 other texts with one common passage; 40 single ones."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(120)], "one passage that very many of the texts have in common with all others"
    texts = []
    for _ in range(200):
        edited = list(base)
        for _ in range(rng.randrange(7)):
            edited[rng.randrange(len(edited))] = word()
        texts.append(" ".join(edited))
    for _ in range(60):
        texts.append(" ".join([word() for _ in range(60)]) + " " + passage + " " + " ".join([word() for _ in range(20)]))
    texts += [" ".join(word() for _ in range(80)) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts, 3))


@pytest.mark.parametrize("k,num", [(3, 80), (5, 80), (5, 90)])
def test_no_task_holds_or_squares_a_group_of_near_copies(spark, group, k, num, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", LIMIT)
    most, found, candidates = [], [], jaccard._candidates

    def seen(lists, *args, **names):
        most.append(lists.groupBy("token", "cell").count().agg({"count": "max"}).first()[0] or 0)
        pairs = candidates(lists, *args, **names)
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_candidates", seen)
    docs = spark.createDataFrame(group, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, jaccard.classes(docs, k, num, 100).collect()), key=repr)
    assert got == brute_classes(group, k, num, 100)
    # A cell has two parts, and those are dealt by a hash; 200 near copies make 19,900 pairs.
    assert max(most) <= 4 * LIMIT and found[0] < 2000


def test_a_shingle_of_all_documents(spark):
    rng = random.Random(8)
    line = "this licence line stands in every single document of the whole table"
    rows = [(i, " ".join([line, *(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(90)))])) for i in range(300)]
    rows += [(i + 300, text) for i, text in rows[:10]] + [(400, line), (401, line + " too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, jaccard.classes(docs, 5, 80, 100).collect()), key=repr) == brute_classes(rows, 5, 80, 100)


def test_blocks_of_late_positions_are_skipped():
    n = 400
    group, fam, size = np.zeros(n, np.int64), np.arange(n), np.full(n, 100)
    room = np.where(fam < 3, 100, 40)
    pairs = list(jaccard.list_pairs(group, fam, size, size, room, np.zeros(n, np.int64), np.zeros(n, np.int64), 80, 100))
    assert sum(len(a) for a, _ in pairs) == 3


def versions(n, shares=(60, 40), edits=3, words=200, differ=5):
    """One template in versions of so many percent of the rows, each with up to three words of its own."""
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(50000)}"
    base, found = [word() for _ in range(words)], []
    for share in shares:
        for _ in range(n * share // 100):
            edited = list(base)
            for _ in range(rng.randrange(edits + 1)):
                edited[rng.randrange(words)] = word()
            found.append(" ".join(edited))
        for at in range(differ):
            base[(at * 37 + len(found)) % words] = word()
    rng.shuffle(found)
    return list(enumerate(found))


@pytest.mark.parametrize("shares,edits,most", [((60, 40), 3, 5 * 600), ((40, 30, 30), 4, 5 * 600), ((60, 40), 9, 600**1.5)])
def test_versions_of_a_template_do_not_meet_in_pairs(spark, shares, edits, most, monkeypatch):
    """Versions with few words of their own make pairs by rows. Nine such words bring members together by places, in groups below the
    square root of their family, so pairs are bounded by rows^1.5."""
    made, checked = [], jaccard.Families._checked

    def seen(self, pairs, one, two):
        made.append(pairs.count())
        return checked(self, pairs, one, two)

    monkeypatch.setattr(jaccard.Families, "_checked", seen)
    group = versions(600, shares, edits)
    docs = spark.createDataFrame(group, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, jaccard.classes(docs, 3, 90, 100).collect()), key=repr)
    assert got == brute_classes(group, 3, 90, 100)
    # Without families of their own: 10,587 pairs of the first group, 24,104 of the last.
    assert made[0] <= most, made


def test_counts_are_summed_over_tasks_and_all_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TASKS", 2)
    some = [(f"a b c d{i % 7}",) for i in range(700)]
    levels = jaccard._levels(spark.createDataFrame(some, "text string").repartition(7), 3)
    (texts,) = texts_of(pa.array([f"a b c d{i}" for i in range(7)]))
    g, at = jaccard.shingle_sets(texts, Powers(BASE, INVERSE), 3)
    bits = len(levels).bit_length() - 1
    want = np.zeros(1 << bits, int)
    np.add.at(want, (g >> np.uint64(64 - bits)).astype(int), 100)
    assert levels.tolist() == [int(n).bit_length() for n in want]
    assert not jaccard._levels(spark.createDataFrame([], "text string"), 3).any()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [sift.FILTER_BYTES, 72])
def test_sifted_joins_are_joins(spark, how, most, monkeypatch):
    monkeypatch.setattr(sift, "FILTER_BYTES", most)
    left = spark.createDataFrame([(i % 90 if i % 11 else None, i % 3, "t" * (i % 5)) for i in range(400)], "doc long, h long, text string")
    right = spark.createDataFrame([(i, i % 3, [i]) for i in range(0, 120, 3)] * 2 + [(None, 1, [7])], "doc long, h long, more array<long>")
    for wanted in (right, right.limit(0)):
        got, want = sift.sifted(left, wanted, ["doc", "h"], how), left.join(wanted, ["doc", "h"], how)
        assert sorted(got.collect(), key=repr) == sorted(want.select(*got.columns).collect(), key=repr)


def test_classes_where_nothing_is_small_enough_to_be_broadcast(spark, group, monkeypatch):
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(group + group[:20], "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.classes(docs, 5, 80, 100).collect()), key=repr) == brute_classes(group + group[:20], 5, 80, 100)
    kept = [r["doc_id"] for r in jaccard.keep_one_of_each(docs, 5, 80, 100).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_classes(group, 5, 80, 100)})
