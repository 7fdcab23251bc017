"""Language of texts and of spans within mixed texts.

Learning: for each language, counts of hashed character trigrams and whole words, and of the words' scripts, over all
labelled texts; tasks send at most ``BUCKETS`` counts per language and the driver gets their sums. Predicting: a word's
script, from ranges of code points, narrows its candidate languages; its trigrams give a score for each; Viterbi with a
penalty for each switch labels the words of the whole text, all texts of a slice in step. The text's language is that of
most letters; the score is their share.

Each text is judged alone. Defined results: a null text or one without a letter is ``und`` with score 0, as is every text
if no labelled text was given; words in a script that no language was learned in count for none, and a text of only such
words gets the language of most training words; ties go to the first language by code point; other columns are kept, but one
named ``language`` is replaced; a slice holds whole texts of up to ``SLICE_CHARS`` characters together, or one longer text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.llm.rows import packed, row_field, spread
from fitloom.llm.textarrays import mix

#: First code points of script ranges, and the script up to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
BUCKETS = 1 << 16
#: A language is a candidate in a script that holds at least this share of its words.
SCRIPT_SHARE = 0.001
SMOOTHING = 0.3
#: What a word's trigrams share evidence in is counted once: its log odds are scaled by this.
SCALE = 0.5
SWITCH = 8.0
SLICE_CHARS = 8_000_000
MAX_LANGUAGES = 500
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' trigrams and of the whole words, the word of each, and the words' script numbers."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    three = mix((points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA6B) + points[2:])
    inside = owner[:-2] == owner[2:]
    place = (np.arange(len(points)) - np.repeat(starts, sizes)).astype(np.uint64)
    whole = mix(np.add.reduceat(mix(points * np.uint64(1 << 20) + place), starts))
    bucket = np.concatenate([three[inside], whole]) >> np.uint64(48)
    first = np.array([s for s, _ in SCRIPTS], np.uint64)
    script = np.searchsorted(first, points[starts + 1], "right") - 1
    return bucket.astype(np.int64), np.concatenate([owner[:-2][inside], np.arange(len(words))]), script


@dataclass
class Model:
    """weights: languages x buckets, log probabilities. scripts: script ranges x languages, whether a candidate."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray
    usual: int

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages."""
        bucket, owner, script = features(words)
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        starts = np.searchsorted(owner, np.arange(len(words)))
        out = np.stack([np.add.reduceat(w[bucket], starts) for w in self.weights], axis=1) * SCALE
        out -= out.max(axis=1, keepdims=True)
        able = self.scripts[script]
        out = np.where(able, np.maximum(out, -50), -1000.0)
        out[~able.any(axis=1)] = 0
        return out.astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; texts are ranges of rows of ``scores`` and go in step, the longest first."""
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at, size = starts[order], lengths[order]
    if not len(at):
        return labels
    best = scores[at].copy()
    stay, other = np.ones(scores.shape, bool), np.zeros(len(scores), np.int32)
    alive = len(at) - np.searchsorted(size[::-1], np.arange(size[0] + 1), "right")
    for t in range(1, int(size[0])):
        k = alive[t]
        now = best[:k]
        top = now.argmax(axis=1)
        jump = (now[np.arange(k), top] - switch)[:, None]
        rows = at[:k] + t
        stay[rows] = now >= jump
        other[rows] = top
        best[:k] = np.maximum(now, jump) + scores[rows]
    state = best.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = alive[t]
        rows = at[:k] + t
        labels[rows] = state[:k]
        state[:k] = np.where(stay[rows, state[:k]], state[:k], other[rows])
    return labels


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            for lang, found in counts.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))
                if found:
                    words, n = list(found), np.fromiter(found.values(), np.float64, len(found))
                    bucket, owner, script = features(words)
                    total[:BUCKETS] += np.bincount(bucket, n[owner], BUCKETS)
                    total[BUCKETS:] += np.bincount(script, n, len(SCRIPTS))
        for lang, total in sums.items():
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(total[there])], ["lang", "slot", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    found = rows.mapInArrow(run, "lang string, slot bigint, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = found.limit((BUCKETS + len(SCRIPTS)) * MAX_LANGUAGES + 1).toPandas()
    languages = sorted(rows["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    counts[rows["lang"].map({x: i for i, x in enumerate(languages)}).astype(int), rows["slot"]] = rows["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    names = np.array([name for _, name in SCRIPTS])
    by_name = np.stack([scripts[:, names == name].sum(axis=1) for name in names], axis=0)
    able = by_name >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=1), 1)
    return Model(languages, weights.astype(np.float32), able, int(scripts.sum(axis=1).argmax()) if languages else 0)


def _predict(model: Model, texts: list[str | None], spans: bool) -> list[tuple]:
    lists = [words_of(t or "") for t in texts]
    lists = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in lists]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists for w in ws))}
    if not model.languages or not number:
        return [("und", 0.0, [])] * len(texts)
    distinct = list(number)
    table, size = model.scores(distinct), np.array([len(w) for w in distinct])
    known = (table != 0).any(axis=1)
    flat = np.fromiter((number[w] for ws in lists for w in ws), np.int64)
    lengths = np.array([len(ws) for ws in lists])
    starts = np.cumsum(lengths) - lengths
    labels = viterbi(table[flat], starts, lengths, SWITCH)
    owner = np.repeat(np.arange(len(lists)), lengths)
    n = len(model.languages)
    letters = np.bincount(owner * n + labels, size[flat] * known[flat], len(lists) * n).reshape(-1, n)
    out = []
    for i, ws in enumerate(lists):
        if not ws:
            out.append(("und", 0.0, []))
            continue
        total = letters[i].sum()
        top = int(letters[i].argmax()) if total else model.usual
        found = []
        if spans:
            mine = labels[starts[i] : starts[i] + lengths[i]]
            edges = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])).tolist()
            found = [{"start": a, "end": b, "lang": model.languages[mine[a]]} for a, b in zip(edges, [*edges[1:], len(mine)])]
        out.append((model.languages[top], float(letters[i, top] / total) if total else 0.0, found))
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``language``: lang, score, and spans (ranges of letter runs, start inclusive, end exclusive)."""
    # Plain arrays: a broadcast class would need the package where the tasks run.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.scripts, model.usual))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*shared.value)
        for batch in batches:
            texts, out, at = batch.column("row").field(text).to_pylist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                out += [{"lang": a, "score": b, "spans": c} for a, b, c in _predict(learned, texts[at:to], spans)]
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], ["row", "language"])

    found = T.StructType.fromDDL("lang string, score double, spans array<struct<start:int,end:int,lang:string>>")
    schema = T.StructType([row_field(docs), T.StructField("language", found)])
    return spread(packed(docs).mapInArrow(run, schema), docs, language=F.col("language"))
