"""Quality rules from repetition: how much of a text lies in repeated lines and n-grams.

Rolling hashes of word n-grams of several lengths are computed in numpy over whole batches of texts. An n-gram counts
as repeated when its hash occurs again in the same text (64-bit hashes; two of a text's n-grams share one by chance
with odds of about 1 in 10^10 for 100,000 words). Coverage is the share of the words' characters in repeated n-grams, so
overlapping repeats count once.

Each text is judged alone: no shuffle, memory of one slice of texts. A null, empty or blank text has zero counts and
is rejected (fewer than ``min_words`` words). Repeated rows and ties get equal results; null ids pass through; other
columns are kept as they are, but one named ``repetition`` is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.llm.rows import packed, row_field, spread
from fitloom.llm.textarrays import Powers, BASE, INVERSE, Texts, gram_ok, grams, mix, texts_of

#: Greatest share of a text's word characters in repeated n-grams, by n. A text above any of them is rejected.
MAX_COVERAGE = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Greatest share of word characters in lines that repeat an earlier line.
MAX_LINE_COVERAGE = 0.30
#: Greatest share of junk symbols among a text's word characters.
MAX_SYMBOLS = 0.10
MIN_WORDS = 20
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: White space, and the bytes of a character behind its first.
NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))

FIELDS = pa.schema(
    [(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("dup_line_share", pa.float64()), ("dup_gram_shares", pa.list_(pa.float64()))]
)
DDL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, dup_line_share double, dup_gram_shares array<double>"


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(hashes)
    there = hashes[order]
    same = there[1:] == there[:-1]
    flags = np.zeros(len(hashes), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def covered(t: Texts, words: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its own text repeats."""
    starts, docs = gram_ok(t.first, n)
    if not len(starts):
        return np.zeros(len(words), bool)
    hit = starts[_repeated(grams(words, n)[starts] ^ mix(docs.astype(np.uint64) + np.uint64(1)))]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + n, -1)
    return np.cumsum(edges[:-1]) > 0


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their characters that aren't white space."""
    seen, n, size = set(), 0, 0
    for line in data.split(b"\n"):
        body = line.translate(None, NOT_COUNTED)
        if body:
            if line in seen:
                n, size = n + 1, size + len(body)
            seen.add(line)
    return n, size


def measure(column: pa.Array, lengths: list[int]) -> pa.Table:
    """The counts and shares of every text of a column."""
    powers, parts = Powers(BASE, INVERSE), []
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for t in texts_of(column):
        words = t.word_hashes(powers)
        chars = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum((t.data & 0xC0) != 0x80, out=chars[1:])
        sizes = chars[t.word_hi] - chars[t.word_lo]
        inside = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes, out=inside[1:])
        word_chars = np.diff(inside[t.first])

        def share(marked: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum(sizes * marked, out=sums[1:])
            return np.diff(sums[t.first]) / np.maximum(word_chars, 1)

        window = np.zeros(len(words) + 1, np.int64)
        np.cumsum(covered(t, words, REPEAT_WINDOW), out=window[1:])
        raw = t.data.tobytes()
        lines = [_lines(raw[a:b]) for a, b in zip(t.ends[:-1].tolist(), t.ends[1:].tolist())]
        shares = np.stack([share(covered(t, words, n)) for n in lengths], axis=1)
        parts.append(
            pa.table(
                [
                    pa.array(t.n_words, pa.int64()),
                    pa.array(word_chars),
                    pa.array(t.count(symbol[t.data])),
                    pa.array([n for n, _ in lines], pa.int64()),
                    pa.array(np.diff(window[t.first])),
                    pa.array([size for _, size in lines], pa.float64()).to_numpy() / np.maximum(word_chars, 1),
                    pa.FixedSizeListArray.from_arrays(shares.ravel(), len(lengths)).cast(pa.list_(pa.float64())),
                ],
                schema=FIELDS,
            )
        )
    return pa.concat_tables(parts) if parts else FIELDS.empty_table()


def _judged(docs: DataFrame, text: str, max_coverage: dict[int, float] | None) -> DataFrame:
    """row and repetition."""
    limits = MAX_COVERAGE if max_coverage is None else max_coverage
    lengths = sorted(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("row").field(text), lengths).combine_chunks()
            for part in found.to_batches():
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(part.columns, fields=list(FIELDS))], ["row", "repetition"])

    r = F.col("repetition")
    failed = (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > 30 * r["n_words"])
    over = F.lit(False)
    for i, n in enumerate(lengths):
        over = over | (r["dup_gram_shares"][i] > limits[n])
    over = over | (r["dup_line_share"] > MAX_LINE_COVERAGE) | (r["n_symbols"] > MAX_SYMBOLS * r["word_chars"])
    schema = T.StructType([row_field(docs), T.StructField("repetition", T.StructType.fromDDL(DDL))])
    out = packed(docs).mapInArrow(run, schema)
    return out.select("row", r.withField("base_failed", failed).withField("kept", ~failed & ~over).alias("repetition"))


def repetition(docs: DataFrame, text: str = "text", max_coverage: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with a struct column ``repetition``: counts, ``base_failed``, shares and ``kept``.

    kept: not base_failed (too few words, or over 30 % of the words in repeated 8-word windows), and no share of
    repeated n-grams, repeated lines or symbols above its limit.
    """
    return spread(_judged(docs, text, max_coverage), docs, repetition=F.col("repetition"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the rules, with the columns of ``docs``."""
    return spread(_judged(docs, "text", None).filter("repetition.kept"), docs)
