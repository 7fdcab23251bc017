"""Substring dedup: every passage of ``window`` words that an earlier document has is taken out.

1. Anchors. Each window is named by one of its five-word grams, that of the smallest hash (the first of equals), so the
   same window has the same anchor in every document, and neighbouring windows mostly share theirs. About a fifth of
   the words start an anchor. Anchors of two documents or more recur; they go into a bit filter of
   bounded size (at most 16 MB). False positives cost time only.
2. Segments. The words of the windows that share a recurring anchor are sent to the anchor's shard, in the order of
   doc_id. So every document streams past each automaton that can hold a phrase of it, and past no other: to stream all documents
   past all automata would cost shards times corpus.
3. Automata. A shard's rows come in chunks. A window is a phrase if two documents have it (by a 64-bit hash of its words). The
   phrases, each with its first document, are compiled into Aho-Corasick automata of at most ``PHRASES``; in an automaton a phrase
   is the few grams that cover it (of 13 words: three of five), each numbered by its words themselves and written as
   ``DIGITS`` characters. The chunk's distinct segments are streamed through, but for those that no earlier document shares a window's hash with,
   and what an automaton matches, word by word, in a later document than the phrase's first is removed. Two
   windows of one anchor whose hashes are equal by chance (odds of pairs over 2^64) would share the earlier one's first document.
4. The ranges found meet the documents again, and their words are cut out of the whole texts.

Skew: anchors that hold more than ``1 / HOT_SHARE`` of all anchors (at most that many can) are sent window by window, and
windows that hold as much are dealt out by salt, each salt with a copy of the phrase's first occurrence. A shard's memory
is that of one chunk of rows and of the distinct phrases of one anchor.

Defined results: a null, empty or short text has no window and keeps its words; a null doc_id is never earlier or later,
so its words stay; rows that repeat a doc_id are one document to each other; windows are judged on the input, not on
what is left; an empty table gives no rows; other columns are kept, but one named ``dedup`` is replaced. A slice of texts holds
whole texts, up to 1 MB together or one longer text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.llm.rows import lean, packed, row_field, spread
from fitloom.llm.sift import sifted
from fitloom.llm.textarrays import BASE, INVERSE, SPACE, Powers, Texts, gram_ok, grams, mix, split, texts_of
from fitloom.plans.scratch import Scratch

ANCHOR = 5
PHRASES = 20_000
#: Characters of a gram in an automaton.
DIGITS = 3
CHUNK_ROWS = 20_000
HOT_SHARE = 20_000
HOT_LEAST = 2_000
FILTER_BITS = (1 << 16, 1 << 27)
SEGMENT = "key bigint, salt int, doc_id bigint, h bigint, at int, words string"
#: As bytes.split has it.
WORD = re.compile(rb"\S+")
RANGE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def runs(t: Texts, powers: Powers, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: its anchor's hash, its first and last window's start, its text's index."""
    k = min(ANCHOR, window)
    starts, docs = gram_ok(t.first, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    g = grams(t.word_hashes(powers), k)
    best, at, have = g, np.arange(len(g)), 1
    while have < window - k + 1:
        step = min(have, window - k + 1 - have)
        less = best[step:] < best[:-step]
        best, at, have = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step]), have + step
    best, at = best[starts], at[starts]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (docs[1:] != docs[:-1])]))
    last = np.append(edge[1:], len(at)) - 1
    return best[edge].view(np.int64), starts[edge], starts[last], docs[edge]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASE, INVERSE)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for t in texts_of(batch.column("text")):
                anchor, _, _, owner = runs(t, powers, window)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[t.rows][owner], pa.int64())], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor bigint, doc_id bigint")


def _bits(anchors: DataFrame, n: int) -> np.ndarray:
    """A bit filter of the anchors; its size is bounded whatever their number."""
    size = FILTER_BITS[0]
    while size < min(16 * n, FILTER_BITS[1]):
        size *= 2
    places = F.array(F.col("anchor").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("anchor", 30).bitwiseAND(F.lit(size - 1)))
    words = anchors.select(F.explode(places).alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    )
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _passes(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 64 - 1)
    h = anchor.view(np.uint64)
    good = np.ones(len(h), bool)
    for place in (h & mask, (h >> np.uint64(30)) & mask):
        good &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return good


def _segments(docs: DataFrame, window: int, bits: np.ndarray, hot: np.ndarray, often: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Segments of recurring anchors by the anchor's hash; of hot ones each window alone, by the window's hash and a salt if
    it is among ``often`` (hashes in order, numbers of salts). Without ``often``, only the windows of hot anchors."""
    shared = docs.sparkSession.sparkContext.broadcast((bits, hot, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASE, INVERSE)
        bits, hot, often = shared.value
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
            for t in texts_of(batch.column("text")):
                anchor, first, last, owner = runs(t, powers, window)
                good = _passes(bits, anchor)
                is_hot = np.isin(anchor, hot)
                if often is None:
                    good &= is_hot
                key, first, last, owner, is_hot = anchor[good], first[good], last[good], owner[good], is_hot[good]
                salt = np.zeros(len(key), np.int32)
                if is_hot.any():
                    n = np.where(is_hot, last - first + 1, 1)
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    key, first, last, owner, is_hot = (np.repeat(x, n) for x in (key, first, last, owner, is_hot))
                    first = first + step
                    last = np.where(is_hot, first, last)
                    whole = grams(t.word_hashes(powers), window).view(np.int64)
                    key = np.where(is_hot, whole[first], key)
                    salt = np.zeros(len(key), np.int32)
                    if often is not None and len(often[0]):
                        at = np.minimum(np.searchsorted(often[0], key), len(often[0]) - 1)
                        dealt = is_hot & (often[0][at] == key)
                        doc = mix(ids[t.rows][owner[dealt]].astype(np.int64).view(np.uint64))
                        salt[dealt] = doc % often[1][at[dealt]].astype(np.uint64)
                raw, ends = _spaced(t)
                words = [raw[a:b] for a, b in zip(ends[first].tolist(), ends[last + window].tolist())]
                for at in range(0, len(words), CHUNK_ROWS):
                    part = slice(at, at + CHUNK_ROWS)
                    mine = owner[part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[part]), pa.array(salt[part]), pa.array(ids[t.rows][mine], pa.int64()), pa.array(hashes[t.rows][mine], pa.int64()),
                            pa.array((first[part] - t.first[mine]).astype(np.int32)), pa.array(words[part], pa.binary()).cast(pa.string()),
                        ],
                        ["key", "salt", "doc_id", "h", "at", "words"],
                    )

    return docs.select("doc_id", "h", "text").mapInArrow(run, SEGMENT)


def _spaced(t: Texts) -> tuple[bytes, np.ndarray]:
    """A slice's words, each followed by one space, and where each begins; one place more than words."""
    sizes = t.word_hi - t.word_lo
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(ends[-1], 32, np.uint8)
    out[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = t.data[~SPACE[t.data]]
    return out.tobytes(), ends


def _automata(phrases: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, ahocorasick.Automaton]]:
    """Automata that tell each phrase's first document. phrases: a row of gram numbers each. With each automaton come the gram numbers
    that its phrases have, ascending, and the ``DIGITS`` characters of each; any other gram is the characters 0, which no phrase has. A
    node's edges are searched one by one, so a gram is not one character of many, but a few of few."""
    for at in range(0, len(phrases), PHRASES):
        used, number = np.unique(phrases[at : at + PHRASES], return_inverse=True)
        base = int(np.ceil(len(used) ** (1 / DIGITS))) + 1
        letters = np.stack([np.arange(len(used)) // base**i % base + 1 + base * i for i in range(DIGITS)], axis=1).astype("<u4")
        text, size = letters[number.reshape(-1)].tobytes().decode("utf-32-le"), DIGITS * phrases.shape[1]
        automaton = ahocorasick.Automaton()
        for i, doc in enumerate(first[at : at + PHRASES].tolist()):
            automaton.add_word(text[i * size : (i + 1) * size], doc)
        automaton.make_automaton()
        yield used, letters, automaton


def _gram_numbers(t: Texts, k: int) -> np.ndarray:
    """Numbers of each k consecutive words, across the ends of segments too: equal ones for equal words, word by word."""
    ends = np.concatenate([[0], t.word_hi + 1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(t.data)])
    number, have = words.dictionary_encode().indices.to_numpy().astype(np.int64), 1
    while have < k and len(number):
        step = min(have, k - have)
        pairs = (number[:-step] << 32) | number[step:]
        number, have = pa.array(pairs).dictionary_encode().indices.to_numpy().astype(np.int64), have + step
    return number


def _located(chunk: pa.RecordBatch, carried: dict[int, int], window: int, powers: Powers) -> tuple[pa.RecordBatch, dict[int, int]]:
    """Ranges to remove in a chunk of rows, sorted by key, salt and doc_id; and the first documents of the windows of its last group,
    by hash. carried: those of the chunk before, if its last group goes on."""
    doc, h, at, known, key, salt = (chunk.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h", "at", "known", "key", "salt"))
    coded = chunk.column("words").dictionary_encode()
    segment, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    t = split(np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], slice(0, len(distinct)))
    most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    low, high = np.full(len(distinct), most), np.full(len(distinct), least)
    np.minimum.at(low, segment, doc)
    np.maximum.at(high, segment, doc)

    starts, owner = gram_ok(t.first, window)
    names, where, same = np.unique(grams(t.word_hashes(powers), window)[starts], return_index=True, return_inverse=True)
    first, latest = np.full(len(names), most), np.full(len(names), least)
    np.minimum.at(first, same, low[owner])
    np.maximum.at(latest, same, high[owner])
    if carried:
        old = np.fromiter(carried, np.uint64, len(carried))
        place = np.minimum(np.searchsorted(names, old), len(names) - 1)
        there = names[place] == old
        np.minimum.at(first, place[there], np.fromiter(carried.values(), np.int64, len(carried))[there])
    goes_on = (key == key[-1]) & (salt == salt[-1])
    of_last = np.isin(owner, segment[goes_on])
    kept = dict(zip(names[same[of_last]].tolist(), first[same[of_last]].tolist()))
    if goes_on.all():
        kept = carried | kept

    recurs = np.flatnonzero(first < latest)
    # Nothing goes from a segment without a window (by its hash) that an earlier document than the segment's last has; it isn't streamed.
    later = np.zeros(len(distinct), bool)
    later[owner[first[same] < high[owner]]] = True
    # A window is k words every ``step`` words, which cover it; a segment is streamed once for each place to begin, with 0 behind each.
    k = min(ANCHOR, window)
    step = max(d for d in range(1, k + 1) if (window - k) % d == 0)
    numbers, (begin, of) = _gram_numbers(t, k), gram_ok(t.first, k)
    begin, of = begin[later[of]], of[later[of]]
    turn = np.where(later, -(-(t.n_words - k + 1) // step) + 1, 0)
    base = np.cumsum(step * turn) - step * turn
    slot = base[of] + (begin - t.first[of]) % step * turn[of] + (begin - t.first[of]) // step
    grams_of = numbers[starts[where[recurs]][:, None] + np.arange(0, window - k + 1, step)] if len(recurs) else np.zeros((0, 1), np.int64)
    hits = [np.zeros((0, 2), np.int64)]
    for used, letters, automaton in _automata(grams_of, first[recurs]):
        character = np.zeros((int(numbers.max()) + 1, DIGITS), "<u4")
        character[used] = letters
        streamed = np.zeros((int(step * turn.sum()), DIGITS), "<u4")
        streamed[slot] = character[numbers[begin]]
        hits.append(np.array(list(automaton.iter(streamed.tobytes().decode("utf-32-le"))), np.int64).reshape(-1, 2))
    found = np.concatenate(hits)
    at_end = found[:, 0] // DIGITS
    of = np.searchsorted(base, at_end, "right") - 1  # the last that begins there: what isn't streamed takes no room before the next
    behind = at_end - base[of]
    place, origin = behind % turn[of] * step + behind // turn[of] - (window - k), found[:, 1]
    order = np.lexsort((origin, place, of))
    of, place, origin = of[order], place[order], origin[order]
    edge = np.searchsorted(of, np.arange(len(distinct) + 1))

    # Every row of a segment has its hits, but for those of its own or a later document.
    rows = np.flatnonzero(~known & (edge[segment + 1] > edge[segment]))
    n = edge[segment[rows] + 1] - edge[segment[rows]]
    hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edge[segment[rows]], n)
    row = np.repeat(rows, n)
    good = origin[hit] < doc[row]
    row, lo = row[good], place[hit][good]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > lo[:-1] + window)])[: len(row)]
    edge = np.flatnonzero(new)
    end = np.append(edge[1:], len(row))[: len(edge)] - 1
    row, lo, hi = row[edge], lo[edge], lo[end] + window
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(h[row]), pa.array((at[row] + lo).astype(np.int32)), pa.array((at[row] + hi).astype(np.int32))], schema=RANGE), kept


def repeated_ranges(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, h (the text's hash) and ranges (of words, end exclusive) that an earlier document has; no row without."""
    lean(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).filter("doc_id is not null and text is not null")
    seen = _anchors(rows, window).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    seen = scratch.keep(seen.filter("lo < hi").select("anchor", "n"), "anchors")
    n_anchors, n_rows = seen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(HOT_LEAST, n_rows // HOT_SHARE)
    hot = seen.filter(F.col("n") > limit).select("anchor").toArrow().column("anchor").to_numpy()
    bits, hot, often = _bits(seen, n_anchors), np.sort(hot), (np.zeros(0, np.int64), np.zeros(0, np.int32))
    copies = None
    if len(hot):
        # Few windows can be so frequent: at most 13 times the least share's inverse.
        counted = _segments(rows, window, bits, hot, None).groupBy("key", "words").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
        counted = scratch.keep(counted.filter(F.col("n") > limit).withColumn("salts", F.ceil(F.col("n") / limit).cast("int")), "often")
        table = counted.groupBy("key").agg(F.max("salts").alias("salts")).orderBy("key").toArrow()
        often = (table.column("key").to_numpy(), table.column("salts").to_numpy())
        copies = counted.select(
            "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "doc_id", F.lit(0).cast("long").alias("h"), F.lit(0).alias("at"), "words", F.lit(True).alias("known")
        )
    segments = _segments(rows, window, bits, hot, often).withColumn("known", F.lit(False))
    if copies is not None:
        segments = segments.unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, carried, last = Powers(BASE, INVERSE), {}, None

        def chunks() -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK_ROWS):
                    parts.append(batch.slice(start, CHUNK_ROWS))
                    size += parts[-1].num_rows
                    if size >= CHUNK_ROWS:
                        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                        parts, size = [], 0
            if size:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for chunk in chunks():
            group = [(chunk.column("key")[i].as_py(), chunk.column("salt")[i].as_py()) for i in (0, -1)]
            out, carried = _located(chunk, carried if group[0] == last else {}, window, powers)
            last = group[1]
            yield out

    shards = segments.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id", F.col("known").desc())
    found = shards.mapInArrow(run, "doc_id bigint, h bigint, lo int, hi int")
    return scratch.only(found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")


def _cut(text: bytes, ranges: list[tuple[int, int]], spaced: bool) -> tuple[int, int, bytes]:
    """Words, words removed, and what is kept: the words joined by spaces; with ``spaced``, the text with its own spacing between them."""
    words = text.split()
    if not ranges:
        return len(words), 0, text if spaced else b" ".join(words)
    runs, at = [], 0
    for lo, hi in sorted(ranges):
        if lo > at:
            runs.append((at, lo))
        at = max(at, hi)
    if at < len(words):
        runs.append((at, len(words)))
    removed = len(words) - sum(hi - lo for lo, hi in runs)
    if not spaced:
        return len(words), removed, b" ".join([w for lo, hi in runs for w in words[lo:hi]])
    # Of the white space around a cut, what stands before the next kept word stays.
    at = [m.span() for m in WORD.finditer(text)]
    return len(words), removed, b"".join([text[at[lo - 1][1] if i else at[lo][0] : at[hi - 1][1]] for i, (lo, hi) in enumerate(runs)])


def _removed(docs: DataFrame, window: int, spaced: bool) -> DataFrame:
    """row and dedup."""
    ranges = repeated_ranges(docs, window)
    # Only documents that may have ranges are shuffled to meet them, however many those are.
    rows = sifted(packed(docs, doc_id=F.col("doc_id"), h=F.xxhash64("text")), ranges, ["doc_id", "h"], "left").select("row", "ranges")
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ranges = part.column("ranges")
                flat, ends = ranges.flatten(), np.cumsum(ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                pairs = list(zip(flat.field("lo").to_pylist(), flat.field("hi").to_pylist()))
                texts = part.column("row").field("text").cast(pa.binary()).to_pylist()
                found = [_cut(t or b"", pairs[a:b], spaced) for t, a, b in zip(texts, [0, *ends], ends)]
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.StructArray.from_arrays(columns, fields=list(kind))], ["row", "dedup"])

    schema = T.StructType([row_field(docs), T.StructField("dedup", T.StructType.fromDDL("n_words bigint, n_removed bigint, kept string"))])
    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = 13, spaced: bool = False) -> DataFrame:
    """``docs`` with ``dedup``: n_words, n_removed and kept, the words left, joined by one space; with ``spaced``, by the
    white space that stands before them, and unchanged where nothing is removed. A null text is kept as empty."""
    return spread(_removed(docs, window, spaced), docs, dedup=F.col("dedup"))


def cut_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``, ``n_chars`` following it; texts of which nothing is left go."""
    cut = _removed(docs, window, spaced=True).filter("dedup.n_removed = 0 or dedup.n_removed < dedup.n_words")
    changed, own = F.col("dedup.n_removed") > 0, lambda c: F.col("row").getField(c)
    new = {"text": F.when(changed, F.col("dedup.kept")).otherwise(own("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return cut.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
