"""Token counts of byte-level BPE vocabularies by rank-synchronous merging of arrays.

Texts are cut at the vocabulary's special strings (one token each) and into pre-tokens. The distinct pre-tokens of a batch
lie in one flat array of symbols with their sequence's number; each round looks up the rank of every adjacent pair, takes
the lowest rank of every sequence, merges all its pairs of that rank at once and drops sequences without a known pair. The
symbols that survive are counted. A sequence of ``LONG`` bytes or more keeps its pairs' places by rank instead, so that a round only touches what it merges. A pair made by a merge always ranks after that merge, so merging all of a sequence's
lowest pairs at once gives what merging them one by one gives.

Each text is counted alone: no shuffle; memory of one slice of texts and of up to ``CACHE`` known pre-tokens. A null or
empty text has no tokens. Other columns are kept, but one named ``n_tokens`` is replaced. The vocabulary is read on each executor
from its path; a file whose rules aren't known here is refused.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.llm.rows import packed, row_field, spread

#: The pre-tokenizer's pattern. Its \s is Unicode's White_Space, written out, as libraries differ on U+001C to U+001F.
BLANK = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
CACHE = 400_000
SLICE_CHARS = 2_000_000
#: Bytes from which on a pre-token is merged by itself, by the places of each rank: a round then costs what it merges and not the sequence's length.
LONG = 2048
NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts the tokens of texts with the vocabulary file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        if model["type"] != "BPE" or any(t.get(c) for t in added for c in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: not a byte-level BPE with plain special strings")
        cut = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: only the plain byte-level pre-tokenizer without a normalizer or a space in front is known")
        if any(model.get(c) for c in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError(f"{path}: only plain merges are known")
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pattern, self.known = regex.compile(PATTERN), {}

    def merged(self, pieces: list[str]) -> np.ndarray:
        """How many symbols are left of each (non-empty) pre-token."""
        raw = [p.encode() for p in pieces]
        long = [i for i, r in enumerate(raw) if len(r) >= LONG]
        if long:
            out, alone = np.ones(len(raw), np.int64), set(long)
            out[long] = [self.merged_long(raw[i]) for i in long]
            short = [i for i in range(len(raw)) if i not in alone]
            out[short] = self.merged_short([raw[i] for i in short])
            return out
        return self.merged_short(raw)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols (NONE: no pair of the vocabulary), and where they stand in ``keys``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merged_long(self, raw: bytes) -> int:
        """How many symbols are left of one long sequence: all its pairs of the lowest rank are merged at once, and only their neighbours are ranked anew."""
        n = len(raw)
        symbols = np.append(self.byte_ids[np.frombuffer(raw, np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, at = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
        rank[: n - 1], at[: n - 1] = self.rank_of(symbols[: n - 1], symbols[1:n])
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def put(where: np.ndarray) -> None:
            ranks = rank[where]
            where, ranks = where[ranks != NONE], ranks[ranks != NONE]
            order = np.argsort(ranks, kind="stable")
            where, ranks = where[order], ranks[order]
            starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else np.zeros(0, np.int64)
            for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)]):
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(where[a:b])

        put(np.arange(n - 1))
        left = n
        while waiting:
            lowest = heapq.heappop(waiting)
            parts = places.pop(lowest)
            where = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            where = where[rank[where] == lowest]
            if not len(where):
                continue
            # Of overlapping pairs of one symbol, every other one from the left is merged.
            run = np.concatenate([[True], after[where[:-1]] != where[1:]])
            if not run.all():
                offset = np.arange(len(where)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                where = where[offset % 2 == 0]
            gone = after[where]
            symbols[where] = self.made[at[where[0]]]
            rank[gone] = NONE
            after[where] = after[gone]
            before[after[gone]] = where
            left -= len(where)
            touched = np.concatenate([where, before[where]])
            touched = np.unique(touched[touched >= 0])
            rank[touched], at[touched] = self.rank_of(symbols[touched], symbols[after[touched]])
            put(touched)
        return left

    def merged_short(self, raw: list[bytes]) -> np.ndarray:
        """The same for many short sequences in one array."""
        sizes = np.array([len(r) for r in raw], np.int64)
        left = np.ones(len(raw), np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)] if raw else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(raw)), sizes)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NONE)
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][good] = self.ranks[at[good]]
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            left[owner[starts[done]]] = lengths[done]
            chosen = (rank == np.repeat(least, lengths)) & (rank != NONE)
            # Of overlapping pairs of one symbol, every other one from the left is merged.
            where = np.flatnonzero(chosen)
            if not len(where):
                return left
            run = np.concatenate([[True], np.diff(where) != 1])
            offset = np.arange(len(where)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            where = where[offset % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.made[at[where]]
            keep = np.repeat(~done, lengths)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        left[owner] = 1
        return left

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.known) > CACHE:
            self.known = {}
        cut, extra = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            extra[i] = len(parts) - 1
            cut.append([p for part in parts for p in self.pattern.findall(part)] if len(parts) > 1 else self.pattern.findall(text))
        new = sorted(set().union(*cut) - self.known.keys())
        if new:
            self.known.update(zip(new, self.merged(new).tolist()))
        known = self.known.__getitem__
        return extra + np.array([sum(map(known, pieces)) for pieces in cut], np.int64)

    def count_column(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text of a column, in slices of bounded size."""
        texts, out, at = [t or "" for t in column.to_pylist()], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_CHARS):
                size += len(texts[to])
                to += 1
            out.append(self.count(texts[at:to]))
            at = to
        return np.concatenate(out)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counter.count_column(batch.column("row").field(text)), pa.int64())], ["row", "n_tokens"])

    schema = T.StructType([row_field(docs), T.StructField("n_tokens", T.LongType())])
    return spread(packed(docs).mapInArrow(run, schema), docs, n_tokens=F.col("n_tokens"))
