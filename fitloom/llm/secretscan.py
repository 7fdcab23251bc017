"""Secrets in texts: assignments, access keys and long hex strings by pattern, and random strings by their cost in tokens.

A vocabulary of pairs learned from prose packs words into few tokens and random strings into many. So a run of letters, digits and
``+/_-`` is held to be random when it has few characters per token. Before that, what is known to look random but is no secret is
taken out: addresses of pages and mail, DOIs, embedded data, subresource digests, UUIDs, digests of a known length, account numbers
whose check digits hold, and runs without a letter.

Each text is judged alone: no shuffle; memory of one batch of texts. A null or empty text has no spans. Ties and repeated rows
get equal results; other columns and null ids pass through, but a column named ``secrets`` is replaced; an empty table gives no
rows. Texts of any length are read whole: a very long run is counted in pieces of ``PIECE`` characters, so its cost is linear.
Spans count code points, end exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.llm.rows import packed, row_field, spread

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
# The patterns of the base kinds and the shortest match, or second group, of each.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Runs that may be random, the greatest ratio of characters to tokens of one that is, and how much is counted at once.
MIN_RUN, MAX_RATIO, PIECE = 20, 2.0, 256
#: Hex digits of MD5, SHA-1 and the SHA-2 family.
DIGESTS = {32, 40, 56, 64, 96, 128}
#: Identifiers within a text. Of a page's address, host and path are one (``id``); its user, query and fragment may hold secrets.
KNOWN = re.compile(
    r"[A-Za-z][A-Za-z0-9+.-]{0,20}://(?:[^\s/?#@]*@)?(?P<id>[^\s?#]+)"
    r"|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
    r"|\b10\.[0-9]{4,9}/[^\s]+"
    r"|data:[a-z/+.;=0-9-]*base64,[A-Za-z0-9+/=]*"
    r"|\bsha(?:256|384|512)-[A-Za-z0-9+/]{43,}={0,2}"
    r"|(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
)
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str, assign=re.compile(ASSIGN, re.I | re.A), access=re.compile(ACCESS), hexes=re.compile(HEX)) -> list[tuple[str, int, int]]:
    """Leftmost matches of each base kind that don't overlap, without those that are too short."""
    found = [("assign", *m.span()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [("access", *m.span()) for m in access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [("hex", *m.span()) for m in hexes.finditer(text) if m.end() - m.start() >= MIN_HEX]


def _hidden(m: re.Match) -> str:
    whole, part = m.group(), m.group("id")
    return " " * len(whole) if part is None else whole[: len(whole) - len(part)] + " " * len(part)


def known_form(run: str) -> bool:
    """Whether a whole run is a digest, a number or an account number."""
    bare = run.rstrip("=")
    if len(bare) in DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare):
        return True
    if not re.search("[A-Za-z]", bare):
        return True
    return bool(ACCOUNT.fullmatch(bare)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


class Scanner:
    """Finds the spans of texts with the vocabulary file at ``path`` (lines of a token in base64 and its rank)."""

    def __init__(self, path: str, pattern: str, max_ratio: float = MAX_RATIO):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.max_ratio = max_ratio

    def ratio(self, run: str) -> float:
        """Characters per token."""
        return len(run) / sum(len(self.encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))

    def random_spans(self, text: str) -> list[tuple[str, int, int]]:
        if not RUN.search(text):
            return []
        runs = RUN.finditer(KNOWN.sub(_hidden, text))
        return [("random", *m.span()) for m in runs if not known_form(m.group()) and self.ratio(m.group()) <= self.max_ratio]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by start, then kind. A random run inside a base span is that span's, and not told again."""
        base = base_spans(text)
        more = [s for s in self.random_spans(text) if not any(a <= s[1] and s[2] <= b for _, a, b in base)]
        return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with ``secrets``, an array of structs kind, start, end. The vocabulary is read on each executor from its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(vocabulary, pattern, max_ratio)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t.as_py() or "")] for t in batch.column("row").field(text)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "secrets"])

    schema = T.StructType([row_field(docs), *T.StructType.fromDDL(f"secrets {SPANS}").fields])
    return spread(packed(docs).mapInArrow(run, schema), docs, secrets=F.col("secrets"))


def joined(spans) -> F.Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text, spans, token: str = "[SECRET]") -> F.Column:
    """The text with each stretch of overlapping spans replaced by ``token``; spans as ``scan`` gives them."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(
        F.when(x["start"] >= s["at"], F.concat(s["done"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(token))).otherwise(s["done"]).alias("done"),
        F.greatest(s["at"], x["end"]).alias("at"),
    )
    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
