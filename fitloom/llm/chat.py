"""Chat formatting in windows under a token budget, with masks for the loss.

A conversation's turns become windows of whole turns. Prefix sums of the turns' tokens tell how many more turns fit; the
next window starts with the system turn and with the last turns that fit ``history`` tokens, repeated without loss. Every
turn is new in exactly one window, and only new assistant texts are under the loss mask. A turn longer than the budget
gets a window of its own and is never cut.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``<|`` gets a backslash between its two
characters (and ``<\\|`` one more, and so on), so no text can make a mark, and reading takes it out again.

Turns are tokenized where they are read, evenly over all tasks; then they are shuffled once by conversation and streamed in order,
with memory of one window, whatever a conversation's length. A conversation's windows follow from one another, so one task forms
them; that is cheap beside the tokens. Defined results: a null text or role is empty; a null conversation id is one conversation; null turns come first,
equal ones by role and text; repeated rows are repeated turns; other columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.tokencount import Counter

START, END = "<|im_start|>", "<|im_end|>\n"
WINDOW = "conv_id bigint, window_no int, n_repeated int, n_tokens bigint, text string, loss array<struct<start:int,end:int>>"
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class _Windows:
    """The windows of one conversation, from its turns one by one."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history, self.no = budget, history, 0
        self.system, self.turns, self.n_old, self.first = None, [], 0, True
        #: Prefix sums of the turns' tokens, one more than turns.
        self.sums = [0]

    def add(self, role: str, turn: tuple[str, int, int | None]) -> Iterator[tuple]:
        """turn: its text in the template, its tokens, and where an assistant's text starts."""
        if self.first and role == "system":
            self.system, self.first = turn, False
            return
        self.first = False
        room = self.budget - (self.system[1] if self.system else 0)
        if len(self.turns) > self.n_old and self.sums[-1] + turn[1] > self.sums[0] + room:
            yield self.window()
            again = min(self.history, room - turn[1])
            at = bisect_left(self.sums, self.sums[-1] - again) if again > 0 else len(self.turns)
            del self.turns[:at], self.sums[:at]
            self.n_old = len(self.turns)
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[1])

    def window(self) -> tuple:
        lead = [self.system] if self.system else []
        old, parts, loss, at = (len(lead) if self.no else 0) + self.n_old, [], [], 0
        for i, (text, _, begins) in enumerate(lead + self.turns):
            if begins is not None and i >= old and begins < len(text) - len(END):
                loss.append({"start": at + begins, "end": at + len(text) - len(END)})
            parts.append(text)
            at += len(text)
        self.no += 1
        return self.no - 1, old, sum(t[1] for t in lead) + self.sums[-1] - self.sums[0], "".join(parts), loss

    def close(self) -> Iterator[tuple]:
        if len(self.turns) > self.n_old or self.system and not self.no:
            yield self.window()


def windows(conversations: DataFrame, vocabulary: str, budget: int = 2048, history: int = 512) -> DataFrame:
    """A row per window: conv_id, window_no, n_repeated (leading turns that earlier windows had), n_tokens, text and loss
    (ranges of code points). A conversation's windows stand together and in order in one partition."""

    names = ["conv_id", "turn", "role", "text"]

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                roles, texts = ([x or "" for x in part.column(c).to_pylist()] for c in ("role", "text"))
                turns = [f"{START}{_role(r)}\n{escape(t)}{END}" for r, t in zip(roles, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter.count_column(pa.array(turns, pa.string())))], [*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, rows, size = None, None, [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                roles, texts = ([x or "" for x in part.column(c).to_pylist()] for c in ("role", "text"))
                heads = [f"{START}{_role(r)}\n" for r in roles]
                turns = [f"{h}{escape(t)}{END}" for h, t in zip(heads, texts)]
                sizes = part.column("n").to_pylist()
                for c, role, head, turn, n in zip(part.column("conv_id").to_pylist(), roles, heads, turns, sizes):
                    if state is None or c != conv:
                        found = [(conv, *w) for w in state.close()] if state else []
                        state, conv = _Windows(budget, history), c
                    else:
                        found = []
                    found += [(c, *w) for w in state.add(role, (turn, n, len(head) if role == "assistant" else None))]
                    rows += found
                    size += sum(len(r[4]) for r in found)
                    if size > BATCH_CHARS:
                        yield batch_of(rows)
                        rows, size = [], 0
        if state:
            rows += [(conv, *w) for w in state.close()]
        if rows:
            yield batch_of(rows)

    turns = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    turns = turns.mapInArrow(sized, "conv_id bigint, turn bigint, role string, text string, n bigint")
    turns = turns.repartition("conv_id").sortWithinPartitions(*names)
    return turns.mapInArrow(run, WINDOW)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window."""
    pairs = (part.split("\n", 1) for part in text.split(START)[1:])
    return [(_role_back(role), unescape(rest[: -len(END)])) for role, rest in pairs]


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of ``windows`` say, read back from their text and masks, a row per conversation.

    It needs each conversation's windows together and in order, as ``windows`` leaves them.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> dict:
            n, turns, chars, loss, formatted, n_windows = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted, "n_windows": n_windows}

        fields = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, 256):
                for w in batch.slice(start, 256).to_pylist():
                    if state is None or w["window_no"] == 0:
                        if state:
                            rows.append(row())
                        conv, state = w["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, text in read_turns(w["text"])[w["n_repeated"] :]:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    for span in w["loss"]:
                        said = unescape(w["text"][span["start"] : span["end"]])
                        state[2] += len(said)
                        state[3].update(said.encode())
                    state[4] += len(w["text"])
                    state[5] += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, fields)
        if state:
            yield pa.RecordBatch.from_pylist([row()], fields)

    return formatted.mapInArrow(run, schema)
