"""Fill-in-middle: texts cut at two line ends into prefix, middle and suffix, and put together anew around sentinels.

One match of ``(unit)*`` over a whole text keeps the end of every repetition, so the number of units and any cut are read from it.
Cuts and forms come from a digest of the seed and the row's id: reruns agree, and rows of one id are cut alike. A text that holds
a sentinel stays plain, so every output leads back to its text.

Each text is cut alone: no shuffle; memory of one batch of texts and of the ends of one text's units. A null text counts as empty
and stays plain; a null id is hashed as an empty one; other columns are kept, but one named ``fim`` is replaced; an empty table
gives no rows. Texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.llm.rows import packed, row_field, spread

#: A line with its end, or what is left. Possessive, as no match ever needs less.
LINES = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<[PSM]>"
FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())]
DDL = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def cut(text: str, draws: list[int], units: regex.Pattern, percent: int, spm_percent: int) -> tuple:
    """One text: n, form, prefix_chars, middle_chars, output."""
    ends = [0, *units.fullmatch(text).ends(1)]
    n = len(ends) - 1
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted(ends[h % (n + 1)] for h in draws[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int, percent: int = 100, spm_percent: int = 50, unit: str = LINES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``fim``: n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    percent: of the texts that may be cut, how many are. unit: a pattern without groups whose repetitions make up any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(rf"({unit})*+")
        for batch in batches:
            rows = zip(batch.column("row").field(text), batch.column("digest").to_pylist())
            found = [cut(t.as_py() or "", [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)], units, percent, spm_percent) for t, digest in rows]
            columns = [pa.array([row[i] for row in found], kind) for i, (_, kind) in enumerate(FIELDS)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(columns, [name for name, _ in FIELDS])], ["row", "fim"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    schema = T.StructType([row_field(docs), T.StructField("fim", T.StructType.fromDDL(DDL))])
    return spread(packed(docs, digest=digest).mapInArrow(run, schema), docs, fim=F.col("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of: its parts stand between sentinels, which no part holds."""
    part = F.split(output, SENTINELS, -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
