"""Judgement drafts as they arrive: accepted ones become requirement rows, the others go to quarantine with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fitloom.operators import validation


def accept(drafts: DataFrame, accepted: str, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query over a stream of (analysis_id, raw_json). Validation is row by row, so no state is kept; each batch writes
    into a folder of its number, so a batch that is repeated after a failure replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        judged = validation.validate(batch).persist()
        validation.requirements_of(judged).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        judged.filter("reason is not null").select("analysis_id", "reason").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        judged.unpersist()

    return drafts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
