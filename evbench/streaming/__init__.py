"""Streaming forms of stateless operators.

The inventory has no streaming operators.  Validation, key derivation and classification are Column functions, so they
apply to streams unchanged; `quarantine_stream` routes an unbounded evidence stream into two sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import route, validate


def quarantine_stream(rows: DataFrame, sequences: DataFrame, ident: str, residue: str, position: str, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Write valid rows to `good` and others, with their reasons, to `bad`; sequences is a static table."""

    def batch(df: DataFrame, _: int) -> None:
        checked = validate(df, sequences, ident, residue, position).persist()
        valid, rejected = route(checked)
        valid.write.mode("append").parquet(good)
        rejected.write.mode("append").parquet(bad)
        checked.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
