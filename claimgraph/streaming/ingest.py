"""Canonical records from a stream of JSON text: the batch expressions, which keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import encode_table
from ..functions.schema import Schema


def canonical_stream(stream: DataFrame, column: str, schema: Schema, event_time: str | None = None, delay: str = "10 minutes", **options) -> DataFrame:
    """encode_table over a stream; with event_time, each content id once within the delay, valid records only."""
    rows = encode_table(stream, column, schema, **options)
    if event_time is None:
        return rows
    return rows.where(F.col("error").isNull()).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["cid"])
