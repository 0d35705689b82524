"""Questions answered as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from adlens.operators.messages import answer_messages
from adlens.schema import KEYS


def start_answers(
    messages: DataFrame, facts: DataFrame, path: str, checkpoint: str,
    keys: Sequence[str] = KEYS, by: str = "message_id",
) -> StreamingQuery:
    """Answer all waiting messages into parquet files, then stop. ``facts`` is a batch table, read
    anew for every batch; no state is kept between messages."""
    return (
        answer_messages(messages, facts, keys, by)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
