"""The rules for single records on a stream of catalog files: a projection, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from segmill.operators import qa


def findings(stream: DataFrame, policy: qa.Policy = qa.Policy()) -> DataFrame:  # noqa: B008
    """Findings of a streaming DataFrame ``(row_idx, segment_id, source, target)``.

    The comparison of records with each other isn't among them: it needs all records.
    """
    return qa.record_findings(stream, policy)


def watch(stream: DataFrame, output: str, checkpoint: str, policy: qa.Policy = qa.Policy()) -> StreamingQuery:  # noqa: B008
    """Write the findings of all records available as Parquet, each once, and end."""
    return findings(stream, policy).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)
