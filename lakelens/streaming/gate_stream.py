"""Streaming front ends: reports as they arrive become decisions, decisions become trends."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakelens.operators import gate

REPORTS = "request_id long, project_id string, sha string, sarif string, policy string, received_at timestamp"


def report_stream(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """Reports from files that arrive in a folder."""
    return spark.readStream.schema(REPORTS).format(fmt).load(folder)


def decision_stream(reports: DataFrame, log: str, checkpoint: str, policy: gate.Policy | None = None, available_now: bool = True) -> StreamingQuery:
    """Append the decisions of every micro-batch to the log.

    Rows carry the stream's and the batch's id, so a batch repeated after a failure finds its own rows and is not logged
    twice; no other record of it is kept.
    """
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        gate.append_decisions(gate.decide(batch, policy), log, f"{stream}-{number}")

    writer = reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def trends(decisions: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Runs, failures and findings per project and window; works on a stream of decisions (with a watermark) and on a table."""
    marked = decisions.withWatermark("ts", late) if decisions.isStreaming else decisions
    grouped = marked.groupBy(F.window("ts", width), "project_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("state") == "failed").alias("failed"), F.sum("blocking").alias("blocking"), F.sum("warnings").alias("warnings")
    )
    return grouped.select(F.col("window.start").alias("start"), "project_id", "runs", "failed", "blocking", "warnings")
