"""Queries on the processing state of blocks, with the event log as status log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import status
from quire.operators.votes import zero_filled
from quire.plans.registry import query
from quire.session import table
from quire.streaming import status_stream

STATES = {"view": "segmented", "click": "transcribing", "purchase": "transcribed", "signup": "queued", "error": "failed"}
_STATE = "CASE event_type WHEN 'view' THEN 'segmented' WHEN 'click' THEN 'transcribing' WHEN 'purchase' THEN 'transcribed' WHEN 'signup' THEN 'queued' ELSE 'failed' END"
_LOG = f"l AS (SELECT user_id AS block_id, ts, event_id AS seq, {_STATE} AS status FROM events), n AS (SELECT block_id, arg_max(status, (ts, seq)) AS status FROM l GROUP BY 1)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("block_id"), "ts", F.col("event_id").alias("seq"), names[F.col("event_type")].alias("status"))


@query(f"WITH {_LOG} SELECT * FROM n")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.current(_log(spark, sf_dir)).select("block_id", "status")


@query(f"WITH {_LOG}, s(status) AS (VALUES {', '.join(f'({x!r})' for x in status.STATUSES)}), c AS (SELECT status, count(*) AS n FROM n GROUP BY 1) SELECT s.status, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (status)")
def status_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by status, with every known status."""
    counts = status.current(_log(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))
    return zero_filled(counts, "status", "n", spark.createDataFrame([(s,) for s in status.STATUSES], "status string"))


@query(f"WITH {_LOG} SELECT block_id, count(*) AS attempts, epoch_us(max(ts)) AS last_us FROM l WHERE status = 'transcribing' GROUP BY 1")
def attempts_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = status.attempts(_log(spark, sf_dir))
    return out.select("block_id", "attempts", F.unix_micros(F.col("last_attempt").cast("timestamp")).alias("last_us"))


@query(f"WITH {_LOG} SELECT block_id, CASE WHEN status = 'transcribing' THEN 'queued' ELSE status END AS status FROM n")
def recover_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restart makes of blocks that were being worked on."""
    return status.recovered(status.current(_log(spark, sf_dir))).select("block_id", "status")


@query(f"WITH {_LOG} SELECT block_id, status FROM n WHERE status IN ('segmented', 'queued', 'failed') ORDER BY block_id LIMIT 25")
def runnable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 blocks to run: the limit is the operator's maximum."""
    return status.runnable(status.current(_log(spark, sf_dir)), ["block_id"], most=25).select("block_id", "status")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.role = 'assistant' AND NOT starts_with(d.text, 'Th'))")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without output, or whose output is a placeholder."""
    pages = table(spark, sf_dir, "conversations")
    return status.pending(pages.select("conv_id", "turn"), pages.where("role = 'assistant'").select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", "Th")


@query(f"WITH {_LOG} SELECT * FROM n")
def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of each block, from the log read as a stream."""
    return status_stream.latest_from_stream(spark, f"{sf_dir}/events.parquet", "user_id", "ts", "event_id", "event_type", STATES)
