"""Processing state of blocks as an append-only log: (block_id, ts, seq, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every status, in the order of the life of a block.
STATUSES = ("pending", "segmented", "queued", "transcribing", "transcribed", "verified", "fallback_image", "failed")
RUNNABLE = ("segmented", "queued", "failed")
DONE = ("transcribed", "fallback_image")
#: Which status may follow which.
NEXT = {
    "pending": ("segmented",), "segmented": ("queued", "transcribing"), "queued": ("transcribing",),
    "transcribing": ("transcribed", "fallback_image", "failed", "queued"), "failed": ("queued", "transcribing"),
    "transcribed": ("verified", "transcribing"), "fallback_image": ("transcribing",), "verified": (),
}


def current(log: DataFrame) -> DataFrame:
    """The newest entry of each block; of equal times the larger seq."""
    return log.groupBy("block_id").agg(F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("s")).select("block_id", "s.*")


def attempts(log: DataFrame) -> DataFrame:
    return log.where("status = 'transcribing'").groupBy("block_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_attempt"))


def recovered(now: DataFrame) -> DataFrame:
    """At a restart, blocks that were being worked on are queued again."""
    return now.withColumn("status", F.when(F.col("status") == "transcribing", "queued").otherwise(F.col("status")))


def runnable(now: DataFrame, order: list[str], overwrite: bool = False, most: int | None = None) -> DataFrame:
    """Blocks to run, in order, at most ``most``."""
    rows = now if overwrite else now.where(F.col("status").isin(*RUNNABLE))
    return rows.orderBy(*order).limit(most) if most is not None else rows.orderBy(*order)


def succeeded(now: DataFrame) -> DataFrame:
    return now.where(F.col("status").isin(*DONE))


def pending(pages: DataFrame, outputs: DataFrame, keys: list[str], text: str, placeholder: str) -> DataFrame:
    """Pages without output, or with the placeholder as output."""
    done = outputs.where(~F.startswith(F.coalesce(text, F.lit(placeholder)), F.lit(placeholder))).select(*keys)
    return pages.join(done, keys, "left_anti")


def transitions(log: DataFrame) -> DataFrame:
    """Each entry with the one before and whether it may follow it."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy("block_id").orderBy("ts", "seq"))
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rows = log.withColumn("before", before)
    return rows.withColumn("allowed", F.when(F.col("before").isNull(), True).otherwise(F.array_contains(F.coalesce(allowed[F.col("before")], F.array().cast("array<string>")), F.col("status"))))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` replaced by the rows of ``changes`` with the same key; new keys are added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)
