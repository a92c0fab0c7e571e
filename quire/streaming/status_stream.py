"""The status log as a stream: newest state by block, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import scratch


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of Parquet as a stream; its schema is read once from the data."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else _file_stream(spark, schema, folder, name)


def _file_stream(spark: SparkSession, schema, folder: str, name: str) -> DataFrame:
    """A single table: a glob that matches it whether it is a file or a folder of parts."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-8]}.parq*")


def latest_by_block(log: DataFrame, key: str, ts: str, seq: str, status: Column) -> DataFrame:
    """The streaming aggregate; the state is one row for each block."""
    # Plain timestamps have no zone and can't carry a watermark.
    rows = log.select(F.col(key).alias("block_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).alias("seq"), status.alias("status"))
    return rows.groupBy("block_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def latest_from_stream(spark: SparkSession, path: str, key: str, ts: str, seq: str, event: str, states: dict[str, str]) -> DataFrame:
    """Run the stream over what is there (AvailableNow) and return its final table.

    Every batch's complete result replaces the table of its epoch in the shared
    folder, so a batch that is retried after a failure writes the same rows again.
    """
    names = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    stream = latest_by_block(read_log(spark, path), key, ts, seq, names[F.col(event)])
    out, done = scratch(spark, "status-stream"), []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        done.append(epoch)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, "status-stream-state")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/epoch={max(done)}")


def windowed_counts(log: DataFrame, ts: str, status: Column, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Entries by status and hour; entries later than the watermark are dropped, closed windows are emitted once."""
    rows = log.select(F.col(ts).cast("timestamp").alias("ts"), status.alias("status")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
