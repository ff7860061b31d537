"""Structured Streaming: daily metrics with late data, ingest without repeats, mirrored requests, batch sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import in_sample
from ..sources.records import MetricStore


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_counts(events: DataFrame, ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """(date, event_type, n, mean): daily tumbling windows; rows later than ``lateness`` are dropped by the watermark."""
    x = events.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return x.select(F.col("window.start").cast("date").alias("date"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", ts: str = "ts", user: str = "user_id") -> DataFrame:
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_ingest(events: DataFrame, key: str = "event_id", ts: str = "ts", lateness: str = "2 days") -> DataFrame:
    """Each key once, with state bounded by the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def mirrored(requests: DataFrame, reply, rate: float, key: str = "user", prompt: str = "prompt", salt: str = "shadow") -> DataFrame:
    """The sampled requests with the second model's answer (an Arrow UDF); the others never reach it."""
    return requests.where(in_sample(F.coalesce(F.nullif(F.col(key), F.lit("")), F.col("request_id")), rate, salt)).withColumn("shadow", reply(F.col(prompt)))


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Processes all that is there and ends; run again it goes on where it stopped."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def store_sink(store: MetricStore, table: str) -> Callable[[DataFrame, int], None]:
    """Idempotent: a batch that is run again replaces the same days."""
    return lambda batch, _: store.save(table, batch)


def alert_sink(path: str, say: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Alerts as JSON lines per batch; ``say`` gets one line per alert, at most 100 a batch (a webhook's payload, for instance)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")
        if say:
            for r in batch.limit(100).collect():
                say(" ".join(str(v) for v in r))

    return write
