"""Messages as streams: keyed deduplication by stored keys in each batch, or by keyed state within a lookback; a retry adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sinks import store_new
from ..sources.landing import read_lines
from ..sources.messages import normalized


def _started(stream: DataFrame, step, checkpoint: str, interval: str | None) -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def store_messages(stream: DataFrame, target: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends new messages (account_id, message_id, seq, ...) to the Parquet table `target`; every five minutes with interval '5 minutes', else until the input ends.

    A batch is written to its own folder (batch=<id>) by overwriting, so its repetition after
    a failure replaces it; it reads the stored buckets that its own keys fall into.
    """

    def step(batch: DataFrame, number: int) -> None:
        store_new(batch, target, ["account_id", "message_id"], number)

    return _started(stream, step, checkpoint, interval)


def _lines(spark: SparkSession, folder: str, files: int | None, account: Column | None) -> DataFrame:
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    rows = read_lines(reader.text(folder))
    return rows if account is None else rows.withColumn("account_id", account)


def landing_messages(spark: SparkSession, folder: str, hours: int = 24, files: int | None = None, account: Column | None = None) -> DataFrame:
    """Normalised messages of a landing folder as a stream, each (account_id, message_id) once within the lookback.

    The stream's state store keeps the keys seen, each until the newest instant seen is
    `hours` past its own: so the state holds one lookback of keys however long the stream
    runs, and no stored message is read. Messages older than that are late and left out, as
    a lookback search would leave them out. `files` bounds the files of a batch. The account
    is a folder of the landing folder (account_id=...), or given.
    """
    rows = _lines(spark, folder, files, account).where("reason is null")
    messages = normalized(rows, "account_id").where("received_at is not null")
    return messages.withWatermark("received_at", f"{hours} hours").dropDuplicatesWithinWatermark(["account_id", "message_id"])


def landing_rejects(spark: SparkSession, folder: str, files: int | None = None, account: Column | None = None) -> DataFrame:
    """(account_id, file, line, reason) of a landing folder's unreadable lines, as a stream."""
    return _lines(spark, folder, files, account).where("reason is not null").select("account_id", "file", "line", "reason")


def append(stream: DataFrame, target: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes a stream whose rows are new by themselves, a batch to its own folder (batch=<id>) by overwriting; nothing stored is read."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _started(stream, step, checkpoint, interval)
