"""Structured Streaming jobs: online scoring, bounded lookups, bursts, daily counts."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.analysis import investigate
from ..sources.store import write_verdicts


def run_to_end(writer, checkpoint: str) -> None:
    """Start a prepared writer, process what is there and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def score_messages(stream: DataFrame, feed: DataFrame, path: str, checkpoint: str) -> None:
    """Score messages as they arrive and write verdicts and findings per micro-batch.

    Rows carry their link candidates and files as arrays. A batch owns its
    folder, so a batch that is run again after a failure replaces itself. What
    is there at the start may be one large batch, so nothing of it is kept in
    the executors: each part reads its own columns from the source again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        links = batch.selectExpr("msg_id", "inline(candidates)")
        files = batch.selectExpr("msg_id", "inline(attachments)")
        scores = batch.select("msg_id", "probability", "threshold")
        messages = batch.drop("candidates", "attachments", "probability", "threshold")
        write_verdicts(investigate(messages, links, files, scores, feed), path, batch=str(batch_id))

    run_to_end(stream.writeStream.foreachBatch(handle), checkpoint)


def lookups_within(stream: DataFrame, time: str, keys: list, ttl_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """(keys, asked_at): a key is looked up when its last lookup is ``ttl_seconds`` old or there is none.

    State of a key: its last lookup, and the times that the watermark has not
    passed yet. An event-time timer wakes the key when the watermark passes the
    first of them; times are then decided in their order, so the answer does not
    depend on how the stream is cut into batches.
    """
    ttl = ttl_seconds * 1_000_000

    def decide(key, frames, state):
        last, waiting = state.get if state.exists else (None, [])
        times = set(waiting)
        for frame in frames:
            times.update(frame["_at"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        asked = []
        for at in sorted(t for t in times if t < mark):
            if last is None or at - last >= ttl:
                last = at
                asked.append(at)
        waiting = sorted(t for t in times if t >= mark)
        state.update((last, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0] // 1000, mark // 1000 + 1))
        elif mark > 0:
            state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, mark // 1000 + 1))  # nothing waits: forget the key once its answer is old
            if state.hasTimedOut and last + ttl < mark:
                state.remove()
        yield pd.DataFrame({**{k: [v] * len(asked) for k, v in zip(keys, key)}, "_at": pd.Series(asked, dtype="int64")})

    rows = stream.withWatermark(time, delay).select(*keys, time, F.unix_micros(time).alias("_at"))
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = rows.groupBy(*keys).applyInPandasWithState(
        decide, ", ".join([*(f"{k} {types[k]}" for k in keys), "_at bigint"]), "last bigint, waiting array<bigint>", "append", "EventTimeTimeout")
    return out.select(*keys, F.timestamp_micros("_at").alias("asked_at"))


def bursts(stream: DataFrame, time: str, client: str, more_than: int = 30, width: str = "1 minute", slide: str | None = None,
           delay: str = "1 minute") -> DataFrame:
    """Clients with more than so many events in a window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, delay).groupBy(w, client).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > more_than).select(F.col("window.start").alias("start"), client, "n")


def daily_counts(stream: DataFrame, time: str, column: str, delay: str = "1 day") -> DataFrame:
    """Counts per UTC day and value; days close once the watermark passes them."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), column).agg(F.count("*").alias("n")).select(
        F.to_date("window.start").alias("day"), column, "n")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream to a Parquet table."""
    run_to_end(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
