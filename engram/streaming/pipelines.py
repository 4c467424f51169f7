"""Streams of turns, events and sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.functions import text as T
from engram.operators import capture, cloud

BUFFER_MESSAGES, BUFFER_CHARS = 24, 12_000


def proposals_of(turns: DataFrame) -> DataFrame:
    """What a batch of turns (turn_id, user_message) proposes, host markup taken off first; stateless, so it serves streams by foreachBatch."""
    return capture.proposals(turns.withColumn("user_message", T.sanitize("user_message")))


def capture_stream(turns: DataFrame, sink: Callable[[DataFrame, int], None]):
    """A stream writer that hands each micro-batch's proposals to ``sink``."""
    return turns.writeStream.foreachBatch(lambda batch, n: sink(proposals_of(batch), n))


def event_stream_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by time window and type; rows later than ``late`` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def session_buffers(messages: DataFrame, keep: int = BUFFER_MESSAGES, chars: int = BUFFER_CHARS) -> DataFrame:
    """Per session the latest messages of a stream (session_id, ord, role, content) as one text, cut to its last ``chars`` characters."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            for _, r in f.sort_values("ord").iterrows():
                held.append(f"{r['role']}: {r['content'].strip()}")
        held = held[-keep:]
        state.update((held,))
        yield pd.DataFrame({"session_id": [k[0]], "messages": [len(held)], "buffer": ["\n".join(held)[-chars:]]})

    return messages.groupBy("session_id").applyInPandasWithState(update, "session_id string, messages long, buffer string", "held array<string>", "update", GroupStateTimeout.NoTimeout)


def webhook_sink(post: Callable[[list[str]], None], kinds: set[str], rows: int = 500) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that posts events of these types as JSON, ``rows`` at a time, from the executors; delivery is at least once."""

    def send(rows_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in rows_:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), rows):
                post(texts[lo : lo + rows])
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["sent"])

    def sink(batch: DataFrame, _: int) -> None:
        asked = batch.filter(F.col("type").isin(*kinds)).select(F.to_json(F.struct(*batch.columns)).alias("json"))
        asked.mapInArrow(send, "sent long").agg(F.sum("sent")).collect()

    return sink


def flushed_sessions(messages: DataFrame, gap: str = "2 hours", late: str = "10 minutes", keep: int = BUFFER_MESSAGES, chars: int = BUFFER_CHARS) -> DataFrame:
    """Sessions of a stream (session_id, ts, ord, role, content) once nothing has come for ``gap``: session_id, messages, buffer (the latest, cut to their end)."""
    w = messages.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    line = F.struct("ord", F.concat("role", F.lit(": "), T.trim("content")).alias("line"))
    g = w.agg(F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform(F.slice(F.col("lines"), F.greatest(F.size("lines") - keep + 1, F.lit(1)), keep), lambda x: x.line), "\n")
    return g.select("session_id", "messages", F.when(F.length(text) > chars, F.substr(text, F.length(text) - chars + 1)).otherwise(text).alias("buffer"))


def sync_sink(read_local: Callable[[], DataFrame], write_local: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that applies a stream of remote records (with sync_version, updated_at and deleted_at) to the local ones: the newest version of an id counts."""

    def sink(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "sync_version").alias("r")).select("r.*")
        write_local(cloud.pull_applied(read_local(), newest, F.lit(-1)))

    return sink


def audit_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends events to Parquet; a batch written twice replaces itself."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
