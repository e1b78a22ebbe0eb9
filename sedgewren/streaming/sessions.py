"""Sessions of streamed client frames, with state that expires.

State is kept for each session with a time to live that every write renews; a close frame, or two missed heartbeat windows,
ends a session. Queries with a bounded run need ``spark.sql.streaming.noDataMicroBatches.enabled=false`` and the RocksDB state
store; ``configure`` sets both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HISTORY = "pos int, role string, content string"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


#: Ordered progress markers of a question.
STAGES = ("received", "routed", "retrieved", "answered")


class SessionProcessor(StatefulProcessor):
    """Emits (session_id, seq, event, text) of a session's frames.

    ``question`` frames come out with their number, ``get`` frames give the kept messages as ``history`` rows, ``delete`` and
    ``close`` frames end the conversation (``deleted``, ``closed``). Blank questions and other frames give nothing.
    """

    def __init__(self, ttl_ms: int = 1_800_000, most: int = 40):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n int", self.ttl_ms)
        self.history = handle.getListState("history", HISTORY, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        kept = [tuple(x) for x in self.history.get()] if self.history.exists() else []
        out = []
        for part in rows:
            for kind, text in zip(part["type"], part["text"]):
                if kind == "question" and isinstance(text, str) and text.strip():
                    n += 1
                    kept = [*kept, (n, "user", text)][-self.most :]
                    out.append((key[0], n, "question", text))
                elif kind == "get":
                    out += [(key[0], pos, "history", said) for pos, _, said in kept]
                elif kind in ("close", "delete"):
                    out.append((key[0], n, "closed" if kind == "close" else "deleted", None))
                    n, kept = 0, []
        if n:
            self.count.update((n,))
            self.history.put(kept)
        else:
            self.count.clear()
            self.history.clear()
        yield pd.DataFrame(out, columns=["session_id", "seq", "event", "text"])

    def close(self) -> None:
        pass


def session_events(frames: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """Stateful stream of session events from frames (session_id, type, text)."""
    return frames.groupBy("session_id").transformWithStateInPandas(SessionProcessor(ttl_ms), outputStructType="session_id string, seq int, event string, text string", outputMode="append", timeMode="processingTime")


def with_session_id(frames: DataFrame, name: str = "session_id") -> DataFrame:
    """Frames of one new connection under an id of their own: 16 hexadecimal digits, drawn once for the frame as a whole."""
    import uuid

    return frames.withColumn(name, F.lit(uuid.uuid4().hex[:16]))


def stamped(rows: DataFrame, name: str = "created_at") -> DataFrame:
    """Rows whose NULL (or missing) time is the time of processing."""
    now = F.current_timestamp()
    return rows.withColumn(name, F.coalesce(F.col(name).cast("timestamp"), now) if name in rows.columns else now)


def stage_events(events: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(session_id, seq, step, stage): the ordered progress markers of every question event, as side rows."""
    marks = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage")) for i, s in enumerate(stages)])
    return events.where("event = 'question'").select("session_id", "seq", F.explode(marks).alias("m")).select("session_id", "seq", "m.step", "m.stage")


def client_frames(deltas: DataFrame) -> DataFrame:
    """(session_id, value) JSON frames of emitted pieces (session_id, seq, delta, status, error)."""
    kind = F.when(F.col("status") == "error", "error").when(F.col("status") == "ok", "end").otherwise("delta")
    return deltas.select("session_id", F.to_json(F.struct(kind.alias("type"), "seq", F.col("delta").alias("text"), "error")).alias("value"))


def client_sink(frames: DataFrame, path: str, checkpoint: str, on_batch: Callable[[int], None] | None = None):
    """A started query that writes each micro-batch of frames below ``path/batch=N``.

    A batch that is run again after a failure overwrites itself, so every frame is there once. ``on_batch`` is called on
    the driver with the number of each written batch.
    """

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").json(f"{path}/batch={number}")
        if on_batch:
            on_batch(number)

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeat(frames: DataFrame, session: str = "session_id", at: str = "ts", window_s: int = 60, missed: int = 2) -> DataFrame:
    """Batch form of liveness: (session, last_seen, closed_at) of sessions silent for ``missed`` whole windows, per gap."""
    from pyspark.sql import Window

    t = F.col(at).cast("timestamp")
    w = Window.partitionBy(session).orderBy(t)
    gap = frames.select(session, t.alias("last_seen"), F.lead(t).over(w).alias("next"))
    late = gap.where(F.col("next").cast("double") - F.col("last_seen").cast("double") > window_s * missed)
    return late.select(session, "last_seen", F.timestamp_seconds(F.col("last_seen").cast("double") + window_s * missed).alias("closed_at"))


def run_bounded(stream: DataFrame, name: str, checkpoint: str, seconds: int = 120) -> None:
    """Run a stream over what is available into a memory table and stop it, at the latest after ``seconds``."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination(seconds)
    finally:
        q.stop()


def committed(answers: DataFrame, status: str = "status") -> DataFrame:
    """Rows that may be stored: only complete answers that are not errors or lacks of context."""
    return answers.where((F.col(status) == "ok") & (F.length(F.trim("answer")) > 0))
