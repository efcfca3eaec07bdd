"""Progress events of a run: an append-only log, a stream over it, and the last event per key."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "seq long, type string, payload string"


class Progress:
    """Events in order; ``listener`` gets each as it happens."""

    def __init__(self, listener: Callable[[dict], None] | None = None):
        self.events: list[dict] = []
        self.listener = listener

    def emit(self, kind: str, **payload) -> None:
        event = {"seq": len(self.events), "type": kind, "payload": json.dumps(payload, sort_keys=True, default=str), "at": time.time()}
        self.events.append(event)
        if self.listener:
            self.listener(event)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e["seq"], e["type"], e["payload"]) for e in self.events], EVENTS)


def sse(kind: str, payload: str) -> str:
    """One server-sent event."""
    return f"event: {kind}\ndata: {payload}\n\n"


def parse_sse(text: str) -> list[tuple[str, str]]:
    """Events of a stream of frames: kind and data."""
    out = []
    for frame in re.split(r"\r?\n\r?\n", text):
        kind, data = re.search(r"^event:\s*(.*)$", frame, re.M), re.findall(r"^data:\s?(.*)$", frame, re.M)
        if data:
            out.append((kind[1] if kind else "message", "\n".join(data)))
    return out


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame over a folder to which event files are added."""
    return spark.readStream.schema(EVENTS).json(folder)


def last_by_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of every key. Partial aggregation keeps one row per key and task to shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def last_by_key_stream(events: DataFrame, key: str, order: str, sink: str):
    """Keep the last event per key from a stream, as a log of changes that read_last() resolves.

    The state store holds a row per key, spread over the cluster by key; a micro-batch shuffles its own events only and writes
    only the keys that changed, to a folder named by its number, so a batch that is run again overwrites its own result.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return last_by_key(events, key, order).writeStream.outputMode("update").foreachBatch(merge)


def read_last(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """The last event of every key by what last_by_key_stream() has written so far: the latest change of each key."""
    return last_by_key(spark.read.parquet(sink), key, "batch").drop("batch")
