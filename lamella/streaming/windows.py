"""Transforms that run on batches and streams alike, and stateful stream operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and cents by window and type; a stream closes a window once the watermark has passed it."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = events.groupBy(F.window(F.col("ts").cast("timestamp") if not events.isStreaming else F.col("ts"), length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "cents")


def generation_stream(work: DataFrame, session: str, generation: str, payload: str) -> DataFrame:
    """Stream of (session, generation, payload, decision): work under a generation older than its session's newest is dropped as stale."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -(1 << 62)
        for pdf in batches:
            out = []
            for g, p in zip(pdf[generation], pdf[payload], strict=True):
                newest = max(newest, int(g))
                out.append((key[0], int(g), p, "publish" if g >= newest else "discard-stale"))
            yield pd.DataFrame(out, columns=["session", "generation", "payload", "decision"])
        state.update((newest,))

    rows = work.select(session, generation, payload)
    return rows.groupBy(session).applyInPandasWithState(run, "session long, generation long, payload string, decision string", "newest long", "append", "NoTimeout")
