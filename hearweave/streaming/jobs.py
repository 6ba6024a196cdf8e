"""The review jobs as streams: each takes a streaming DataFrame and returns one, or starts a query."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearweave.operators import aggregates as A
from hearweave.operators import joins as J
from hearweave.operators import maintenance as M


def live_statistics(outcomes: DataFrame) -> DataFrame:
    """Running signed counts by service and bucket; -1 takes back what +1 counted. State is as large as
    the services and buckets are many."""
    return A.outcome_counters(outcomes)


def windowed_outcomes(outcomes: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Corrected and confirmed outcomes by time window; edits later than the watermark are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = outcomes.withWatermark("ts", late).groupBy(span.alias("w"), "provider").agg(F.count("*").alias("n"), F.count_if("corrected").alias("n_corrected"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "provider", "n", "n_corrected")


def utterances(words: DataFrame, gap: str = "600 milliseconds", late: str = "10 minutes", keys: tuple[str, ...] = ("recording",)) -> DataFrame:
    """Words closer than gap in one utterance, by session windows."""
    s = words.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("first"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def first_responses(responses: DataFrame, keys: tuple[str, ...] = ("recording", "provider", "request"), late: str = "1 hour") -> DataFrame:
    """The first of repeated responses; keys are forgotten after the watermark."""
    return responses.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def newest_rules(decisions: DataFrame) -> DataFrame:
    """folder, form, language, replacement, decided_at whenever a newer decision replaces a rule; an empty
    replacement takes it away. State is one rule for each key."""
    out = "folder string, form string, language string, replacement string, decided_at long"

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else -(1 << 62)
        best = None
        for pdf in frames:
            row = pdf.sort_values("decided_at").iloc[-1]
            if row["decided_at"] > was:
                was, best = int(row["decided_at"]), row["replacement"]
        if best is not None:
            state.update((was,))
            yield pd.DataFrame([(*key, best, was)], columns=["folder", "form", "language", "replacement", "decided_at"])

    return decisions.groupBy("folder", "form", "language").applyInPandasWithState(latest, out, "decided_at long", "update", GroupStateTimeout.NoTimeout)


def intake(words: DataFrame, rules: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Answers or queues the words of new recordings as their files arrive. Each file is read once; the
    checkpoint stands for the table of marks. write gets each batch's actions and must be idempotent by
    batch number, as with replace()."""

    def batch(df: DataFrame, number: int) -> None:
        none = df.sparkSession.createDataFrame([], "recording long")
        write(J.apply_rules(df, rules, none), number)

    return words.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to its own folder under path, over what a failed try left."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    return M.replace_recordings(old, new, new)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote to folder. For complete mode the last
    batch counts."""
    spark, name = stream.sparkSession, uuid.uuid4().hex
    path, marks = f"{folder.rstrip('/')}/streams/{name}/out", f"{folder.rstrip('/')}/streams/{name}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
