"""Incremental sync as Structured Streaming: change feeds, idempotence, late data, keyed state and resumable runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Labels whose change means something.
SEMANTIC_LABELS = ("DRAFT", "SENT", "SPAM", "TRASH")


def stream_changes(src: DataFrame, labels: Sequence[str] = SEMANTIC_LABELS) -> DataFrame:
    """Change feed (kind, labels, ...) with relevant: additions, deletions, and label changes of a label that counts."""
    counts = F.arrays_overlap("labels", F.array(*map(F.lit, labels)))
    return src.withColumn("relevant", F.col("kind").isin("added", "deleted") | (F.col("kind").isin("labels_added", "labels_removed") & F.coalesce(counts, F.lit(False))))


def stream_dedup(src: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row of each key; state is kept for `delay` of event time."""
    return src.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def run_incremental(src: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Process what is there and stop. The cursor moves only after sink has returned, so sink must be idempotent in
    its batch number; a lost checkpoint means a full rescan."""
    return src.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that replaces a batch's own folder, and so may run again."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


#: Values of a sink's dividing column in one batch up to which only their folders are read.
MAX_FOLDERS = 2_000


def keyed_sink(path: str, keys: Sequence[str], by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that adds the rows whose keys the table at path lacks: it may run again after a failure or a full rescan.

    by: a column that a key never changes, such as the day of an event. The table is then divided into a folder for each of
    its values, and a batch reads only the folders it touches; without it, or beyond MAX_FOLDERS of them, all keys are read.
    """

    def add(batch: DataFrame, number: int) -> None:
        writer = (lambda df: df.write.partitionBy(by)) if by else (lambda df: df.write)
        writer(batch.limit(0)).mode("ignore").parquet(path)
        have = batch.sparkSession.read.schema(batch.schema).parquet(path)
        if by:
            touched = [r[0] for r in batch.select(by).distinct().limit(MAX_FOLDERS + 1).collect()]  # bounded
            if len(touched) <= MAX_FOLDERS:
                known = [v for v in touched if v is not None]
                have = have.where(F.col(by).isin(known) | F.col(by).isNull() if len(known) < len(touched) else F.col(by).isin(known))
        writer(batch.dropDuplicates(list(keys)).join(have.select(*keys), list(keys), "left_anti").select(*batch.columns)).mode("append").parquet(path)

    return add


def rescan(src: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Read everything again under a fresh cursor beside the expired one. sink must know what it has, as keyed_sink does."""
    return run_incremental(src, f"{checkpoint}-{uuid.uuid4().hex}", sink, mode)


def apply_late_guard(batch: DataFrame, state: DataFrame) -> DataFrame:
    """T4: batch (key, event_at) with applied; events older than the key's decision (key, decided_at) are logged only."""
    decided = state.groupBy("key").agg(F.max("decided_at").alias("_d"))
    met = batch.join(decided, "key", "left")
    return met.withColumn("applied", F.col("_d").isNull() | (F.col("event_at") >= F.col("_d"))).drop("_d")


def stream_failure_streaks(src: DataFrame, threshold: int, healthy: Sequence[str] = ("reachable", "empty")) -> DataFrame:
    """(company, streak, alert) whenever a company's rows (company, at, status) arrive; a healthy row resets it.

    Rows of one batch may come in any order; a batch is taken to be later than the ones before. Of a batch, a task only
    keeps the places of a company's failures after its last healthy row.
    """

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, last, failed = state.get[0] if state.exists else 0, None, pd.Series(dtype="int64")
        for part in rows:
            good = part["status"].isin(list(healthy))
            ok = part.loc[good, "at"].max() if good.any() else None
            last = ok if last is None else last if ok is None else max(last, ok)
            failed = pd.concat([failed, part.loc[~good, "at"]]) if len(failed) else part.loc[~good, "at"]
            failed = failed if last is None else failed[failed > last]
        streak = len(failed) + (streak if last is None else 0)
        state.update((streak,))
        yield pd.DataFrame({"company": [key[0]], "streak": [streak], "alert": [streak >= threshold]})

    kind = src.schema["company"].dataType.simpleString()
    return src.groupBy("company").applyInPandasWithState(fold, f"company {kind}, streak long, alert boolean", "streak long", "update", GroupStateTimeout.NoTimeout)


def stream_threads(src: DataFrame, rank: Sequence[str], final: Sequence[str]) -> DataFrame:
    """(thread_id, status, n_messages, unavailable) whenever a thread's messages (thread_id, at, kind, removed)
    arrive. Its status moves forward in rank only and never on from a final one; removed messages stay as evidence.

    Rows are put in order of at within a batch; a batch is taken to be later than the ones before. A task holds what one
    batch has of one thread: bound batches by the source's maxFilesPerTrigger.
    """
    order = {k: i for i, k in enumerate(rank)}

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, gone = state.get if state.exists else (None, 0, 0)
        for r in pd.concat(rows).sort_values("at").itertuples():
            if r.removed:
                gone += 1
                continue
            n += 1
            if r.kind in order and status not in final and (status is None or order[r.kind] >= order[status]):
                status = r.kind
        state.update((status, n, gone))
        yield pd.DataFrame({"thread_id": [key[0]], "status": [status], "n_messages": [n], "unavailable": [gone]})

    kind = src.schema["thread_id"].dataType.simpleString()
    return src.groupBy("thread_id").applyInPandasWithState(
        fold, f"thread_id {kind}, status string, n_messages long, unavailable long", "status string, n long, gone long", "update", GroupStateTimeout.NoTimeout
    )


def backfill_windows(spark: SparkSession, start: str, end: str, overlap_days: int = 7) -> DataFrame:
    """Calendar months from start (less the overlap) to end as (window_start, window_end), both included."""
    first = F.date_sub(F.lit(start).cast("date"), overlap_days)
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(first, "month"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.select(F.greatest("m", first).alias("window_start"), F.least(F.last_day("m"), F.lit(end).cast("date")).alias("window_end"))


def prune_by_bound(src: DataFrame, at: str, bound: str, margin_days: int) -> DataFrame:
    """Rows not entirely past the bound; a plain comparison, which reaches the source's statistics."""
    return src.where(F.col(at) >= F.date_sub(F.lit(bound).cast("date"), margin_days))


def flag_out_of_window(events: DataFrame, bound: str) -> DataFrame:
    """(key, needs_review): do all events of a key come before the approved window?"""
    return events.groupBy("key").agg((F.max("event_at") < F.lit(bound).cast("timestamp")).alias("needs_review"))


def soft_delete(messages: DataFrame, removed: DataFrame) -> DataFrame:
    """T6, in batch: messages with unavailable; removed ones stay as evidence."""
    gone = removed.select("message_id").distinct().withColumn("_g", F.lit(True))
    return messages.join(gone, "message_id", "left").withColumn("unavailable", F.coalesce("_g", F.lit(False))).drop("_g")
