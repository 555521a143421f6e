"""The log, status and statistics operators as Structured Streaming jobs over files that keep arriving."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from volspark.operators.logs import ERROR_WORDS, HARMLESS, is_error
from volspark.operators.regions import SUBJECT, region_partials


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def live_errors(lines: DataFrame, words: Sequence[str] = ERROR_WORDS, harmless: Sequence[str] = HARMLESS) -> DataFrame:
    """Failing lines as they arrive; no state."""
    return lines.filter(is_error("line", words, harmless))


def live_counters(status: DataFrame, delay: str = "1 hour", width: str = "1 day", failed: str = "error") -> DataFrame:
    """Rows and failures per time window and stage (``ts, stage, state``)."""
    marked = status.withWatermark("ts", delay)
    return marked.groupBy(F.window("ts", width).alias("w"), "stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == failed).alias("n_failed")
    )


def once_only(status: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Drop repeats that arrive within the delay of the first."""
    return status.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


_STAGE_OUT = "named boolean, subject_id long, event_id long, stage string, duration_s double, finished boolean"
# Arrow tables of the open stage of every subject, and of the starts that the watermark has not passed yet.
_STAGE_STATE = "open binary, waiting binary"
_STARTS = pa.schema([("named", pa.bool_()), (SUBJECT, pa.int64()), ("event_id", pa.int64()), ("stage", pa.string()), ("us", pa.int64())])
# Groups of subjects that share a row of the state, unless the caller knows better; see :func:`live_durations`.
STAGE_GROUPS = 1024


# The time of a marker row, which is no start.
_MARK = -(1 << 63)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STARTS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _close_stages(opened: pa.Table, waiting: pa.Table, passed: int, timeout_ms: int) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Table, pa.Table, int | None]:
    """Take the starts before ``passed`` (milliseconds) in order: closed stages, their seconds (NaN when timed out), whether
    they are finished, then the open stages and waiting starts that are left and the time at which the next is due."""
    late = waiting.column("us").to_numpy() // 1000 >= passed
    ready, waiting = waiting.filter(pa.array(~late)), waiting.filter(pa.array(late))
    rows = pa.concat_tables([opened, ready])
    fresh = np.arange(len(rows)) >= len(opened)  # an open stage comes before the starts of its subject

    def columns(of: pa.Table) -> list[np.ndarray]:
        return [of.column(c).to_numpy() for c in ("us", "event_id", SUBJECT, "named")]

    us, event, subject, named = columns(rows)
    order = np.lexsort((event, us, fresh, subject, named))
    us, subject, named, fresh = us[order], subject[order], named[order], fresh[order]
    first = np.ones(len(us), bool)
    first[1:] = (subject[1:] != subject[:-1]) | (named[1:] != named[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(us)), 0))
    # later than the delay: its place in the order has been given out
    kept = ~(fresh & ~fresh[head] & (us < us[head]))
    order, us, first = order[kept], us[kept], first[kept]
    last = np.append(first[1:], True)[: len(us)]
    seconds = np.append(np.diff(us) / 1e6, 0.0)[: len(us)]
    rows, until = rows.take(pa.array(order)), us // 1000 + timeout_ms
    # of the last stages of their subjects, those without a waiting start may time out
    still = set(zip(*(waiting.column(c).to_pylist() for c in (SUBJECT, "named")), strict=True))
    ends = np.flatnonzero(last)
    free = np.array([k not in still for k in zip(*(rows.column(c).take(pa.array(ends)).to_pylist() for c in (SUBJECT, "named")), strict=True)], bool)
    over = np.zeros(len(us), bool)
    over[ends[free]] = until[ends[free]] < passed
    closed = ~last | over
    due = [*until[ends[free & ~over[ends]]], *waiting.column("us").to_numpy() // 1000]
    done = rows.filter(pa.array(closed)), np.where(over, np.nan, seconds)[closed], ~over[closed]
    return *done, rows.filter(pa.array(last & ~over)), waiting, int(min(due)) if due else None


def live_durations(starts: DataFrame, delay: str = "1 hour", timeout_ms: int = 86_400_000, marks: DataFrame | None = None, groups: int = STAGE_GROUPS) -> DataFrame:
    """Duration of each stage once the next one of its subject starts (``subject_id, event_id, stage, us, ts``).

    Starts wait in the state until the watermark has passed them and are then taken in order, so a start may come up to
    ``delay`` late, in any batch; those that come after a later start has been taken are dropped.  A stage still open ``timeout_ms`` of event time after its start is
    reported unfinished.  The state of a subject holds its starts of the last ``delay`` and one open stage.

    Subjects are dealt to ``groups`` by hash; those of a group share a row of the state and are taken together, so the calls
    of a batch follow its groups and not its subjects.  A few thousand starts a group within the delay is a good size.

    ``marks`` is a stream of times (``ts``) that only move the watermark; :func:`run_to_end` closes a finite source with one.
    """

    def close(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, *waiting = [pa.ipc.open_stream(b).read_all() for b in state.get] if state.exists else (_STARTS.empty_table(),)
        if not state.hasTimedOut:
            for rows in batches:
                waiting.append(pa.Table.from_pandas(rows.loc[rows["us"] != _MARK, _STARTS.names], _STARTS, preserve_index=False))
        passed = state.getCurrentWatermarkMs()
        done, seconds, finished, opened, left, due = _close_stages(opened, pa.concat_tables(waiting), passed, timeout_ms)
        if due is None:
            if state.exists:
                state.remove()
        else:
            state.update((_packed(opened), _packed(left)))
            state.setTimeoutTimestamp(max(due, passed + 1))
        yield done.drop_columns("us").to_pandas().assign(duration_s=seconds, finished=finished)

    # a start without a time has no place in the order and ends no stage
    starts = starts.filter(F.col("us").isNotNull())
    if marks is not None:
        empty = [F.lit(None).cast(starts.schema[c].dataType).alias(c) for c in (SUBJECT, "stage")]
        mark = marks.select(empty[0], F.lit(0).cast("long").alias("event_id"), empty[1], F.lit(_MARK).alias("us"), "ts")
        starts = starts.select(*mark.columns).unionByName(mark)
    subject = F.col(SUBJECT)
    dealt = starts.select(
        F.pmod(F.xxhash64(subject), F.lit(groups)).alias("_group"), subject.isNotNull().alias("named"), F.coalesce(subject, F.lit(0)).cast("long").alias(SUBJECT),
        "event_id", "stage", "us", "ts",
    )
    closed = dealt.withWatermark("ts", delay).groupBy("_group").applyInPandasWithState(close, _STAGE_OUT, _STAGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select(F.when(F.col("named"), F.col(SUBJECT)).alias(SUBJECT), "event_id", "stage", "duration_s", "finished")


def live_regions(voxels: DataFrame, path: str, checkpoint: str, value: str = "norm"):
    """Partial sums of every subject and label, one folder per batch; see :func:`stored_regions`.

    A batch that runs again after a failure writes the same folder again, so nothing counts twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        region_partials(batch, value).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return voxels.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def stored_regions(spark: SparkSession, path: str) -> DataFrame:
    """The partial sums of all batches together, for ``region_stats(partials=...)``: subjects may come in any parts."""
    parts = spark.read.parquet(path)
    spread = F.coalesce(F.col("v_std") * F.col("v_std") * (F.col("n_values") - 1), F.lit(0.0)) + F.try_divide(F.col("v_sum") * F.col("v_sum"), F.col("n_values"))
    out = parts.groupBy(SUBJECT, "seg").agg(
        *(F.sum(c).alias(c) for c in ("n_voxels", "n_values", "v_sum", "v_sum2")), F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"), F.sum(spread).alias("_spread")
    )
    within = F.col("_spread") - F.col("v_sum") * F.col("v_sum") / F.col("n_values")
    deviation = F.when(F.col("n_values") > 1, F.sqrt(F.greatest(within, F.lit(0.0)) / (F.col("n_values") - 1)))
    return out.withColumn("v_std", deviation).drop("_spread")


def upsert_counts(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for update-mode aggregates: keeps every version with its batch number."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return store


def latest(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The newest version per key of a table written by :func:`upsert_counts`."""
    picked = F.max_by(F.struct(*values), F.col("batch_id")).alias("_v")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_v.*")


def run_available(query, checkpoint: str | None = None) -> None:
    """Process what has arrived, then stop."""
    if checkpoint is not None:
        query = query.option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def mark_stream(spark: SparkSession, path: str) -> DataFrame:
    """The times that :func:`run_to_end` writes to ``path``, none at first."""
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(path)
    return file_stream(spark, path, StructType.fromDDL("ts timestamp"))


def run_to_end(query, checkpoint: str, path: str, last: datetime.datetime | None, delay: datetime.timedelta = datetime.timedelta(hours=1)) -> None:
    """Process a finite source, then what still waits for the watermark.

    After all data, a marker later than the last event (at ``last``) by the delay takes the watermark past every row.
    """
    run_available(query, checkpoint)
    if last is not None:
        spark = SparkSession.active()
        spark.createDataFrame([(last + delay + datetime.timedelta(seconds=1),)], "ts timestamp").write.mode("append").parquet(path)
        run_available(query, checkpoint)
