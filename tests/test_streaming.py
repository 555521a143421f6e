"""Streams give what the batch operators give, with rows that come late, twice or in parts."""

import datetime

from pyspark.sql import functions as F

from volspark.operators.logs import stage_durations
from volspark.operators.regions import region_stats
from volspark.streaming import live


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def files(spark, tmp_path, batches, schema):
    """One file per batch, in the order in which a file stream takes them."""
    import os

    for k, rows in enumerate(batches):
        folder = f"{tmp_path}/raw{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        (name,) = [f for f in os.listdir(folder) if f.startswith("part-")]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{folder}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    frame = spark.createDataFrame([], schema)
    return live.file_stream(spark, f"{tmp_path}/in", frame.schema, files_per_batch=1)


STARTS = "subject_id long, event_id long, stage string, us long, ts timestamp"


def start(subject, event, stage, seconds):
    return subject, event, stage, int(seconds * 1e6), at(seconds)


def durations(spark, tmp_path, batches, **settings):
    shifted = F.col("us") + int(at(0).replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    stream = files(spark, tmp_path, batches, STARTS).withColumn("us", shifted)
    sink = live.live_durations(stream, **settings).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    live.run_available(sink, f"{tmp_path}/progress")
    rows = spark.read.schema("subject_id bigint, event_id bigint, stage string, duration_s double, finished boolean").parquet(f"{tmp_path}/out")
    return {(r["subject_id"], r["event_id"]): (r["duration_s"], r["finished"]) for r in rows.collect()}


def test_durations_with_late_rows(spark, tmp_path):
    batches = [
        [start(1, 1, "a", 10), start(1, 3, "c", 30), start(2, 9, "a", 12)],
        [start(1, 2, "b", 20), start(2, 10, "b", 15)],
        [start(3, 20, "x", 5000)],
        [start(3, 22, "z", 5100)],
        [start(1, 4, "d", 40), start(1, 5, "late", 25), start(3, 21, "y", 9000)],
    ]
    got = durations(spark, tmp_path, batches, delay="10 minutes")
    # the starts at 40 s and 25 s came a batch after the watermark had passed them
    assert got == {(1, 1): (10.0, True), (1, 2): (10.0, True), (2, 9): (3.0, True), (3, 20): (100.0, True)}
    rows = [r for b in batches for r in b if r[1] not in (4, 5)]
    batch = stage_durations(spark.createDataFrame(rows, STARTS)).filter("duration_s IS NOT NULL AND event_id <> 22").collect()
    assert {(r["subject_id"], r["event_id"]): (r["duration_s"], True) for r in batch} == got


def test_a_finite_source_is_closed(spark, tmp_path):
    # under an hour in all, in two batches, the second with an earlier start: without a closing marker nothing would come
    batches = [[start(1, 1, "a", 10), start(1, 3, "c", 300), start(2, 9, "a", 12)], [start(1, 2, "b", 20), start(2, 10, "b", 1500), start(3, 20, "x", 1501)]]
    shifted = F.col("us") + int(at(0).replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    stream = files(spark, tmp_path, batches, STARTS).withColumn("us", shifted)
    marks = live.mark_stream(spark, f"{tmp_path}/marks")
    sink = live.live_durations(stream, marks=marks).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    live.run_to_end(sink, f"{tmp_path}/progress", f"{tmp_path}/marks", at(1501))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["subject_id"], r["event_id"], r["stage"], r["duration_s"], r["finished"]) for r in got) == [
        (1, 1, "a", 10.0, True), (1, 2, "b", 280.0, True), (2, 9, "a", 1488.0, True)
    ]


def test_the_query_gives_every_stage_with_a_successor(spark):
    import duckdb

    from volspark.queries import training_ops

    folder = "/root/testdata/sf0.001"
    want = duckdb.sql(f"""SELECT user_id, event_id, event_type, round(s, 6) FROM (SELECT *, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1e6 AS s
        FROM '{folder}/events.parquet') WHERE s IS NOT NULL""").fetchall()
    got = training_ops.stream_stage_durations(spark, folder).select("subject_id", "event_id", "stage", "duration_s").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_open_stage_times_out(spark, tmp_path):
    batches = [[start(1, 1, "a", 10)], [start(2, 2, "b", 10_000)], [start(2, 3, "c", 20_000)]]
    got = durations(spark, tmp_path, batches, delay="1 minute", timeout_ms=3_600_000)
    assert got[(1, 1)][1] is False and (2, 2) not in got or got[(2, 2)] == (10_000.0, True)
    assert got[(1, 1)][0] != got[(1, 1)][0] or got[(1, 1)][0] is None


def test_regions_of_a_subject_in_parts(spark, tmp_path):
    rows = [(s, k % 3, float(k * s % 7) if k % 5 else None) for s in (1, 2) for k in range(40)]
    schema = "subject_id long, seg int, norm double"
    stream = files(spark, tmp_path, [rows[:25], rows[25:33], rows[33:]], schema)
    live.run_available(live.live_regions(stream, f"{tmp_path}/sums", f"{tmp_path}/progress"))
    heads = spark.createDataFrame([(1, 1.0), (2, 2.0)], "subject_id long, vox_vol double")
    sums = live.stored_regions(spark, f"{tmp_path}/sums")
    table = lambda df: {(r["subject_id"], r["seg"]): [round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()}
    whole = table(region_stats(spark.createDataFrame(rows, schema), heads, exclude=[0]))
    assert len(whole) == 4 and table(region_stats(sums, heads, exclude=[0], partials=sums)) == whole


def test_repeats_within_the_delay(spark, tmp_path):
    stream = files(spark, tmp_path, [[start(1, 1, "a", 10)], [start(1, 1, "a", 10), start(1, 2, "b", 20)]], STARTS)
    once = live.once_only(stream, ["subject_id", "event_id"], "10 minutes")
    live.run_available(once.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/progress")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_calls_of_a_batch_follow_the_groups_of_subjects(spark, tmp_path):
    # many subjects, one of them NULL, share few rows of the state; a start without a time ends no stage
    rows = [(s if s else None, 10 * s + k, "abc"[k], int(1e6 * (s + 100 * k * k)), at(s + 100 * k * k)) for s in range(60) for k in range(3)]
    rows.append((5, 999, "d", None, at(7)))
    marks = live.mark_stream(spark, f"{tmp_path}/marks")
    stream = files(spark, tmp_path, [rows[:90], rows[90:]], STARTS)
    shifted = F.col("us") + int(at(0).replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    running = live.live_durations(stream.withColumn("us", shifted), marks=marks, groups=4)
    live.run_to_end(running.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/progress", f"{tmp_path}/marks", at(1000))
    got = spark.read.parquet(f"{tmp_path}/out").select("subject_id", "event_id", "stage", "duration_s", "finished").collect()
    want = [(s if s else None, 10 * s + k, "ab"[k], [100.0, 300.0][k], True) for s in range(60) for k in range(2)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    # the state has one row per group that has starts, and not one per subject
    assert 0 < spark.read.format("statestore").load(f"{tmp_path}/progress").count() <= 4
