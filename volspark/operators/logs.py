"""Log scanning, command and stage timings, and comparison of result tables with a reference run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.operators.regions import SUBJECT
from volspark.plans.joins import attach
from volspark.plans.ordered import forward_fill, next_value
from volspark.plans.storage import known_rows, materialize

# Words that mark a failing line, and phrases that make it harmless.
ERROR_WORDS = ["error", "error:", "exception", "traceback"]
HARMLESS = ["without error", "not included", "distance", "correcting", "error=", "rms error", "mcsrch error"]
# Marker of timing lines, commands that are not reported, and phrases that are not a command line.
TIMING_MARK = "@#@FSTIME"
QUIET_COMMANDS = ["ln", "rm", "cp"]
NOT_A_COMMAND = [
    "done", "Done", "successful", "finished without error", "cmdline", "Running command", "failed", "FSRUNTIME@", "ru_nivcsw",
    "ru_nvcsw", "ru_nsignals", "ru_msgrcv", "ru_msgsnd", "ru_oublock", "ru_inblock", "ru_nswap", "ru_majflt", "ru_minflt",
    "ru_isrss", "ru_idrss", "ru_ixrss", "ru_maxrss", "stimesec", "utimesec", "#", "This may cause",
]
STAGE_MARK = "#@# "
TIME_FORMAT = "yyyy:MM:dd:HH:mm:ss"


def _has_any(line: Column, words: Sequence[str]) -> Column:
    return F.exists(F.lit(list(words)), lambda w: F.contains(line, w))


def is_error(line: str = "line", words: Sequence[str] = ERROR_WORDS, harmless: Sequence[str] = HARMLESS) -> Column:
    low = F.lower(F.col(line))
    return _has_any(low, [w.lower() for w in words]) & ~_has_any(low, [w.lower() for w in harmless])


def scan_errors(lines: DataFrame, words: Sequence[str] = ERROR_WORDS, harmless: Sequence[str] = HARMLESS, by: Sequence[str] = ("file",)) -> DataFrame:
    """Hits with one line before and three after (``at`` = -1 .. 3).

    Each hit asks for its context lines by number, so a file is never gathered.
    """
    hits = lines.filter(is_error("line", words, harmless)).select(*by, F.col("line_no").alias("hit"))
    asked = hits.withColumn("at", F.explode(F.sequence(F.lit(-1), F.lit(3)))).withColumn("line_no", (F.col("hit") + F.col("at")).cast("int"))
    return asked.join(lines.select(*by, "line_no", "line"), [*by, "line_no"]).select(*by, "hit", "at", "line_no", "line")


def sections(lines: DataFrame, by: Sequence[str] = ("file",), chunk: int = 65_536) -> DataFrame:
    """Add ``section``: the last heading (a line with ``======``, but no iteration line) at or before each line."""
    marked = lines.withColumn("_name", _heading())
    return forward_fill(marked, by, "line_no", "_name", "section", chunk).drop("_name")


def parse_timing(line: Column) -> Column:
    """Fields of a timing line as a struct: start, command, arguments, seconds, cpu, memory, faults, switches, i/o."""
    return _timing_fields(F.split(F.trim(line), r"\s+"))


def _timing_fields(words: Column) -> Column:
    at = lambda i: F.get(words, F.lit(i))
    return F.struct(
        F.try_to_timestamp(at(1), F.lit(TIME_FORMAT)).alias("start"), at(2).alias("cmd"), at(4).cast("int").alias("n_args"),
        at(6).cast("double").alias("elapsed_s"), at(8).cast("double").alias("sys_s"), at(10).cast("double").alias("user_s"),
        F.regexp_replace(at(12), "%", "").cast("double").alias("cpu_percent"), at(14).cast("long").alias("max_kb"),
        at(16).cast("long").alias("major_faults"), at(18).cast("long").alias("minor_faults"), at(20).cast("long").alias("swaps"),
        at(22).cast("long").alias("switches"), at(24).cast("long").alias("waits"), at(26).cast("long").alias("inputs"),
        at(28).cast("long").alias("outputs"),
    )


def timing_lines(lines: DataFrame) -> DataFrame:
    """Lines with the timing mark, parsed; quiet commands are dropped, another layout is an error."""
    rows = lines.filter(F.contains(F.col("line"), F.lit(TIMING_MARK)) & ~F.contains(F.col("line"), F.lit("cmdf")))
    p = F.split(F.trim("line"), r"\s+")
    rows = rows.filter(~F.get(p, F.lit(2)).isin(QUIET_COMMANDS))
    bad = F.raise_error(F.concat(F.lit("unexpected timing line: "), F.col("line"))).cast("boolean")
    good = F.when(F.get(p, F.lit(5)) == "e", F.lit(True)).otherwise(bad)
    return rows.filter(good).withColumn("t", parse_timing(F.col("line"))).drop("line").select("*", "t.*").drop("t")


def _heading(line: str = "line") -> Column:
    """The name of a section heading (a line with ``======``, but no iteration line); NULL for other lines."""
    marked = F.contains(F.col(line), F.lit("======")) & ~F.contains(F.col(line), F.lit("teration"))
    name = F.regexp_replace(F.trim(F.regexp_replace(line, "^[= ]+|[= ]+$", "")), " ", "-")
    return F.when(marked & (name != "DONE"), name)


def _with_stage_marks(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with their stage ``marks``, ``(stage, us)``: a ``#@# name date`` of more than five words, and an ``Ended`` (stage NULL).

    The last six words are the date, like "Thu Jan 21 18:27:08 UTC 2016".  A line is split once and its date read once.
    """
    words = F.col("_words")
    rows = lines.withColumn("_words", F.split(F.trim(line), r"\s+")).filter(F.size(words) > 5)
    month, day, time, year = (F.element_at(words, k) for k in (-5, -4, -3, -1))
    stamp = F.concat_ws(" ", month, F.lpad(day, 2, "0"), time, year)
    rows = rows.withColumn("_us", F.unix_micros(F.try_to_timestamp(stamp, F.lit("MMM dd HH:mm:ss yyyy"))))
    name = F.concat_ws(" ", F.slice(words, 2, F.greatest(F.size(words) - 7, F.lit(0))))
    us = F.col("_us").alias("us")
    stage = F.when(F.contains(F.col(line), F.lit(STAGE_MARK)), F.struct(name.alias("stage"), us))
    ended = F.when(F.contains(F.col(line), F.lit("Ended")), F.struct(F.lit(None).cast("string").alias("stage"), us))
    return rows.withColumn("marks", F.array_compact(F.array(stage, ended))).drop("_words", "_us")


def report_lines(lines: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """The lines that time reports need, with what they may be: ``timing``, ``heading``, ``marks`` (stages), ``plain`` (a command).

    One pass over the text with plain searches; taking lines apart is left to those who read the few of a kind.
    """
    line = F.col("line")
    has = lambda word: F.contains(line, F.lit(word))
    # most lines that are no command hold a "#", so it is looked for first
    message = reduce(or_, (has(w) for w in sorted(NOT_A_COMMAND, key=len)))
    tagged = lines.select(
        *by, "line_no", "line", (has(TIMING_MARK) & ~has("cmdf")).alias("timing"), has("======").alias("heading"), (has(STAGE_MARK) | has("Ended")).alias("marks"),
        (~message).alias("plain"),
    )
    return tagged.filter("timing OR heading OR marks OR plain")


def _timed_commands(tagged: DataFrame, by: Sequence[str], chunk: int) -> DataFrame:
    """Timing lines with their section and ``_full``, the command line (``line_no``, ``plain``) before them.

    A command line ends some word, before a space, with the command's name: words are cut to the lengths that names have, and
    only those that the file times are kept.
    """
    timed = timing_lines(tagged.filter("timing").select(*by, "line_no", "line"))
    fields = [c for c in timed.columns if c not in (*by, "line_no")]
    timed = timed.select(*by, "line_no", F.struct(*fields).alias("timing"))
    names = materialize(timed.select(*by, F.col("timing.cmd").alias("cmd")).distinct(), "commands")
    lengths = [r[0] for r in names.select(F.length("cmd")).distinct().collect()]
    heads = materialize(tagged.filter("heading").select(*by, "line_no", _heading().alias("head")).filter("head IS NOT NULL"), "headings")
    if known_rows(heads):
        # a heading comes before what is timed on the same line
        both = materialize(timed.unionByName(heads, allowMissingColumns=True), "timings")
        headed = forward_fill(both, by, "line_no", "head", "section", chunk).filter("timing IS NOT NULL").drop("head")
    else:
        headed = timed.withColumn("section", F.lit(None).cast("string"))
    words = F.regexp_extract_all("line", F.lit(r"(\S+) "), F.lit(1))
    ends = F.transform(words, lambda w: F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length(w)), lambda n: F.right(w, n)))
    plain = tagged.filter("plain").select(*by, "line_no", F.col("line").alias("plain"), F.explode(F.array_distinct(F.flatten(ends))).alias("cmd"))
    plain = attach(plain, names, [*by, "cmd"], "inner")
    rows = headed.withColumn("cmd", F.col("timing.cmd")).unionByName(plain, allowMissingColumns=True)
    rows = rows.withColumn("_line", F.when(F.col("plain").isNotNull(), F.struct("line_no", F.ltrim("plain").alias("command"))))
    rows = materialize(rows.drop("plain"), "command-lines")
    rows = forward_fill(rows, [*by, "cmd"], "line_no", "_line", "_full", chunk, include_self=False)
    return rows.filter("timing IS NOT NULL AND _full IS NOT NULL").drop("_line")


def command_times(lines: DataFrame, by: Sequence[str] = ("file",), chunk: int = 65_536) -> DataFrame:
    """Timed commands with their section, full command line, stop time and minutes.

    The full command is the last earlier line that names the command and is not a message.  Timings
    without such a line are dropped.
    """
    by = list(by)
    out = _timed_commands(materialize(report_lines(lines, by), "report"), by, chunk)
    seconds = F.col("timing.elapsed_s")
    stop = F.col("timing.start") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return out.select(
        *by, "line_no", "section", "cmd", F.col("_full.command").alias("command"), F.col("timing.start").alias("start"), stop.alias("stop"),
        seconds.alias("elapsed_s"), F.bround(seconds / 60, 2).alias("minutes"),
    )


def stage_durations(stages: DataFrame, by: Sequence[str] = (SUBJECT,), time: str = "us", tie: str = "event_id", width: int = 3_600_000_000) -> DataFrame:
    """Seconds from each stage's start to the next one's; the last stage of a group has no duration.

    ``time`` is in microseconds.  A group is scanned in time slices of ``width``.
    """
    led = next_value(stages, by, F.floor(F.col(time) / width), [time, tie], time, "_next")
    return led.withColumn("duration_s", (F.col("_next") - F.col(time)) / 1_000_000.0).drop("_next")


def command_stages(lines: DataFrame, by: Sequence[str] = ("file",), command: str = "recon-all", chunk: int = 65_536) -> DataFrame:
    """Stages inside a command's log, keyed by the line of the command's timing (``timed_at``): stage, start, stop, seconds.

    Stage marks between the command's line and its timing line count; each stage lasts until the next mark or ``Ended``.
    A command's stages are found once; its timings then meet only those pieces of line numbers that hold its marks, so the
    rows are those of the result whatever the gaps between lines, and neither a long log nor a long span is one group.
    """
    by = list(by)
    tagged = materialize(report_lines(lines, by), "report")
    timed = timing_lines(tagged.filter("timing").select(*by, "line_no", "line")).filter(F.col("cmd") == command).select(*by, "line_no")
    # a word that ends with the command's name, before a space
    plain = tagged.filter(F.col("plain") & F.contains(F.col("line"), F.lit(f"{command} ")))
    marks = _with_stage_marks(tagged.filter("marks").select(*by, "line_no", "line")).drop("line")
    # a command's line comes before what is marked on the same line
    line = F.col("line_no").cast("long")
    at = lambda rows, odd: rows.withColumn("_order", 2 * line + odd)
    rows = at(plain.select(*by, "line_no", line.alias("_at")), 0).unionByName(at(marks, 1), True).unionByName(at(timed.withColumn("_timed", F.lit(True)), 1), True)
    begun = materialize(forward_fill(materialize(rows, "commands"), by, "_order", "_at", "_from", 2 * chunk).filter("_at IS NULL AND _from IS NOT NULL"), "begun")
    met = begun.filter("_timed IS NULL").select(*by, "_from", "line_no", F.posexplode("marks").alias("_k", "_mark")).withColumn("_order", 2 * line + F.col("_k"))
    met = materialize(met.withColumn("_stage", F.when(F.col("_mark.stage").isNotNull(), F.col("_mark"))), "marks")
    led = forward_fill(met, [*by, "_from"], "_order", "_stage", "_open", 2 * chunk, include_self=False).filter("_open IS NOT NULL")
    led = materialize(led.withColumn("_piece", F.floor(line / chunk)).drop("_stage", "_k", "_order"), "stages")
    texts = plain.select(*by, line.alias("_from"), F.ltrim("line").alias("command"))
    spans = begun.filter("_timed").select(*by, "_from", F.col("line_no").alias("timed_at"))
    spans = spans.join(led.select(*by, "_from", "_piece").distinct(), [*by, "_from"]).filter(F.col("_piece") <= F.floor((F.col("timed_at") - 1) / chunk))
    done = spans.join(led, [*by, "_from", "_piece"]).filter("line_no < timed_at").join(texts, [*by, "_from"])
    us = F.col("_mark.us") - F.col("_open.us")
    return done.select(
        *by, "timed_at", "command", "line_no", F.col("_open.stage").alias("stage"), F.timestamp_micros("_open.us").alias("start"),
        F.timestamp_micros("_mark.us").alias("stop"), (us / 1_000_000.0).alias("duration_s"),
    )


# --- regression checks -------------------------------------------------------------------------------


def compare_tables(test: DataFrame, reference: DataFrame, keys: Sequence[str], columns: Sequence[str], thresholds: DataFrame | None = None, structure: str = "struct_name", default: float = 0.01) -> DataFrame:
    """Cells whose ratio to the reference is off by more than the structure's threshold; cells missing on one side too.

    Reference cells of 0 are skipped.
    """

    def cells(df: DataFrame, name: str) -> DataFrame:
        kept = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
        return kept.unpivot(list(keys), list(columns), "column", name)

    both = cells(test, "test").join(cells(reference, "reference"), [*keys, "column"], "full")
    if thresholds is not None:
        both = attach(both, thresholds.select(structure, "threshold"), structure, costly=False)
    else:
        both = both.withColumn("threshold", F.lit(default))
    off = F.abs(F.try_divide("test", "reference") - 1)
    limit = F.coalesce("threshold", F.lit(default))
    missing = F.col("test").isNull() | F.col("reference").isNull()
    both = both.withColumn("off", off).filter(missing | ((F.col("reference") != 0) & (F.col("off") > limit)))
    return both.select(*keys, "column", "test", "reference", "off")


def missing_rows(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected measures or files that are not there; extra ones are no matter."""
    return expected.join(present, list(keys), "left_anti")


def last_status(status: DataFrame, by: Sequence[str] = (SUBJECT, "stage")) -> DataFrame:
    return status.groupBy(*by).agg(F.max_by("state", F.struct("ts", "seq")).alias("state"))


def runnable(status: DataFrame, stage: str, failed: str = "Failed") -> DataFrame:
    """Subjects whose last state of ``stage`` is not a failure."""
    bad = last_status(status).filter((F.col("stage") == stage) & F.col("state").startswith(failed)).select(SUBJECT)
    return status.select(SUBJECT).distinct().join(bad, SUBJECT, "left_anti")


def quality_flags(voxels: DataFrame, headers: DataFrame, litres: float = 0.7) -> DataFrame:
    """Subjects with their labelled volume in litres and ``failed`` where it is too small."""
    n = voxels.groupBy(SUBJECT).agg(F.count_if(F.col("seg") > 0).alias("_n"))
    out = attach(n, headers.select(SUBJECT, "vox_vol"), SUBJECT, costly=False)
    return out.withColumn("litres", F.col("_n") * F.col("vox_vol") / 1e6).select(SUBJECT, "litres", (F.col("litres") < litres).alias("failed"))


def failure_ratio(flags: DataFrame) -> DataFrame:
    """Share of failed subjects; NULL for a single subject."""
    n = F.count(F.lit(1))
    ratio = F.when(n > 1, F.count_if("failed") / n)
    return flags.agg(n.alias("subjects"), F.count_if("failed").alias("n_failed"), ratio.alias("ratio"))


def sequence_runs(ids: DataFrame, by: Sequence[str], value: str, chunk: int = 4096) -> DataFrame:
    """Compact text of id lists, e.g. ``1-3,7``.

    Runs are found inside chunks of ``chunk`` ids; one summary row per chunk tells where a run that reaches the chunk's end
    began, so a run over many chunks is joined without a window or a list over a whole group's ids.
    """
    by = list(by)
    part = F.floor(F.col(value) / chunk)
    rows = ids.select(*by, value).distinct().withColumn("_c", part)
    line = Window.partitionBy(*by, "_c").orderBy(value)
    runs = rows.withColumn("_g", F.col(value) - F.row_number().over(line)).groupBy(*by, "_c", "_g").agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    low, high = F.col("_c") * chunk, F.col("_c") * chunk + (chunk - 1)
    edge = runs.groupBy(*by, "_c").agg(
        F.max(F.when(F.col("_b") == high, F.col("_a"))).alias("_open"), F.bool_or((F.col("_a") == low) & (F.col("_b") == high)).alias("_full")
    )
    summary = Window.partitionBy(*by).orderBy("_c")
    previous = F.coalesce((F.lag("_c").over(summary) == F.col("_c") - 1) & F.lag("_open").over(summary).isNotNull(), F.lit(False))
    edge = edge.withColumn("_joins", previous)
    # a chunk that is one run and joins the one before has the start of that one
    edge = edge.withColumn("_start", F.when(F.col("_open").isNotNull() & ~(F.col("_full") & F.col("_joins")), F.col("_open")))
    before = summary.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*by, "_c", F.when(F.col("_joins"), F.last("_start", ignorenulls=True).over(before)).alias("_from"))
    joined = runs.join(edge, [*by, "_c"]).withColumn("_a", F.when((F.col("_a") == low) & F.col("_from").isNotNull(), F.col("_from")).otherwise(F.col("_a")))
    spans = joined.groupBy(*by, "_a").agg(F.max("_b").alias("_b"))
    text = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat(F.col("_a").cast("string"), F.lit("-"), F.col("_b").cast("string")))
    ordered = lambda key, name: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(name).alias("t")))), lambda s: s["t"]))
    pieces = spans.withColumn("t", text).groupBy(*by, F.floor(F.col("_a") / chunk).alias("_c")).agg(ordered("_a", "t").alias("t"))
    return pieces.groupBy(*by).agg(ordered("_c", "t").alias("text"))
