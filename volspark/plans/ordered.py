"""Ordered scans (fill, lead, running counts) split into chunks, so no window holds a whole hot group.

Each scan works inside chunks of a group and carries one summary row per chunk across chunk borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.plans.joins import BROADCAST_ROWS, attach
from volspark.plans.storage import known_rows, materialize

CHUNK = 65_536
DIRECT_ROWS = 1_000_000
BUCKETS = 256


def forward_fill(
    df: DataFrame, group: Sequence[str], order: str, value: str, out: str, chunk: int = CHUNK, include_self: bool = True
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row (before it if not ``include_self``) by integer ``order``.

    A written table whose largest group has at most ``DIRECT_ROWS`` rows needs one window only; others are filled inside
    chunks, and one summary row per chunk carries the value across borders.
    """
    group = list(group)
    last = 0 if include_self else -1
    rows = known_rows(df)
    if rows is not None:
        largest = rows if rows <= DIRECT_ROWS else df.groupBy(*group).agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d")).first()[0]
        if largest <= DIRECT_ROWS:
            upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
            return df.withColumn(out, F.last(value, ignorenulls=True).over(upto))
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    spans = df.groupBy(*group, "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = spans.select(*group, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    upto = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    filled = df.withColumn(out, F.last(value, ignorenulls=True).over(upto))
    return (
        filled.join(carry, [*group, "_chunk"], "left")
        .withColumn(out, F.coalesce(out, "_carry"))
        .drop("_chunk", "_carry")
    )


def next_value(
    df: DataFrame, group: Sequence[str], chunk_expr: Column, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``lead(value)`` by ``order`` within ``group``; ``chunk_expr`` must not decrease along ``order``."""
    group = list(group)
    df = df.withColumn("_chunk", chunk_expr)
    key = F.struct(*order)
    heads = df.groupBy(*group, "_chunk").agg(F.min_by(value, key).alias("_head"))
    after = Window.partitionBy(*group).orderBy("_chunk")
    carry = heads.select(*group, "_chunk", F.lead("_head").over(after).alias("_carry"))
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    # the value itself may be NULL, so the last row of a chunk is found by position
    led = df.withColumn("_has_next", F.lead(F.lit(True)).over(inside)).withColumn(out, F.lead(value).over(inside))
    return (
        led.join(carry, [*group, "_chunk"], "left")
        .withColumn(out, F.when(F.col("_has_next").isNotNull(), F.col(out)).otherwise(F.col("_carry")))
        .drop("_chunk", "_carry", "_has_next")
    )


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Copies of each value per group; equal values collapse before the shuffle."""
    return df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def running_counts(
    counts: DataFrame, group: Sequence[str], value: str, n: str = "n", direct_rows: int = DIRECT_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """Add ``cum`` (rows with a value <= this one) and ``total`` (rows of the group).

    Groups with few distinct values use one window each.  Larger ones are cut at approximate quantiles
    into ``buckets`` ranges, ranked inside each range, and shifted by the totals of the lower ranges; the
    cuts only balance the work, the counts are exact.
    """
    group = list(group)
    counts = materialize(counts, "counts")
    largest = known_rows(counts)
    if largest > direct_rows:
        largest = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d")).first()[0]
    if largest <= direct_rows:
        upto = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*group)
        return counts.withColumn("cum", F.sum(n).over(upto)).withColumn("total", F.sum(n).over(whole))

    steps = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, steps, 10 * buckets).alias("_cuts"))
    if group:
        cut_rows = attach(counts, cuts, group, max_rows=BROADCAST_ROWS // buckets)
    else:
        cut_rows = counts.withColumn("_cuts", F.lit(cuts.first()[0]))
    placed = cut_rows.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    placed = materialize(placed, "placed")
    totals = placed.groupBy(*group, "_bucket").agg(F.sum(n).alias("_in_bucket"))
    lower = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_in_bucket").over(lower), F.lit(0)).alias("_offset"),
        F.sum("_in_bucket").over(whole).alias("total"),
    )
    upto = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("cum", F.sum(n).over(upto))
    return (
        ranked.join(offsets, [*group, "_bucket"])
        .withColumn("cum", F.col("cum") + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, quantiles: dict[str, float], **sizes: int
) -> DataFrame:
    """Linear-interpolation percentiles per group, one output column per entry of ``quantiles``."""
    group = list(group)
    ranked = running_counts(value_counts(df, group, value), group, value, **sizes)
    picks = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("total") - 1)
        picks.append(F.min(F.when(F.col("cum") > F.floor(position), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("cum") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"))
    picked = ranked.groupBy(*group).agg(F.max("total").alias("_n"), *picks)
    out = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return picked.select(*group, *out)


def row_positions(df: DataFrame, group: Sequence[str], key: str, out: str = "position", **sizes: int) -> DataFrame:
    """0-based position of each row by a unique ``key`` within its group."""
    counts = value_counts(df, group, key)
    ranked = running_counts(counts, group, key, **sizes)
    return df.join(ranked.select(*group, key, (F.col("cum") - 1).alias(out)), [*group, key])


def distinct_ranks(df: DataFrame, key: str, out: str = "rank", **sizes: int) -> DataFrame:
    """0-based rank of every distinct value of ``key``."""
    ones = df.select(key).distinct().withColumn("n", F.lit(1).cast("long"))
    return running_counts(ones, [], key, **sizes).select(key, (F.col("cum") - 1).cast("int").alias(out))
