"""Lookup joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.plans.storage import known_bytes, known_rows, materialize, measured, row_bytes

# Largest lookup side that is broadcast, by rows and by bytes; both are measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# A key is hot when it holds more than 1/HOT_PARTS of all rows, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 512


def literal_table(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """A driver-built table; broadcast because its length is known here, unless it is too long."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def attach(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    costly: bool = True,
    max_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join a lookup with one row per key to a table of any size.

    The lookup is measured first.  Within ``max_rows`` and ``BROADCAST_BYTES`` it is broadcast; beyond that the
    rows are joined by shuffle, with the hot keys taken out (:func:`split_hot_join`).  A ``costly`` lookup (an
    aggregate) is written first, so that measuring and joining do not compute it twice.  ``rows`` gives a known
    count of a lookup whose columns are numbers.
    """
    on = [on] if isinstance(on, str) else list(on)
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    size = known_bytes(small)
    if rows is None:
        rows = known_rows(small)
    if rows is None and costly:
        small = materialize(small, "lookup")
        rows, size = known_rows(small), known_bytes(small)
    if rows is None:
        seen = small.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(small.schema)).alias("bytes")).first()
        rows, size = seen["rows"], seen["bytes"] or 0
    if rows <= max_rows and (size or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return split_hot_join(big, small, on, how)


def split_hot_join(
    big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "left", parts: int = HOT_PARTS
) -> DataFrame:
    """Join ``big`` to ``small`` (unique on the key) without sending a hot key to one task.

    At most ``parts`` keys can each hold more than ``1/parts`` of the rows, so their lookup rows always
    fit a broadcast; all other keys are spread by an ordinary shuffle join.  ``big`` is read three times, so it is
    written first unless it is a written table: a chain of such joins then grows by one write each, not twofold.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("left", "inner"):
        raise ValueError("split_hot_join supports left and inner joins")
    if known_rows(big) is None:
        big = materialize(big, "joined")
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    counts, seen = measured(counts, "keycount", total=F.sum("_rows"))
    total = seen["total"] or 0
    hot = F.broadcast(counts.filter(F.col("_rows") > total / parts).select(*on))
    hot_small = F.broadcast(small.join(hot, on, "left_semi"))
    hot_rows = big.join(hot, on, "left_semi").join(hot_small, on, how)
    cold_rows = big.join(hot, on, "left_anti").join(small, on, how)
    return hot_rows.unionByName(cold_rows)
