"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.llm.common import WORD, table, uniform
from volspark.llm.registry import query
from volspark.plans.joins import attach
from volspark.plans.storage import known_rows, materialize, measured

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
# Newton ends when every source is this close to its target, relatively, or after so many steps.
TOLERANCE, STEPS = 1e-7, 40
# The rounding threshold is searched in [-SPAN, SPAN] of log rate, LEVELS times in CELLS parts.
SPAN, CELLS, LEVELS = 40.0, 512, 4
_KEY = ["_src", "_none"]


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(mass: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Add ``target`` to one row per source (_src, _none, source_size).

    Sources share the sum of all sizes by weight; none gets more than ``most`` times its size, and what is over goes to the
    others by weight until none is above.  With the sources ordered by the share at which they are full, the full ones are
    the first k, and the level of the rest follows from running sums.
    """
    order = Window.orderBy("_none", "_src")
    values = F.array(*[F.lit(float(w)) for w in weights])
    rank = (F.row_number().over(order) - 1) % len(weights)
    rows = mass.withColumn("_w", F.element_at(values, (rank + 1).cast("int"))).withColumn("_cap", F.col("source_size") * float(most))
    upto = Window.orderBy(F.col("_cap") / F.col("_w"), "_none", "_src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", F.sum("_cap").over(upto).alias("_full"), F.sum("_w").over(upto).alias("_light"))
    rows = rows.select("*", F.sum("source_size").over(whole).alias("_total"), F.sum("_w").over(whole).alias("_heavy"))
    # the level if just the sources before this one are full; it is the true level for the first source that stays below its cap
    level = (F.col("_total") - (F.col("_full") - F.col("_cap"))) / (F.col("_heavy") - (F.col("_light") - F.col("_w")))
    rows = rows.withColumn("_level", level).withColumn("_open", F.col("_cap") / F.col("_w") > F.col("_level"))
    rows = rows.withColumn("_level", F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.col("_full"))).over(whole))
    return rows.select(*_KEY, "source_size", F.least("_cap", F.coalesce(F.col("_w") * F.col("_level"), "_cap")).cast("double").alias("target"))


def _rate(tilt: Column, z: Column, most: float) -> Column:
    """The tilted rate of a document: exp(tilt * z), at most ``most``."""
    return F.least(F.exp(F.least(tilt * z, F.lit(50.0))), F.lit(float(most)))


def _exact_sum(value: Column) -> Column:
    """A sum in fixed-point numbers, the same in whatever order the rows come, so that reruns agree to the last bit."""
    return F.sum(F.round(value * (1 << 20)).cast("decimal(28,0)")).cast("double") / (1 << 20)


def solve_tilts(sizes: DataFrame, sources: DataFrame, most: float = MOST_COPIES, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """_src, _none, mean, target, tilt per source.

    The rates nearest to 1 in relative entropy whose token sum is the target are exp(tilt * size / mean), at most
    ``most``.  The dual is convex and separates by source: each step is one aggregation of the table of (source, size,
    documents) and a Newton step on the logarithm of the token sum, kept inside the bracket known so far.  A source whose
    target is its ceiling needs no step.
    """
    counts = materialize(sizes.groupBy(*_KEY, "_size").agg(F.count(F.lit(1)).alias("_n")), "mix-sizes")
    docs = counts.groupBy(*_KEY).agg(F.sum("_n").alias("_docs"))
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    state = sources.join(docs, _KEY).select(
        *_KEY, "source_size", "target", (F.col("source_size") / F.col("_docs")).alias("mean"),
        F.when(full, F.lit(1e6)).otherwise(F.lit(0.0)).alias("tilt"), F.lit(-1e6).alias("_lo"), F.lit(1e6).alias("_hi"),
        (full | (F.col("target") <= 0)).alias("_done"),
    )
    state = materialize(state, "mix-state")
    for _ in range(steps):
        live = state.filter(~F.col("_done"))
        rows = counts.join(live.select(*_KEY, "mean", "tilt"), _KEY)
        z = F.col("_size") / F.col("mean")
        rate = _rate(F.col("tilt"), z, most)
        mass = F.col("_n") * F.col("_size") * rate
        sums = rows.groupBy(*_KEY).agg(
            _exact_sum(mass).alias("_g"), _exact_sum(F.when(F.col("tilt") * z < F.log(F.lit(float(most))), mass * z).otherwise(0.0)).alias("_h")
        )
        joined = state.join(sums, _KEY, "left")
        lo = F.when(F.col("_g") < F.col("target"), F.col("tilt")).otherwise(F.col("_lo"))
        hi = F.when(F.col("_g") > F.col("target"), F.col("tilt")).otherwise(F.col("_hi"))
        newton = F.col("tilt") + F.log(F.col("target") / F.col("_g")) * F.col("_g") / F.col("_h")
        # outside the bracket: half way, on a scale that reaches far ends quickly
        middle = F.when(lo <= -1e5, F.least(F.col("tilt") * 4, F.lit(-1.0))).when(hi >= 1e5, F.greatest(F.col("tilt") * 4, F.lit(1.0))).otherwise((lo + hi) / 2)
        inside = F.coalesce((newton > lo) & (newton < hi), F.lit(False)) & (F.col("_h") > 0)
        error = F.abs(F.col("_g") / F.col("target") - 1)
        done = F.col("_done") | (error <= tolerance)
        state, seen = measured(
            joined.select(
                *_KEY, "source_size", "target", "mean", F.when(done, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
                F.when(done, F.col("_lo")).otherwise(lo).alias("_lo"), F.when(done, F.col("_hi")).otherwise(hi).alias("_hi"), done.alias("_done"),
            ),
            "mix-state",
            left=F.sum(F.when(F.col("_done"), 0).otherwise(1)),
        )
        if not seen["left"]:
            break
    return state.select(*_KEY, "source_size", "mean", "target", "tilt")


def _steps(most: int) -> Column:
    """The log shifts at which a document gets its first, second, ... copy: floor(rate * e^shift + draw) reaches c."""
    return F.array(*[F.log((F.lit(float(c)) - F.col("_draw")) / F.col("_rate")) for c in range(1, most + 1)])


def _keyed(docs: DataFrame, source_col: str) -> DataFrame:
    return docs.withColumns({"_src": F.coalesce(F.col(source_col), F.lit("")), "_none": F.col(source_col).isNull()})


def _rated(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """Add _rate and _draw to rows that have _id, _size and their source's plan; the draw hangs on the id and ``seed``."""
    z = F.when(F.col("mean") > 0, F.col("_size") / F.col("mean")).otherwise(0.0)
    return rows.withColumns({"_rate": _rate(F.col("tilt"), z, most), "_draw": uniform("_id", seed=seed)})


def _copies(most: int) -> Column:
    copies = F.size(F.filter(_steps(most), lambda s: s < F.col("shift")))
    return F.when(F.col("_size") > 0, copies).otherwise(F.lit(1))


def mixing_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """_src, _none, source_size, mean, target, tilt, shift per source, from _id, _src, _none, _size of every document.

    Targets are set by :func:`source_targets`, tilts by :func:`solve_tilts`.  A rate becomes floor(rate * e^shift + draw) copies;
    one shift per source, found in finer and finer cells of the log shift, brings the words taken nearest to the target.
    """
    mass = sizes.groupBy(*_KEY).agg(F.sum("_size").alias("source_size"))
    sources = materialize(source_targets(mass, weights, most), "mix-targets")
    tilts = solve_tilts(sizes, sources, most)

    rates = _rated(attach(sizes, tilts, _KEY, how="inner"), most, seed).filter((F.col("_size") > 0) & (F.col("_rate") > 0))
    steps = rates.select(*_KEY, "_size", "target", F.explode(_steps(most)).alias("_step"))
    cell = materialize(sources.select(*_KEY, F.lit(-SPAN).alias("_at"), F.lit(2 * SPAN).alias("_wide"), F.lit(0.0).alias("_below")), "mix-cell")
    for _ in range(LEVELS):
        part = F.col("_wide") / CELLS
        at = F.floor((F.col("_step") - F.col("_at")) / part)
        inside = attach(steps, cell.select(*_KEY, "_at", "_wide", "_below"), _KEY, how="inner", rows=known_rows(cell))
        inside = inside.withColumn("_cell", at).filter(F.col("_cell").between(0, CELLS - 1))
        filled = inside.groupBy(*_KEY, "_cell", "_at", "_wide", "_below", "target").agg(F.sum("_size").alias("_mass"))
        upto = Window.partitionBy(*_KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = filled.withColumn("_sum", F.col("_below") + F.sum("_mass").over(upto))
        crossing = filled.filter(F.col("_sum") >= F.col("target")).groupBy(*_KEY).agg(
            F.min_by(F.struct("_cell", "_at", "_wide", "_sum", "_mass", "target"), "_cell").alias("c")
        )
        found = crossing.select(
            *_KEY, (F.col("c._at") + F.col("c._cell") * F.col("c._wide") / CELLS).alias("_at"), (F.col("c._wide") / CELLS).alias("_wide"),
            (F.col("c._sum") - F.col("c._mass")).alias("_below"), F.col("c._sum").alias("_above"), F.col("c.target").alias("target"),
        )
        cell = materialize(found, "mix-cell")
    nearer = F.col("target") - F.col("_below") <= F.col("_above") - F.col("target")
    shift = cell.select(*_KEY, F.when(nearer, F.col("_at")).otherwise(F.col("_at") + F.col("_wide")).alias("shift"))
    # a source that never reaches its target takes all that it may
    return materialize(tilts.join(shift, _KEY, "left").withColumn("shift", F.coalesce("shift", F.lit(SPAN))), "mix-plan")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = _keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source")), "_source")
    return materialize(rows.select("_id", *_KEY, words_in(F.col("_text")).alias("_size")), "mix-words")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """id, size, source_size, target, rate, copies, taken for every row; see :func:`mixing_plan`.

    Size is the number of words (null or empty text: 0).  A null source is one source, the last.  Nothing is dropped: a row
    may get 0 copies, at most ``most``.  Reruns agree, as the draws hang on ids alone.

    Repeated rows share their draw and each count; so do null ids.  Documents of size 0 get one copy and take nothing.  An
    empty table gives an empty result; extra columns are ignored.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    rows = _rated(attach(sizes, plan := mixing_plan(sizes, weights, most, seed), _KEY, how="inner", rows=known_rows(plan)), most, seed)
    copies = _copies(most)
    return rows.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.col("_rate").alias("rate"), copies.alias("copies"),
        (copies * F.col("_size")).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as :func:`mix` takes it; texts are not shuffled."""
    plan = mixing_plan(_sizes(docs, id_col, text_col, source_col), weights, most, seed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = _keyed(docs.select(whole), f"_doc.{source_col}")
    rows = rows.withColumns({"_id": F.col(f"_doc.{id_col}"), "_size": words_in(F.col(f"_doc.{text_col}"))})
    rows = _rated(attach(rows, plan, _KEY, how="inner", rows=known_rows(plan)), most, seed).select("_doc", _copies(most).alias("_copies"))
    return rows.filter("_copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


@query("op9_mixing")
def op9(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
