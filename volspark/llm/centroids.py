"""Centroid clustering in exact integers, with bounds loosened by the norm of total displacement (ns-bounds)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from volspark.llm.common import table
from volspark.llm.registry import query
from volspark.plans.storage import materialize, measured, release

# A component is floor(SCALE * x).
SCALE = 1024
# Above this a squared distance of 64 components no longer fits a long.
LARGEST = 1 << 27
# Bounds are doubles; they are widened by this share, far more than rounding can take away.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int) -> tuple[DataFrame, int]:
    """_id and v, the integer components of every whole and finite vector; and the largest size of a component."""
    x = F.col(vector_col).cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    longs = F.transform(x, lambda c: F.floor(c * SCALE))
    kept = rows.select(F.col(id_col).alias("_id"), F.when(whole, longs).alias("_v")).filter(F.col("_v").isNotNull())
    clipped = F.transform("_v", lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    size = F.array_max(F.transform("_v", lambda c: F.abs(F.greatest(c, F.lit(-LARGEST - 1)))))
    out, seen = measured(kept.select("_id", clipped.alias("v"), size.alias("_size")), "vectors", largest=F.max("_size"))
    return out.select("_id", "v"), seen["largest"] or 0


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; ties by the vector, vectors without an id last."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_id").cast("string")), 256)
    picked = vectors.select("v", digest.alias("_h")).orderBy(F.asc_nulls_last("_h"), "v").limit(k).collect()
    return np.array([row["v"] for row in picked], np.int64)


class Bounds:
    """The centroid history, and what it says of a distance that was last measured in an earlier round."""

    def __init__(self, history: list[np.ndarray]):
        self.now = history[-1]
        # _moved[r, j]: how far centroid j is from where it was in round r; one norm, not the sum of its steps
        self._moved = np.stack([np.sqrt(((self.now - then).astype(np.float64) ** 2).sum(1)) for then in history])

    def lower(self, squared: np.ndarray, rounds: np.ndarray, j: int) -> np.ndarray:
        return np.sqrt(squared) * (1 - SLACK) - self._moved[rounds, j] * (1 + SLACK)

    def upper(self, squared: np.ndarray, rounds: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (np.sqrt(squared) + self._moved[rounds, j]) * (1 + SLACK)


def _squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return np.einsum("ij,ij->i", gap, gap)


def reassign(
    x: np.ndarray, cluster: np.ndarray, seen: np.ndarray, at: np.ndarray, bounds: Bounds, now: int, measure_own: bool = False
) -> int:
    """Bring clusters up to date in place; returns how many distances were measured.

    ``seen[i, j]`` is the exact squared distance of vector i to centroid j as it stood in round ``at[i, j]``.  A vector
    stays without measuring when the upper bound of its own distance is below every other lower bound.  Else its own
    distance is measured and then those whose lower bound does not exceed it; the comparison itself is in integers.
    """
    n, k = seen.shape
    rows = np.arange(n)
    measured_ = 0

    def measure(which: np.ndarray, j: int) -> None:
        nonlocal measured_
        seen[which, j] = _squared(x[which], bounds.now[j])
        at[which, j] = now
        measured_ += len(which)

    fresh = cluster < 0
    for j in range(k):
        measure(np.flatnonzero(fresh), j)
    cluster[fresh] = seen[fresh].argmin(1)

    lower = np.stack([bounds.lower(seen[:, j], at[:, j], j) for j in range(k)], 1)
    lower[rows, cluster] = np.inf
    own = bounds.upper(seen[rows, cluster], at[rows, cluster], cluster)
    failed = ~fresh & (own >= lower.min(1))
    for j in range(k):
        stale = (cluster == j) & (at[:, j] != now)
        measure(np.flatnonzero(stale if measure_own else stale & failed), j)
    own = bounds.upper(seen[rows, cluster], at[rows, cluster], cluster)
    open_ = np.zeros((n, k), bool)
    open_[failed] = lower[failed] <= own[failed, None]
    for j in range(k):
        measure(np.flatnonzero(open_[:, j]), j)
    open_[rows, cluster] = True
    exact = np.where(open_, seen, np.iinfo(np.int64).max)
    # the first of equal distances is the smaller number
    cluster[failed] = exact[failed].argmin(1)
    if measure_own:
        for j in range(k):
            measure(np.flatnonzero((cluster == j) & (at[:, j] != now)), j)
    return measured_


def _rows_of(column: pa.Array, kind: type, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel())).cast(kind)


def _round(vectors: DataFrame, history: list[np.ndarray], last: bool) -> DataFrame:
    """One assignment.  Rows of vectors carry their state; each task adds one row per centroid with what it changed.

    ``change`` holds, for a centroid, the components that vectors brought in less those taken away, the change of the
    count, the distances measured and, in the last round, the sum of distances.
    """
    now, k, dims = len(history) - 1, len(history[-1]), history[-1].shape[1]
    kept = "" if last else "v array<int>, seen array<bigint>, at array<smallint>, "
    id_type = vectors.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, {kept}cluster int, distance bigint, change array<bigint>"
    started = "cluster" in vectors.columns
    arrow = to_arrow_schema(vectors.sparkSession.createDataFrame([], schema).schema)

    def batch(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        change = np.zeros((k, dims + 3), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _rows_of(b.column("v"), np.int64, n, dims)
            if started:
                seen, at = _rows_of(b.column("seen"), np.int64, n, k), _rows_of(b.column("at"), np.int16, n, k)
                cluster = b.column("cluster").to_numpy().astype(np.int64)
            else:
                seen, at, cluster = np.zeros((n, k), np.int64), np.zeros((n, k), np.int16), np.full(n, -1)
            before = cluster.copy()
            change[0, dims + 1] += reassign(x, cluster, seen, at, bounds, now, last)
            own = seen[np.arange(n), cluster]
            for j in range(k):
                came, went = (cluster == j) & (before != j), (before == j) & (cluster != j)
                change[j, :dims] += x[came].sum(0) - x[went].sum(0)
                change[j, dims] += came.sum() - went.sum()
                change[j, dims + 2] += own[cluster == j].sum() if last else 0
            state = {} if last else {"v": b.column("v"), "seen": _lists(seen, arrow.field("seen").type), "at": _lists(at, arrow.field("at").type)}
            extra = {"distance": pa.array(own)} if last else {}
            yield batch(_id=b.column("_id"), cluster=pa.array(cluster), **state, **extra)
        if change.any():
            yield batch(cluster=pa.array(np.arange(k)), change=_lists(change, arrow.field("change").type))

    return vectors.mapInArrow(run, schema)


def _changes(step: DataFrame, width: int) -> dict[int, list[int]]:
    """The changes of all tasks, per centroid: at most k x width numbers."""
    cells = step.filter("change IS NOT NULL").select("cluster", F.posexplode("change").alias("at", "amount"))
    out: dict[int, list[int]] = {}
    for r in cells.groupBy("cluster", "at").agg(F.sum("amount").alias("amount")).collect():
        out.setdefault(r["cluster"], [0] * width)[r["at"]] = r["amount"]
    return out


def ns_clusters(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, salt: str = "3", report: dict | None = None
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every whole and finite vector.

    Components become integers floor(1024 * x), so distances, sums and ties are exact and reruns agree.  Each round is one
    pass: a vector keeps the exact distances it measured and the rounds it measured them in; the history of all centroids
    (rounds x k x dims numbers) turns them into bounds, loosened by the norm of the centroid's total displacement since
    then.  Only vectors whose bounds fail are measured again.  Sums are kept up by what joined and left a cluster, one row
    per task and centroid.  States are written tables; the one before is deleted when the next is there.

    Vectors that are null, of another length, or hold a null or non-finite component are left out.  Rows that repeat are
    vectors of their own; of equal hashes the smaller vector starts first, and vectors without an id start last.  With
    fewer than k vectors there are fewer centroids; without any the result is empty.  Extra columns are ignored.  A
    component beyond 2**27 raises, as squared distances would no longer fit a long.  ``report`` receives the number of
    distances measured in each round.
    """
    vectors, largest = integer_vectors(rows, id_col, vector_col, dims)
    if largest > LARGEST:
        raise ValueError(f"a component of {SCALE} * x is beyond {LARGEST}: squared distances would not fit a long")
    spark = rows.sparkSession
    start = first_centroids(vectors, k, salt)
    if not len(start):
        nothing = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        id_type = rows.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {id_type}, {nothing}")
    history, sums, written = [start], np.zeros((len(start), dims + 1), object), vectors
    for now in range(rounds + 1):
        step = materialize(_round(vectors, history, now == rounds), "clusters")
        release(written)
        written, changes = step, _changes(step, dims + 3)
        for j, change in changes.items():
            sums[j] += np.array(change[: dims + 1], object)
        if report is not None:
            report[now] = sum(change[dims + 1] for change in changes.values())
        if now < rounds:
            history.append(np.array([s[:dims] // s[dims] if s[dims] else old for s, old in zip(sums, history[-1])]).astype(np.int64))
            vectors = step.filter("change IS NULL").select("_id", "v", "cluster", "seen", "at")
    inertia = {j: change[dims + 2] for j, change in changes.items()}
    per = [(j, inertia.get(j, 0), ",".join(map(str, c))) for j, c in enumerate(history[-1].tolist())]
    known = F.array(*(F.struct(F.lit(i).cast("long").alias("inertia"), F.sha2(F.lit(text).cast("binary"), 256).alias("sha")) for _, i, text in per))
    mine = known[F.col("cluster")]
    return step.filter("change IS NULL").select(
        F.col("_id").alias(id_col),
        "cluster",
        "distance",
        mine["inertia"].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        mine["sha"].alias("centroid_sha256"),
    )


def _sql(k: int, rounds: int) -> str:
    """The same rounds as a chain of tables."""
    parts = [
        """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT r, vec_id, v, k, d FROM (
    SELECT r, vec_id, v, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS best FROM (
      SELECT r, vec_id, v, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept, c{t})) WHERE best = 1)""")
        if t < rounds:
            parts.append(f"""s{t} AS (
  SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) AS g(i) GROUP BY k, i),
m{t} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{t} GROUP BY k),
c{t + 1} AS MATERIALIZED (SELECT c{t}.k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON c{t}.k = m{t}.k)""")
    return (
        ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.k = c.k"""
    )


@query("op13_centroids", _sql(8, 10))
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ns_clusters(table(spark, folder, "embeddings"))
