"""Quality score: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import bounded_batches, hashed_sample, remainder, table
from volspark.llm.registry import query
from volspark.plans.storage import materialize

# Labelled rows that the trees learn from, about; chosen by hashes of their ids.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 80, 5, 64, 0.15, 10
# Common short words of the four languages.
STOP = frozenset(
    b"the of and to in is it that for on with as was by at be this are a an or from not le la les de des et en un une du que qui dans pour "
    b"der die das und ist nicht ein eine zu den von mit auf el los las y es por con para del al lo".split()
)
NAMES = (
    "log_bytes", "log_words", "mean_word", "word_spread", "distinct", "stop", "upper", "lower", "digit", "space", "newline", "high",
    "period", "comma", "bang", "pipe", "hash", "percent", "star", "slash", "at", "brackets", "quotes", "other", "entropy", "log_lines",
    "line_repeat", "line_end", "longest_line", "capital_words", "symbol_words", "top_word", "long_words",
)


def statistics(raw: bytes | None) -> np.ndarray:
    """The numbers of ``NAMES`` for a whole text; null counts as empty."""
    out = np.zeros(len(NAMES), np.float32)
    raw = raw or b""
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(len(words), 1)
    folded = raw.lower().split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for w in folded:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    share = counts[counts > 0] / n
    symbol = sum(1 for w in words if not w[:1].isalpha() and w[0] < 128)
    out[:] = (
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), len(tally) / m, sum(tally.get(s, 0) for s in STOP) / m,
        counts[65:91].sum() / n, counts[97:123].sum() / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / n, counts[128:].sum() / n,
        counts[46] / n, counts[44] / n, counts[33] / n, counts[124] / n, counts[35] / n, counts[37] / n, counts[42] / n, counts[47] / n, counts[64] / n,
        counts[[40, 41, 60, 62, 91, 93, 123, 125]].sum() / n, counts[[34, 39, 96]].sum() / n,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n, float(-(share * np.log2(share)).sum()),
        np.log1p(len(lines)), 1 - len(set(lines)) / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, max(map(len, lines), default=0) / n,
        sum(1 for w in words if w[:1].isupper()) / m, symbol / m, max(tally.values(), default=0) / m, float((sizes > 14).mean()),
    )
    return out


@dataclass
class Trees:
    """All trees of a forest in flat arrays: node k of tree t sits at row t; children of k are 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.cut[t, at]))
            total += self.value[t, at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _best_splits(codes, grad, hess, node, n_nodes, ridge=1.0, least=LEAST):
    """For every open node the best (gain, feature, bin), from one histogram per feature."""
    gain, feature, at = np.full(n_nodes, 1e-6), np.full(n_nodes, -1), np.zeros(n_nodes, int)
    for f in range(codes.shape[1]):
        key = node * BINS + codes[:, f]
        g = np.bincount(key, grad, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)
        h = np.bincount(key, hess, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)
        c = np.bincount(key, minlength=n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)
        all_g, all_h, all_c = g[:, -1:], h[:, -1:], c[:, -1:]
        won = g * g / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
        won[(c < least) | (all_c - c < least)] = 0
        k = won.argmax(1)
        best = won[np.arange(n_nodes), k]
        better = best > gain
        gain[better], feature[better], at[better] = best[better], f, k[better]
    return feature, at


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boost on the logistic loss; features are binned at quantiles once, splits are found in histograms."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.full((1, nodes), -1), np.zeros((1, nodes)), np.zeros((1, nodes)), base, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    feature, cut, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for d in range(depth):
            first, n = 2**d - 1, 2**d
            open_ = at >= first
            f, k = _best_splits(codes[open_], grad[open_], hess[open_], at[open_] - first, n)
            for i in np.flatnonzero(f >= 0):
                if k[i] < len(edges[f[i]]):
                    feature[t, first + i], cut[t, first + i] = f[i], edges[f[i]][k[i]]
            own = feature[t, at]
            go = open_ & (own >= 0)
            at[go] = 2 * at[go] + 1 + (x[go, own[go]] > cut[t, at[go]])
        g, h = np.bincount(at, grad, nodes), np.bincount(at, hess, nodes)
        value[t] = rate * g / (h + 1.0)
        margin += value[t, at]
    return Trees(feature, cut, value, base, depth)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float32())
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, kind)], ["_id", "_stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _stats for every row and its whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(_measure, f"_id {rows.schema['_id'].dataType.simpleString()}, _stats array<float>")


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE, folds: int = 3, held: int = 1) -> Trees:
    """Fit on about ``sample`` labelled rows outside the held-out fold; an id with several labels counts by the largest."""
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col(id_col), folds) != held))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    known = hashed_sample(known, ["_id"], sample)
    pdf = stats.join(known, "_id").select("_id", "_y", "_stats").dropDuplicates(["_id"]).toPandas().sort_values("_id")
    x = np.stack(pdf["_stats"].to_list()).astype(np.float32) if len(pdf) else np.zeros((0, len(NAMES)), np.float32)
    return train(x, pdf["_y"].to_numpy(dtype=np.float64))


def _score(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.asarray(batch.column("_stats").flatten(), np.float32)
        score = trees.score(flat.reshape(batch.num_rows, len(NAMES)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["_id", "score", "predicted"]
        )


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 3, held: int = 1
) -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``.

    The statistics of every whole text are computed once and written; the trees learn from labelled rows outside the held-out
    fold and score all rows.  Nothing but the text enters a score: a null text scores as an empty one, repeated rows score
    alike, null ids are scored and never held out.  Without labels the score is 0.5; with one class only it is the
    share of that class, kept within 0.001 of the ends.  Extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    stats = materialize(document_statistics(docs, id_col, text_col), "quality")
    trees = learn(stats, labels, label, id_col, folds=folds, held=held)
    scored = stats.mapInArrow(partial(_score, trees=trees), f"_id {stats.schema['_id'].dataType.simpleString()}, score double, predicted int")
    held_out = F.coalesce(remainder(F.col("_id"), folds) == held, F.lit(False))
    return scored.select(F.col("_id").alias(id_col), held_out.alias("held_out"), "score", "predicted")


@query("op3_quality")
def op3(spark, folder):
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
