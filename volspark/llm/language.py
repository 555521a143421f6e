"""Language identification with error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import bounded_batches, has_letter, remainder, table, uniform
from volspark.llm.registry import query
from volspark.plans.joins import attach
from volspark.plans.storage import known_rows, materialize

UNKNOWN = "und"
# Hashed n-grams of 1 to 4 bytes, each length in a block of its own.
BLOCK = 1024
SIZES = (1, 2, 3, 4)
WIDTH = BLOCK * len(SIZES)
# Rows that the bit classifiers learn from, about; chosen by hashes of ids and texts.
SAMPLE, LEAST_SAMPLE = 2000, 20
# Below this difference of mean losses of the two nearest codewords a prediction is ambiguous.
MARGIN = 0.08
_MIX = np.uint32(2654435761)


def _folded(raw: bytes) -> np.ndarray:
    return np.frombuffer(b" " + raw.lower() + b" ", np.uint8)


def gram_counts(raw: bytes) -> np.ndarray:
    """Hashed n-gram counts of a whole text, scaled to unit length after a square root."""
    b = _folded(raw).astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    parts = []
    for n in SIZES:
        if len(b) < n:
            parts.append(np.zeros(BLOCK))
            continue
        code = code[: len(b) - n + 1] | (b[n - 1 :] << np.uint32(8 * (n - 1)))
        at = code if n == 1 else (code * _MIX) >> np.uint32(22)
        parts.append(np.bincount(at, minlength=BLOCK))
    x = np.sqrt(np.concatenate(parts))
    return (x / max(np.sqrt((x * x).sum()), 1e-9)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all different splits of up to five classes, else the best of many random codes."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 5:
        cols = [[1 if not k or (c >> (k - 1)) & 1 else -1 for k in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - code.astype(np.int32) @ code.T) // 2
        least = (apart + bits * np.eye(n, dtype=int)).min()
        if least > most and not (np.abs(code.sum(0)) == n).any():
            best, most = code, least
    return best if best is not None else code


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by logistic loss: index, score and whether the next one is too near."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :])
        total = loss.sum(2)
        odds = np.exp(-(total - total.min(1, keepdims=True)))
        score = (odds / odds.sum(1, keepdims=True)).max(1)
        if len(self.langs) == 1:
            return np.zeros(len(x), int), score, np.zeros(len(x), bool)
        two = np.partition(total, 1, axis=1)[:, :2] / self.code.shape[1]
        return total.argmin(1), score, (two[:, 1] - two[:, 0]) < MARGIN


def train(x: np.ndarray, langs: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> Model | None:
    """One logistic classifier per bit, all bits at once, by accelerated gradient steps; classes weigh alike."""
    names = sorted(set(langs))
    if not names:
        return None
    code = codewords(len(names))
    y = np.array([names.index(v) for v in langs])
    share = np.bincount(y, minlength=len(names))
    weight = (1.0 / share[y] / len(names)).astype(np.float32)[:, None]
    target = code[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate = w.copy(), b.copy(), 6.0
    for k in range(rounds):
        look_w, look_b = w + 0.9 * vw, b + 0.9 * vb
        pull = -target / (1 + np.exp(np.clip(target * (x @ look_w + look_b), -30, 30))) * weight
        vw = 0.9 * vw - rate * (x.T @ pull + ridge * look_w)
        vb = 0.9 * vb - rate * 0.1 * pull.sum(0)
        w, b = w + vw, b + vb
    return Model(names, code, w, b)


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [gram_counts(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(grams, pa.binary())], ["lang", "grams"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, folds: int = 4, held: int = 2) -> Model | None:
    """Fit on about ``sample`` texts outside the held-out fold, as many of each language (LEAST_SAMPLE at least); None without any.

    Texts are chosen by their own hashes, language by language, so a rare language is learned too and copies under other ids
    neither change the choice nor fill the sample.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.coalesce(remainder(F.col("_id"), folds) != held, F.lit(False)))
    rows = rows.filter(F.col("text").isNotNull()).withColumn("_h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))
    counts = materialize(counts, "languages")
    each = max(LEAST_SAMPLE, sample // max(1, known_rows(counts)))
    picked = attach(rows, counts, "lang").filter(uniform("_h", seed="sample") < each / F.col("_n"))
    # equal texts count once, under the smallest language given
    picked = picked.groupBy("_h").agg(F.min("lang").alias("lang"), F.min(F.col("text").cast("binary")).alias("text"))
    pdf = picked.select("lang", "text").mapInArrow(_sample_batches, "lang string, grams binary").toPandas()
    if not len(pdf):
        return None
    x = np.empty((len(pdf), WIDTH), np.float32)
    for k, grams in enumerate(pdf.pop("grams")):
        x[k] = np.frombuffer(grams, np.float16)
    return train(x, pdf["lang"].to_numpy())


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, block: int = 512) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, block):
            batch = whole.slice(start, block)
            texts = [t.as_py() for t in batch.column("_text")]
            known = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
            lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known:
                at, sure, near = model.decode(np.stack([gram_counts(texts[k]) for k in known]))
                for k, i in zip(known, at, strict=True):
                    lang[k] = model.langs[i]
                score[known], unsure[known] = sure, near
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure)], [*names, "lang_pred", "score", "ambiguous"]
            )


def predict_language(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred, score and ambiguous, from the whole text alone.

    A null text or one without a letter of any script is ``und`` with score 0 and ambiguous; so is every row if there was
    nothing to learn from.  ``keep`` may hold any columns but lang_pred, score and ambiguous; repeated rows are each
    predicted; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(partial(_predict, model=model), f"{fields}, lang_pred string, score double, ambiguous boolean")


@query("op6_language_id")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return predict_language(docs.select("doc_id", held, "text"), learn(docs), ["doc_id", "held_out"])


def accuracy(pred: pd.DataFrame, truth: pd.Series) -> float:
    """Share of held-out rows with a language whose prediction is right."""
    rows = pred["held_out"].to_numpy() & truth.notna().to_numpy()
    return float((pred["lang_pred"].to_numpy()[rows] == truth.to_numpy()[rows]).mean())
