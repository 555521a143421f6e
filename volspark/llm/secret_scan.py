"""Secret scans: fixed rules, and formats inferred from what they find (merged prefix-tree states)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from volspark.llm.common import Memo, bounded_batches, table
from volspark.llm.registry import query
from volspark.plans.storage import materialize

# The base rules.
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# The name of spans that the inferred formats add.
FORMAT = "format"

# Credentials learned from: so many distinct ones of each kind, none longer than LONGEST.
SAMPLE, LONGEST = 2000, 256
# Tokens that are scored: runs of at least LEAST of these characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST = 12
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
# A token is a secret when its best format is 2**BITS times as likely as the corpus' own tokens.
BITS = 16.0
# Confidence of the test that keeps states apart.
ALPHA = 0.01
# The corpus' own tokens: shares of pairs, of single symbols, and of any symbol whatever.
PAIR_SHARE, SINGLE_SHARE, LEAST_SHARE = 0.6, 0.3, 0.1
# Above this, tokens are scored one at a time.
_LONG = 512

SYMBOLS = len(ALPHABET)
END = SYMBOLS
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SYMBOLS)


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, credential) of the fixed rules, each leftmost and without overlaps of its own kind."""
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [(*m.span(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), 1, m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), 2, m[0]) for m in _HEX.finditer(text)]
    return out


def candidates(text: str, base: Sequence[tuple]) -> list[tuple[int, int]]:
    """Spans of tokens outside the base spans."""
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    if base:
        found = [(s, e) for s, e in found if not any(s < m[1] and m[0] < e for m in base)]
    return found


class Automaton:
    """A deterministic automaton with a probability for every symbol, and for the end, in every state.

    State 0 is the start.  What a state never saw leads to the last state, from where every symbol costs more than the
    corpus' own tokens can: a token that leaves a format wins nothing by its length.
    """

    def __init__(self, counts: list[Counter], moves: list[dict[int, int]]):
        n = len(counts)
        self.next = np.full((n + 1, SYMBOLS), n, np.int32)
        self.bits = np.full((n + 1, SYMBOLS + 1), math.log2(LEAST_SHARE / 2 / (SYMBOLS + 1)))
        for s, (seen, to) in enumerate(zip(counts, moves)):
            weight = np.full(SYMBOLS + 1, 0.5 / (SYMBOLS + 1))
            for symbol, times in seen.items():
                weight[symbol] += times
            self.bits[s] = np.log2(weight / weight.sum())
            for symbol, target in to.items():
                self.next[s, symbol] = target

    def score(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log2 of the likelihood of each token; tokens go side by side, the longest first."""
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order))
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = np.searchsorted(-sizes, -step, side="left")
            if sizes[0] > _LONG and live < 4:
                for row in range(live):
                    total[row], state[row] = self._one(codes[starts[row] + step : starts[row] + sizes[row]], state[row], total[row])
                break
            symbol = codes[starts[:live] + step]
            total[:live] += self.bits[state[:live], symbol]
            state[:live] = self.next[state[:live], symbol]
        total += self.bits[state, END]
        out = np.empty(len(order))
        out[order] = total
        return out

    def _one(self, codes: np.ndarray, state: int, total: float) -> tuple[float, int]:
        bits, moves = self.bits, self.next
        for symbol in codes.tolist():
            total += bits[state, symbol]
            state = moves[state, symbol]
        return total, state


def _apart(k1: int, n1: int, k2: int, n2: int, margin: float) -> bool:
    """Whether two shares differ by more than Hoeffding's bound."""
    return abs(k1 / n1 - k2 / n2) > margin * (n1**-0.5 + n2**-0.5)


def infer_automaton(words: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """Merge the states of the words' prefix tree that are statistically alike.

    States are kept (red) or open (blue, one step from a kept one).  An open state, the most visited first, is merged with
    the first kept state whose shares of symbols and ends agree with its own, here and along all of its continuations;
    else it is kept.  Merging adds counts and folds the subtree in.  The order of words does not matter.
    """
    seen: list[Counter] = [Counter()]
    moves: list[dict[int, int]] = [{}]
    for word in words:
        at = 0
        for symbol in _CODE[np.frombuffer(word.encode("ascii"), np.uint8)].tolist():
            seen[at][symbol] += 1
            if symbol not in moves[at]:
                moves[at][symbol] = len(seen)
                seen.append(Counter())
                moves.append({})
            at = moves[at][symbol]
        seen[at][END] += 1
    margin = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(kept: int, other: int) -> bool:
        todo = [(kept, other)]
        while todo:
            a, b = todo.pop()
            na, nb = seen[a].total(), seen[b].total()
            if any(_apart(seen[a][s], na, seen[b][s], nb, margin) for s in seen[a].keys() | seen[b].keys()):
                return False
            todo += [(moves[a][s], t) for s, t in moves[b].items() if s in moves[a]]
        return True

    def fold(kept: int, other: int) -> None:
        todo = [(kept, other)]
        while todo:
            a, b = todo.pop()
            seen[a].update(seen[b])
            for s, t in moves[b].items():
                if s in moves[a]:
                    todo.append((moves[a][s], t))
                else:
                    moves[a][s] = t

    red = [0]
    kept = {0}
    while True:
        # ties go by the way from the kept states, which does not hang on the order of words
        blue = [(-seen[t].total(), i, s, r, t) for i, r in enumerate(red) for s, t in moves[r].items() if t not in kept]
        if not blue:
            break
        _, _, symbol, source, state = min(blue)
        twin = next((r for r in red if alike(r, state)), None)
        if twin is None:
            red.append(state)
            kept.add(state)
        else:
            moves[source][symbol] = twin
            fold(twin, state)
    number = {r: i for i, r in enumerate(red)}
    return Automaton([seen[r] for r in red], [{s: number[t] for s, t in moves[r].items()} for r in red])


def background(pairs: dict[int, int]) -> Automaton:
    """The corpus' own tokens: how often each symbol, or the end, follows each.  State 0 is the start, 1 + s follows s.

    Pairs are mixed with single symbols and an even share, so that a rare pair is not taken for an impossible one.
    """
    width = SYMBOLS + 1
    seen = np.zeros((width, width))
    for cell, times in pairs.items():
        seen[cell // width, cell % width] += times
    even = np.full((1, width), 1 / width)
    single = seen.sum(0, keepdims=True) / seen.sum() if seen.any() else even
    total = seen.sum(1, keepdims=True)
    pair = np.where(total > 0, seen / np.maximum(total, 1), single)
    out = Automaton([Counter()] * width, [{s: 1 + s for s in range(SYMBOLS)}] * width)
    out.bits[:width] = np.log2(PAIR_SHARE * pair + SINGLE_SHARE * single + LEAST_SHARE * even)
    return out


def _joined(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = _CODE[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return codes, np.cumsum(lengths) - lengths, lengths


def odds(tokens: list[str], formats: Sequence[Automaton], own: Automaton) -> np.ndarray:
    """Bits by which the best format is likelier than the corpus."""
    parts = _joined(tokens)
    return np.max([f.score(*parts) for f in formats], axis=0) - own.score(*parts)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for raw in batch.column("_text").to_pylist():
        yield raw.decode("utf-8", "replace") if raw else ""


def labelled_credentials(texts: DataFrame) -> DataFrame:
    """kind and value of all credentials the base rules find, and, per task, pairs of symbols in all other tokens (kind -1)."""
    schema = "kind int, value string, cell int, n bigint"
    arrow = to_arrow_schema(texts.sparkSession.createDataFrame([], schema).schema)

    def batch(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = SYMBOLS + 1
        pairs = np.zeros(width * width, np.int64)
        for b in batches:
            kinds, values, tokens = [], [], []
            for text in _texts(b):
                base = base_matches(text)
                tokens += [text[s:e] for s, e in candidates(text, base)]
                for _, _, kind, value in base:
                    if len(value) <= LONGEST:
                        kinds.append(kind)
                        values.append(value)
            if tokens:
                codes, starts, lengths = _joined(tokens)
                before = np.concatenate([[0], codes[:-1] + 1])
                before[starts] = 0
                pairs += np.bincount(before * width + codes, minlength=len(pairs))
                pairs += np.bincount((codes[starts + lengths - 1] + 1) * width + END, minlength=len(pairs))
            if kinds:
                none = [None] * len(kinds)
                yield batch(kinds, values, none, none)
        cells = np.flatnonzero(pairs)
        if len(cells):
            yield batch([-1] * len(cells), [None] * len(cells), cells.tolist(), pairs[cells].tolist())

    return texts.select("_text").mapInArrow(run, schema)


def learn_formats(texts: DataFrame, sample: int = SAMPLE) -> tuple[list[Automaton], Automaton]:
    """An automaton for each kind of credential, and that of all other tokens.

    Pairs are counted over all texts.  The automata learn from at most ``sample`` distinct credentials of a kind, those
    with the smallest hashes, of at most LONGEST characters; a credential in many copies counts once.
    """
    found = materialize(labelled_credentials(texts), "credentials")
    pairs = {r["cell"]: r["n"] for r in found.filter("kind = -1").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    values = found.filter("kind >= 0").select("kind", "value").distinct()
    formats = []
    for kind in range(len(KINDS)):
        rows = values.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        if rows:
            formats.append(infer_automaton(r["value"] for r in rows))
    return formats, background(pairs)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: float = BITS) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_format, base_sha256, spans for every row.

    Base rules: a keyword, ``:`` or ``=`` and a value of 8 or more characters (the span is the whole match); access keys of
    16 or more; lower-case hexadecimal runs of 32 or more.  What they find are the labelled credentials of the corpus:
    probabilistic automata are inferred from them, and every other token of 12 or more characters is scored by the
    likelihood of its best format against that of the corpus' tokens.  Tokens that reach ``bits`` are added as ``format``
    spans; they never overlap base spans, which all stay.  Two passes over the texts; no text is shuffled.

    ``spans`` lists kind:start:end by start, then kind (assign, access, hex, format), joined by commas, in code points,
    the end exclusive; ``base_sha256`` is the digest of that list without format spans.  Null texts count as empty; an
    empty text has no spans (an empty string).  Very long texts are scanned whole.  Rows that repeat, or have no id,
    give a row each.  Where the rules find nothing, no format is known and nothing is added.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    formats, own = learn_formats(texts, sample)
    names = (*KINDS, FORMAT)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base_sha256 string, spans string"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def listed(spans: Iterable[tuple[int, int, int]]) -> str:
        return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in sorted((s, k, e) for s, e, k in spans))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(None, 200_000, 64)
        for b in batches:
            base, tokens = [], []
            for text in _texts(b):
                found = base_matches(text)
                base.append([m[:3] for m in found])
                tokens.append([(s, e, text[s:e]) for s, e in candidates(text, found)] if formats else [])
            fresh = list({t for row in tokens for *_, t in row if t not in known})
            score = dict(zip(fresh, odds(fresh, formats, own).tolist())) if fresh else {}
            value = lambda t: score[t] if t in score else known[t]  # noqa: E731, B023
            added = [[(s, e, len(KINDS)) for s, e, t in row if value(t) >= bits] for row in tokens]
            known.keep(score)
            counts = [Counter(k for *_, k in row) for row in base]
            columns = [
                *([c[k] for c in counts] for k in range(len(KINDS))),
                [len(row) for row in added],
                [hashlib.sha256(listed(row).encode()).hexdigest() for row in base],
                [listed(row + more) for row, more in zip(base, added)],
            ]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return texts.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


@query("op11_secret_scan")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))
