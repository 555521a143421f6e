"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, shingle anchors, exact weighted shingles."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import WordHashes, bounded_batches, table
from volspark.llm.registry import query

# Words of a shingle and the least weighted similarity that counts as a copy.
SHINGLE, LEAST = 5, 0.8
# Fingerprints of 64 bits in BLOCKS blocks; of RADIUS differing bits some block has at most RADIUS // BLOCKS.
BLOCKS, RADIUS = 4, 11
# Items of more words are fingerprinted by windows of this many, laid side by side over the item.
MAX_WINDOW = 64
# Items of one pass over the documents; more items take more passes.
ITEM_BLOCK = 20_000
_WORD = re.compile(r"\w+")
_CHUNK = 16_384
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def shingle_weights(words: list[str], size: int = SHINGLE) -> Counter:
    """Shingles with their numbers of occurrences; fewer words than a shingle are one shingle."""
    n = min(size, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def window_size(n: int) -> int:
    """Words of the window that stands for an item of n words: n, rounded down to a grid of steps of a twelfth, so that many
    items share a size."""
    if n >= MAX_WINDOW:
        return MAX_WINDOW
    return n - n % max(1, n // 12)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word and the next one, the features of a fingerprint."""
    x = h[:-1] * _P + h[1:]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each SHINGLE words in a row."""
    count = max(len(h) - SHINGLE + 1, 0)
    x = h[:count].copy()
    for k in range(1, SHINGLE):
        x *= _P
        x += h[k : k + count]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fingerprints(pairs: np.ndarray, count: int, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, SimHash of the ``size``-word window at each of the first ``count`` places), sizes ascending.

    Bit b of a fingerprint is the majority of the bits b of the window's features.  The counts of all 64 bits are kept as
    binary digits, one word of 64 bits per digit, so a longer window costs a few bitwise operations per place.  ``pairs`` holds
    at least count + max(sizes) - 2 features.
    """
    planes: list[np.ndarray] = []
    spare, carry, third = (np.empty(count, np.uint64) for _ in range(3))
    added = 0
    for size in sizes:
        features = max(size - 1, 0)
        while added < features:
            two = added + 2 <= features
            while (added + 1 + two).bit_length() > len(planes):
                planes.append(np.zeros(count, np.uint64))
            into, low = pairs[added : added + count], planes[0]
            if two:
                # one full adder takes two features into the lowest digit
                more = pairs[added + 1 : added + 1 + count]
                np.bitwise_xor(low, into, out=spare)
                np.bitwise_and(low, into, out=carry)
                np.bitwise_and(spare, more, out=third)
                np.bitwise_or(carry, third, out=carry)
                np.bitwise_xor(spare, more, out=low)
            else:
                np.bitwise_and(low, into, out=carry)
                np.bitwise_xor(low, into, out=low)
            for p in planes[1:-1]:
                np.bitwise_and(p, carry, out=spare)
                np.bitwise_xor(p, carry, out=p)
                carry, spare = spare, carry
            if len(planes) > 1:
                np.bitwise_xor(planes[-1], carry, out=planes[-1])
            added += 1 + two
        least = features // 2 + 1
        out = np.full(count, ~np.uint64(0) if features else 0, np.uint64)
        for k, p in enumerate(planes):
            (np.bitwise_and if least >> k & 1 else np.bitwise_or)(out, p, out=out)
        yield size, out


class Index:
    """Fingerprints of the items by window size, each size with a table per block of all values near enough.

    Items of SHINGLE words and more also have anchors: so many of their shingles, the rarest among the items, that a text of
    similarity LEAST must share one of them.  Anchors lose no window, wherever the copy was cut or reworded.
    """

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.radius = radius
        self.items: list[tuple[int, list[str], Counter]] = []
        entries: dict[int, list[tuple[int, int, int]]] = {}
        own: dict[int, np.ndarray] = {}
        hashes = WordHashes()
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            n, w = len(words), window_size(len(words))
            pairs = pair_hashes(np.append(hashes.of(words), np.uint64(0)))
            for offset in range(0, n - w + 1, w):
                mark = next(fingerprints(pairs[offset:], 1, [w]))[1][0]
                entries.setdefault(w, []).append((int(mark), len(self.items), offset))
            if n >= SHINGLE:
                own[len(self.items)] = shingle_hashes(hashes.of(words))
            self.items.append((item_id, words, shingle_weights(words)))
        self._anchor(own)
        self.sizes = sorted(entries)
        self.marks = {w: np.array([e[0] for e in rows], np.uint64) for w, rows in entries.items()}
        self.where = {w: [e[1:] for e in rows] for w, rows in entries.items()}
        bits, reach = 64 // BLOCKS, radius // BLOCKS
        near = np.array([sum(1 << b for b in c) for r in range(reach + 1) for c in combinations(range(bits), r)], np.uint16)
        self.tables = {}
        for w, marks in self.marks.items():
            tables = np.zeros((BLOCKS, 1 << bits), bool)
            parts = marks.view(np.uint16).reshape(-1, BLOCKS)
            for b in range(BLOCKS):
                tables[b, (parts[:, b, None] ^ near[None, :]).ravel()] = True
            self.tables[w] = tables

    def _anchor(self, own: dict[int, np.ndarray]) -> None:
        """Sorted anchors with their items, a bit table before them, and the distinct shingles of each anchored item."""
        self.shingles = {item: np.unique(x) for item, x in own.items()}
        held = Counter(s for x in self.shingles.values() for s in x.tolist())
        rows = []
        for item, x in own.items():
            # at most len(x) - least shingles are not shared, so of one more at least one is
            some = len(x) - math.ceil(LEAST * len(x) - 1e-9) + 1
            rows += [(s, item) for s in set(sorted(x.tolist(), key=held.__getitem__)[:some])]
        rows.sort()
        self.anchors = np.array([s for s, _ in rows], np.uint64)
        self.owners = np.array([item for _, item in rows], np.int64)
        self.low = np.uint64((1 << max(16, (8 * len(rows)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.low) + 1, bool)
        self.maybe[self.anchors & self.low] = True

    def _anchored(self, shingles: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> first and last place in the joined texts where the text holds an anchor of the item."""
        at = np.flatnonzero(self.maybe[shingles & self.low])
        left, right = (np.searchsorted(self.anchors, shingles[at], side) for side in ("left", "right"))
        text = np.searchsorted(ends, at, "right")
        good = (right > left) & (at + SHINGLE <= ends[np.minimum(text, len(ends) - 1)]) & (text < len(ends))
        spans: dict[tuple[int, int], tuple[int, int]] = {}
        for place, k, a, b in zip(*(x[good].tolist() for x in (at, text, left, right)), strict=True):
            for item in self.owners[a:b].tolist():
                spans[k, item] = (spans.get((k, item), (place,))[0], place)
        return spans

    def _near(self, size: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose fingerprint is within the radius of an entry, and that entry."""
        parts, tables = marks.view(np.uint16).reshape(-1, BLOCKS), self.tables[size]
        hit = tables[0].take(parts[:, 0])
        for b in range(1, BLOCKS):
            hit |= tables[b].take(parts[:, b])
        at = np.flatnonzero(hit)
        if not len(at):
            return at, at
        near = marks[at]
        places, entries = [], []
        for e, mark in enumerate(self.marks[size]):
            k = at[np.bitwise_count(near ^ mark) <= self.radius]
            places.append(k)
            entries.append(np.full(len(k), e))
        return np.concatenate(places), np.concatenate(entries)

    def matches(self, texts: list[list[str]], hashes: WordHashes, least: float = LEAST) -> list[dict[int, tuple[float, int, int]]]:
        """Per text, item -> (similarity, start, words) of its best window; of equals the first."""
        found: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        if not self.sizes:
            return found
        ends = np.cumsum([len(t) for t in texts])
        most = self.sizes[-1]
        flat = np.concatenate([hashes.of(t) for t in texts] + [np.zeros(most + 1, np.uint64)]) if texts else np.zeros(0, np.uint64)
        pairs = pair_hashes(flat)
        total = int(ends[-1]) if len(ends) else 0
        seen = set()
        for start in range(0, total, _CHUNK):
            count = min(_CHUNK, total - start)
            for size, marks in fingerprints(pairs[start:], count, self.sizes):
                for at, e in zip(*self._near(size, marks), strict=True):
                    k = int(np.searchsorted(ends, start + at, "right"))
                    item, offset = self.where[size][e]
                    first = int(start + at) - int(ends[k] - len(texts[k])) - offset
                    seen.add((k, item, first))
        for k, item, first in seen:
            n, m = len(self.items[item][1]), len(texts[k])
            # a text shorter than the item is one window; else the window is item-sized and lies inside
            begin = min(max(first, 0), max(m - n, 0))
            self._verify(found[k], item, texts[k], begin, least)
        for k, words in enumerate(texts):
            if words:
                self._whole(found[k], words, hashes, least)
        if len(self.anchors) and total:
            shingles = shingle_hashes(flat)
            for (k, item), (first, last) in self._anchored(shingles, ends).items():
                begin = int(ends[k]) - len(texts[k])
                self._around(found[k], item, texts[k], shingles[begin : int(ends[k])], first - begin, last - begin, least)
        return found

    def _verify(self, found: dict, item: int, words: list[str], begin: int, least: float) -> None:
        _, own, weights = self.items[item]
        window = words[begin : begin + len(own)]
        alike = similarity(shingle_weights(window), weights)
        if alike >= least and (item not in found or (alike, -begin) > (found[item][0], -found[item][1])):
            found[item] = (alike, begin, len(window))

    def _around(self, found: dict, item: int, words: list[str], shingles: np.ndarray, first: int, last: int, least: float) -> None:
        """The windows that hold a shingle between two places, most promising first, as long as one can be the best."""
        n, m = len(self.items[item][1]), len(words)
        low, high = (0, 0) if m <= n else (max(first - (n - SHINGLE), 0), min(last, m - n))
        whole, size = n - SHINGLE + 1, min(n, m) - SHINGLE + 1
        sums = np.append(0, np.cumsum(np.isin(shingles[low : high + size], self.shingles[item])))
        both = sums[size:] - sums[:-size]
        most = both / (whole + size - both)
        for k in np.argsort(-most, kind="stable"):
            if most[k] < max(least, found.get(item, (0.0,))[0]):
                break
            self._verify(found, item, words, low + int(k), least)

    def _whole(self, found: dict, words: list[str], hashes: WordHashes, least: float) -> None:
        """A text that is somewhat shorter than an item: the whole text is the window."""
        m = len(words)
        mark = None
        for w in self.sizes:
            if w <= m or m < 0.75 * w:
                continue
            if mark is None:
                mark = next(fingerprints(pair_hashes(np.append(hashes.of(words), np.uint64(0))), 1, [m]))[1][0]
            for e in np.flatnonzero(np.bitwise_count(self.marks[w] ^ mark) <= 2 * self.radius):
                self._verify(found, self.where[w][e][0], words, 0, least)


def _scan(column: pa.Array, index: Index, hashes: WordHashes) -> Iterator[tuple[int, dict]]:
    """(row, matches) in groups of about 64k words."""
    rows, texts, size = [], [], 0
    for k, text in enumerate(column):
        words = words_of(text.as_py())
        rows.append(k)
        texts.append(words)
        size += len(words)
        if size >= 65536:
            yield from zip(rows, index.matches(texts, hashes), strict=True)
            rows, texts, size = [], [], 0
    if rows:
        yield from zip(rows, index.matches(texts, hashes), strict=True)


def _find(batches: Iterator[pa.RecordBatch], items: list, names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    index, hashes = Index(items), WordHashes()
    for batch in batches:
        rows, hits = [], []
        for k, found in _scan(batch.column("_text"), index, hashes):
            for item, (alike, start, n) in sorted(found.items()):
                rows.append(k)
                hits.append((index.items[item][0], start, n, alike))
        cols = list(zip(*hits, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
            names,
        )


def _clean(batches: Iterator[pa.RecordBatch], items: list, at: int) -> Iterator[pa.RecordBatch]:
    index, hashes = Index(items), WordHashes()
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for k, found in _scan(batch.column(at), index, hashes):
            keep[k] = not found
        yield batch.filter(pa.array(keep))


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list]:
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    blocks = -(-rows.count() // block)
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        yield sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = ITEM_BLOCK
) -> DataFrame:
    """One row per document row and item that it holds: id, item id, start, n_words, similarity of the best window.

    Windows of the item's size (:func:`window_size`) are fingerprinted at every word; where a SimHash differs from an item's in
    at most RADIUS bits, or an anchor of an item of SHINGLE words and more is held, the window of exactly as many words as the item is compared by 5-word shingles with
    multiplicity, and counts from a similarity of 0.8.  A document
    shorter than the item is one window.  The items are a query set: they are read in blocks of about ``block``,
    each block a pass over the documents without any shuffle.

    Null or empty texts and items hold nothing; repeated documents give a row each, repeated items count as several; null ids are
    carried; extra columns are ignored.  Without items or documents the result is empty.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    item_type = items.schema[item_col].dataType
    names = [id_col, item_col, "start", "n_words", "similarity"]
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, `{item_col}` {item_type.simpleString()}, start long, n_words long, similarity double"
    from pyspark.sql.pandas.types import to_arrow_type

    out = None
    for part in _item_blocks(items, item_col, item_text, block):
        hits = rows.mapInArrow(partial(_find, items=part, names=names, kind=to_arrow_type(item_type)), schema)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see :func:`contaminated`."""
    bounded_batches(docs.sparkSession)
    for part in _item_blocks(items, item_col, item_text, block):
        docs = docs.mapInArrow(partial(_clean, items=part, at=docs.columns.index(text_col)), docs.schema)
    return docs


@query("op4_decontamination")
def op4(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
