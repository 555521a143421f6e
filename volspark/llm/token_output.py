"""Token-id files: per shard a Re-Pair grammar with expansion lengths, so any range of ids decodes by itself."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volspark.llm.common import Memo, bounded_batches, fresh_folder, table
from volspark.llm.registry import query
from volspark.plans.joins import attach

END_ID = 2
# Ids of a shard, about: a shard closes with the document that reaches it.
SHARD_IDS = 1 << 19
# A pair must occur so often to become a rule; rules taken in one round; rounds end sooner when no pair is left.
LEAST_COUNT, ROUND_RULES, ROUNDS = 16, 16_000, 24
# Longest word and most words and pieces that a task remembers.
MEMO_WORD, MEMO_SIZE, MEMO_PIECES = 48, 200_000, 200_000
# Texts that are encoded together: what is new among them is looked up once.
DOCS_AT_ONCE = 256


# White space, ASCII and Latin letters, which the tokenizer cuts by one pattern once they are lower-cased; words of them but
# "<", where special strings begin; and the pieces.
_PLAIN_TEXT = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PLAIN = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@[-`{-~]+")


def _as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b if b in shown else next(free)) for b in range(256)}


# The normaliser and the pre-tokenizer that words can be taken apart for.
_WORDWISE_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_WORDWISE_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
_WORDWISE_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and no token crosses it, so a text is the sequence of its words also for the library.
    Plain texts are cut into pieces whose ids are remembered, so a frequent piece is encoded once per task; new ones go to the
    library's model, many at once.  Other texts go word by word: plain words by their pieces, any other through the whole
    library.  For a vocabulary with another normaliser or pre-tokenizer whole texts go through the library.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        known = json.loads(self.tokenizer.to_str())
        steps = {"type": "Sequence", "pretokenizers": [_WORDWISE_SPLIT, _WORDWISE_BYTES]}
        self.wordwise = known["normalizer"] == _WORDWISE_NORMALIZER and known["pre_tokenizer"] == steps and known["post_processor"] is None
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = all(t.startswith("<") for t in special)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE)
        self.letters = _byte_letters()
        # the same model behind a split at spaces alone, for pieces that are already cut and lower-cased
        self.cut = Tokenizer(self.tokenizer.model)
        self.cut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.cut.model._resize_cache(0)  # it meets new pieces only
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = Memo(None, MEMO_SIZE, MEMO_WORD)
        self.pieces = Memo(None, MEMO_PIECES, MEMO_WORD)
        self.vocabulary = len(vocabulary)

    def _cut(self, raw: bytes) -> list[str] | None:
        text = raw.decode("utf-8")
        return _PIECES.findall(text.lower()) if self.plain and _PLAIN.fullmatch(text) else None

    def _cut_text(self, raw: bytes | None) -> list[str] | None:
        if not raw:
            return []
        text = raw.decode("utf-8", "replace")
        if not self.plain or not _PLAIN_TEXT.fullmatch(text) or ("<" in text and self.special.search(text)):
            return None
        return _PIECES.findall(text.lower())

    def _new_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        texts = [p if p.isascii() else "".join([self.letters[b] for b in p.encode()]) for p in pieces]
        ids = np.array(self.cut.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(stops) != len(pieces):  # a vocabulary that does not mark the ends of words
            return {p: _as_bytes(self.cut.encode(t, add_special_tokens=False).ids) for p, t in zip(pieces, texts, strict=True)}
        flat = ids.tobytes()
        return {p: flat[low:high] for p, low, high in zip(pieces, [0, *stops], stops, strict=False)}

    def _known(self, cuts: list[list[str]]) -> dict[str, bytes]:
        """The ids of remembered pieces; those of new ones are added, :meth:`Memo.trim` is due after use."""
        new = list(set().union(*cuts).difference(self.pieces))
        if new:
            self.pieces.keep(self._new_pieces(new), within=False)
        return self.pieces

    def _new_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        cuts = [self._cut(w) for w in words]
        get = self._known([c for c in cuts if c]).__getitem__
        out = {}
        for word, cut in zip(words, cuts, strict=True):
            if cut is None:
                out[word] = _as_bytes(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids)
            else:
                out[word] = b"".join([get(p) for p in cut])
        return out

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.words))
        if new:
            self.words.keep(self._new_words(new), within=False)
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        self.words.trim()
        return out

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.wordwise:
            whole = [t.decode("utf-8", "replace") if t else "" for t in texts]
            return [_as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        cuts = [self._cut_text(t) for t in texts]
        get = self._known([c for c in cuts if c]).__getitem__
        out = [b"".join(map(get, c)) if c is not None else b"" for c in cuts]
        other = [k for k, c in enumerate(cuts) if c is None]
        if other:
            for k, ids in zip(other, self._by_words([texts[k] for k in other]), strict=True):
                out[k] = ids
        self.pieces.trim()
        return out

    def encode(self, raw: bytes | None) -> bytes:
        return self.encode_all([raw])[0]


@dataclass
class Grammar:
    """Symbols from ``base`` on are rules: symbol base + k stands for the pair at row k."""

    base: int
    rules: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray


_SLOT_BITS = 19


def _slot(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2654435769)) >> np.uint32(32 - _SLOT_BITS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)


def _steps(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules that refer to earlier stretches only; a round of :func:`repair` lies in one or two."""
    highest = rules.astype(np.int64).max(1, initial=0) - base
    low = 0
    while low < len(highest):
        inner = highest[low:] >= low
        high = low + int(inner.argmax()) if inner.any() else len(highest)
        yield low, high
        low = high


def _lengths_of(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    symbols = symbols.astype(np.int64)
    rule = symbols >= base
    return np.where(rule, lengths[np.where(rule, symbols - base, 0)] if len(lengths) else 1, 1).astype(np.int64)


def repair(ids: np.ndarray, breaks: np.ndarray, base: int, least: int = LEAST_COUNT, per_round: int = ROUND_RULES, rounds: int = ROUNDS) -> tuple[Grammar, np.ndarray]:
    """Replace frequent pairs until none occurs ``least`` times; ``breaks`` are the ends of documents, which no rule crosses.

    A round counts all pairs, makes rules of the most frequent ones and replaces their occurrences from the left, every second
    one where they overlap.  Returns the grammar and the ends of the documents in symbols.
    """
    room = ((1 << 16) if base < 1 << 16 else (1 << 32)) - base
    kind = np.uint32 if base < 1 << 16 else np.uint64
    shift = kind(16 if base < 1 << 16 else 32)
    symbols = ids.astype(kind)
    last = np.zeros(len(ids), bool)
    last[breaks[breaks > 0] - 1] = True
    rules: list[np.ndarray] = []
    made = 0
    for _ in range(rounds):
        if len(symbols) < 2 or made >= room:
            break
        keys = (symbols[:-1] << shift) | symbols[1:]
        inside = np.sort(keys[~last[:-1]])  # equal pairs side by side
        if not len(inside):
            break
        heads = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
        counts = np.diff(np.append(heads, len(inside)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        take = min(per_round, room - made, len(often))
        top = often[np.argsort(-counts[often], kind="stable")[:take]]
        chosen = inside[heads[top]]
        # a hash table finds the rule of a pair; of rules that meet in a slot the most frequent stays, the others wait a round
        slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        slots[_slot(chosen[::-1])] = np.arange(len(chosen) - 1, -1, -1)
        rank = slots[_slot(keys)]
        at = np.flatnonzero((chosen[rank] == keys) & ~last[:-1])
        rank = rank[at]
        begin = np.concatenate([[True], np.diff(at) != 1])
        place = np.arange(len(at))
        even = (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
        at, rank = at[even], rank[even]
        used, rank = np.unique(rank, return_inverse=True)
        pairs = chosen[used]
        rules.append(np.stack([pairs >> shift, pairs & ((kind(1) << shift) - kind(1))], 1))
        symbols[at] = (base + made + rank).astype(kind)
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        made += len(used)
    table_ = np.concatenate(rules) if rules else np.zeros((0, 2), kind)
    small = np.uint16 if base < 1 << 16 else np.uint32
    lengths = np.ones(made, np.uint32)
    for low, high in _steps(table_, base):
        lengths[low:high] = _lengths_of(table_[low:high], base, lengths).sum(1)
    ends = np.zeros(len(breaks), np.int64)
    full = breaks > np.concatenate([[0], breaks[:-1]]) if len(breaks) else np.zeros(0, bool)
    ends[full] = np.flatnonzero(last) + 1
    return Grammar(base, table_.astype(small), symbols.astype(small), lengths), np.maximum.accumulate(ends) if len(ends) else ends


def expansions(g: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """All rules written out, one after another, and where each begins."""
    starts = np.concatenate([[0], np.cumsum(g.lengths.astype(np.int64))])
    out = np.zeros(starts[-1], np.uint32)
    for low, high in _steps(g.rules, g.base):
        pair = g.rules[low:high].astype(np.int64).ravel()  # both halves of a rule lie side by side, as in the result
        n = _lengths_of(pair, g.base, g.lengths)
        rule, ends = pair >= g.base, np.cumsum(n)
        begin = np.where(rule, starts[np.where(rule, pair - g.base, 0)], 0)
        inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
        out[starts[low] : starts[high]] = np.where(np.repeat(rule, n), out[np.repeat(begin, n) + inside * np.repeat(rule, n)], np.repeat(pair, n))
    return out, starts


def expand(g: Grammar, written: tuple[np.ndarray, np.ndarray], low: int, high: int) -> np.ndarray:
    """The ids of symbols [low, high)."""
    s = g.symbols[low:high].astype(np.int64)
    out, starts = written
    rule = s >= g.base
    n = np.ones(len(s), np.int64)
    n[rule] = g.lengths[s[rule] - g.base]
    to = np.concatenate([[0], np.cumsum(n)])
    ids = np.repeat(np.where(rule, 0, s), n).astype(np.uint32)
    spread = np.repeat(np.where(rule, starts[np.where(rule, s - g.base, 0)], -1), n)
    inside = np.arange(to[-1]) - np.repeat(to[:-1], n)
    from_rule = spread >= 0
    if len(out):
        ids[from_rule] = out[(spread + inside)[from_rule]]
    return ids


def ids_between(g: Grammar, first: int, stop: int) -> np.ndarray:
    """Random access: the ids at places [first, stop) of a shard, found by the expansion lengths."""
    s = g.symbols.astype(np.int64)
    n = np.ones(len(s), np.int64)
    rule = s >= g.base
    n[rule] = g.lengths[s[rule] - g.base]
    ends = np.cumsum(n)
    low, high = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[low - 1]) if low else 0
    return expand(g, expansions(g), low, min(high, len(s)))[first - before : stop - before]


SHARD_FIELDS = "part int, seq int, n_ids long, base int, doc_ids array<{id}>, doc_ids_end array<long>, symbols binary, doc_symbols_end array<long>, rules binary, lengths binary"


def _shard(part: int, seq: int, base: int, docs: list, parts: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
    ends = np.cumsum([len(p) // 4 for p in parts])
    g, cuts = repair(np.frombuffer(b"".join(parts), "<u4"), ends, base)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(ends[-1])], pa.int64()), pa.array([base], pa.int32()),
            pa.array([docs], pa.list_(id_type)), pa.array([ends], pa.list_(pa.int64())), pa.array([g.symbols.tobytes()]),
            pa.array([cuts], pa.list_(pa.int64())), pa.array([g.rules.tobytes()]), pa.array([g.lengths.tobytes()]),
        ],
        ["part", "seq", "n_ids", "base", "doc_ids", "doc_ids_end", "symbols", "doc_symbols_end", "rules", "lengths"],
    )


def _encode(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(tokenizer_path)
    part, seq = TaskContext.get().partitionId(), 0
    tail = np.array([end_id], "<u4").tobytes()
    base = max(encoder.vocabulary, end_id + 1)
    docs, parts, size = [], [], 0
    for batch in batches:
        kind = batch.column("_id").type
        for low in range(0, batch.num_rows, DOCS_AT_ONCE):
            rows = batch.slice(low, DOCS_AT_ONCE)
            for doc, ids in zip(rows.column("_id").to_pylist(), encoder.encode_all(rows.column("_text").to_pylist()), strict=True):
                parts.append(ids + tail)
                docs.append(doc)
                size += len(parts[-1]) // 4
                if size >= shard_ids:
                    yield _shard(part, seq, base, docs, parts, kind)
                    docs, parts, size, seq = [], [], 0, seq + 1
    if docs:
        yield _shard(part, seq, base, docs, parts, kind)


def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every row and write shards, one row of a Parquet table each, in ascending order of ids.

    Documents are dealt by ranges of the id, so a task holds a stretch of the order and closes a shard about every
    ``shard_ids`` ids.  A shard has its grammar (``base``, ``rules``, ``lengths`` of the rules' expansions), its symbols, and
    the ends of its documents in symbols and in ids.

    A null or empty text is the end id alone; repeated rows are written each, ties by text; null ids come first; extra columns
    are ignored; an empty table gives an empty folder.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions("_id", F.xxhash64("_text"), "_text")
    schema = SHARD_FIELDS.format(id=rows.schema["_id"].dataType.simpleString())
    rows.mapInArrow(partial(_encode, tokenizer_path=tokenizer_path, end_id=end_id, shard_ids=shard_ids), schema).write.parquet(path)


def grammar_of(row: dict) -> Grammar:
    kind = np.uint16 if row["base"] < 1 << 16 else np.uint32
    return Grammar(row["base"], np.frombuffer(row["rules"], kind).reshape(-1, 2), np.frombuffer(row["symbols"], kind), np.frombuffer(row["lengths"], np.uint32))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in ("part", "seq", "base", "symbols", "rules", "lengths")}
            g = grammar_of(row)
            written = expansions(g)
            ids = memoryview(expand(g, written, 0, len(g.symbols)).astype("<u4").tobytes())
            ends = np.asarray(batch.column("doc_ids_end")[k].values)
            sums, low = [], 0
            for high in ends.tolist():
                sums.append(zlib.crc32(ids[4 * low : 4 * high]))
                low = high
            begins = np.concatenate([[0], ends[:-1]])
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), batch.column("doc_ids")[k].values,
                    pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["part", "seq", "_id", "_begin", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every written document, decoded from the files alone."""
    bounded_batches(spark)
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    docs = shards.mapInArrow(_decode, f"part int, seq int, _id {kind}, _begin long, n_tokens long, ids_crc32 long")
    # a running sum in two steps: over tasks, and over the shards of a task
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(parts, "part")
    offsets = offsets.select("part", "seq", (F.col("_own") + F.col("_base")).alias("_first"))
    rows = attach(docs, offsets, ["part", "seq"], how="inner")
    return rows.select(F.col("_id").alias(id_col), (F.col("_first") + F.col("_begin")).alias("start"), "n_tokens", "ids_crc32")


@query("op5_token_output")
def op5(spark, folder):
    import public_tokenizers

    path = fresh_folder(spark, "token-shards")
    write_shards(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, path)
