"""Token counts through a digest cache: only texts that no stored digest knows are encoded."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import bounded_batches, fresh_folder, path_exists, table
from volspark.llm.registry import query

CACHE_SCHEMA = "digest binary, n_tokens long"
# Units longer than this are encoded each time; units in memory per task.
MEMO_UNIT, MEMO_SIZE = 48, 250_000
# A unit is a run of non-space characters with the white space before it: no token of a byte-level BPE crosses its border.
_UNITS = re.compile(r"\s*\S+|\s+")
# Separators that Python takes for white space and the tokenizer's pattern does not.
_ODD = re.compile("[\x1c-\x1f]")


def tokenizer_version(tokenizer_path: str) -> str:
    """Digest of the vocabulary file and of the library's version: a change of either starts a new cache."""
    import tokenizers

    seen = hashlib.sha256(tokenizers.__version__.encode())
    with open(tokenizer_path, "rb") as f:
        seen.update(f.read())
    return seen.hexdigest()


def _loaded(tokenizer_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Counter:
    """Counts tokens of texts; counts of short units are remembered, so a frequent word is encoded once per task.

    A text without odd separators or special strings is the concatenation of its units also for the tokenizer, so its
    count is the sum of theirs.  Any other text is encoded whole.
    """

    def __init__(self, tokenizer_path: str):
        self.tokenizer = _loaded(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _ODD.search(text) or any(s in text for s in self.special):
            return self._encoded([text])[0]
        units = _UNITS.findall(text)
        memo = self.memo
        new = [u for u in set(units).difference(memo) if len(u) <= MEMO_UNIT]
        if new:
            if len(memo) + len(new) > MEMO_SIZE:
                for old in list(memo)[MEMO_SIZE // 2 :]:
                    del memo[old]
                new = [u for u in set(units).difference(memo) if len(u) <= MEMO_UNIT]
            memo.update(zip(new, self._encoded(new), strict=True))
        try:
            return sum(map(memo.__getitem__, units))
        except KeyError:
            long = [u for u in units if u not in memo]
            return sum(memo[u] for u in units if u in memo) + sum(self._encoded(long))


def _count_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    counter = Counter(tokenizer_path)
    for batch in batches:
        counts = [counter.count(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])


def count_tokens(
    docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit per row of ``docs``.

    The normalised content is the text itself, null as empty (any other change would change counts).  Its SHA-256 is
    looked up in the cache table of this tokenizer version below ``cache_path``; the different texts without an entry are
    encoded once each and appended.  Repeated rows, equal texts and null ids each get their row; an empty text has 0
    tokens; extra columns are ignored.  A cache that holds a digest twice (two jobs that ran at once) counts as once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    store = f"{cache_path.rstrip('/')}/version={tokenizer_version(tokenizer_path)}"

    wanted = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if path_exists(spark, store):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(store)
        wanted = wanted.join(stored.select("digest"), "digest", "left_anti")
    fresh = wanted.mapInArrow(partial(_count_batches, tokenizer_path=tokenizer_path), CACHE_SCHEMA)
    fresh.write.mode("append").parquet(store)

    known = spark.read.schema(CACHE_SCHEMA).parquet(store).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(F.col(id_col).alias(id_col), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.join(known, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op2_token_counts")
def op2(spark, folder):
    """Counts of all documents with a cache of its own, so that every run encodes every different text."""
    import public_tokenizers

    return count_tokens(table(spark, folder, "documents"), fresh_folder(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))
