"""Small pieces that several operators share."""

from __future__ import annotations

import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.plans.storage import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Let Arrow batches of texts hold at most so many rows and bytes; a session with stricter settings keeps them.

    The defaults allow 10,000 rows, which for long texts is more than a task should hold on either side.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).strip().lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/volspark/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def has_letter(raw: bytes | None) -> bool:
    """Whether UTF-8 bytes hold a letter of any script."""
    if not raw:
        return False
    if _ASCII_LETTER.search(raw):
        return True
    # word characters hold number signs as well, such as fractions and circled digits
    return any(m.group().isalpha() for m in _LETTER.finditer(raw.decode("utf-8", "replace")))


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: the folds of labelled rows."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def uniform(*keys: Column | str, seed: str = "") -> Column:
    """A number in (0, 1) that hangs on the keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def hashed_sample(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """About ``size`` rows, all if there are not more, chosen by hashes of their keys.

    One count, then a filter: nothing is sorted or sent to one task, and the rows do not hang on how the data is dealt.
    """
    total = rows.count()
    return rows if total <= size else rows.filter(uniform(*keys, seed="sample") < size / total)


class Memo(dict):
    """Values computed on first use.  Beyond ``most`` entries the younger half goes: frequent keys came early and stay."""

    def __init__(self, compute, most: int, longest: int = 1 << 30):
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.trim(self.most // 2)
            self[key] = value
        return value

    def keep(self, found: dict, within: bool = True) -> None:
        """Take values computed elsewhere; ``within`` keeps to the bounds, else :meth:`trim` is due after use."""
        if not within:
            self.update(found)
            return
        self.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        self.trim()

    def trim(self, to: int | None = None) -> None:
        if to is None and len(self) <= self.most:
            return
        keys = list(self)
        for old in keys[(self.most // 2 if to is None else to) :]:
            del self[old]


class WordHashes(Memo):
    """64-bit hashes of words (str or bytes), so that a frequent word is hashed once per task."""

    def __init__(self, most: int = 200_000):
        super().__init__(xxhash.xxh3_64_intdigest, most, 64)

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
