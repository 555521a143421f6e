"""Small string and number expressions of the text formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_measure(text: str) -> tuple[Column, Column]:
    """``key(arg,arg)`` as key and argument list; without parentheses the list is empty."""
    key = F.regexp_extract(text, r"^\s*([^()\s]+)", 1)
    inner = F.regexp_extract(text, r"\((.*)\)\s*$", 1)
    args = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"\s*,\s*"))
    return key, args


def version_numbers(text: str) -> Column:
    """Fourth dash-separated field as integers, e.g. ``x-y-z-7.4.1``; NULL where it is no number list."""
    numbers = F.transform(F.split(F.get(F.split(text, "-"), F.lit(3)), r"\."), lambda p: p.try_cast("int"))
    return F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers)


def strip_prefix(text: str, prefix: str) -> Column:
    c = F.col(text)
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def minutes(seconds: str) -> Column:
    return F.bround(F.col(seconds) / 60, 2)
