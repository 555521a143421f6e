"""Settings files: thresholds, word lists and file lists in a small part of YAML, read into DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BARE = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^#]*?)\s*(?:#.*)?$""")


def _value(text: str):
    """A scalar: quoted text, a number, true or false, or the text itself; a comment after it is dropped."""
    text = _BARE.match(text.strip())[1].strip()
    if text[:1] == '"':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "": None}.get(text, text)


def parse_settings(text: str) -> dict:
    """Top-level keys with a scalar, a list (``- item`` lines or ``[a, b]``, also over several lines) or a flat mapping.

    Deeper nesting is an error: settings files of this kind are flat.
    """
    # a list in brackets becomes one line
    text = re.sub(r"\[[^\]]*\]", lambda m: " ".join(re.sub(r"#[^\n]*", "", m[0]).split()), text)
    out: dict = {}
    key = None
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indented = line[0] in " \t"
        if bare.startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                if out[key] is not None:
                    raise ValueError(f"line {number}: a list and a mapping under {key}")
                out[key] = []
            out[key].append(_value(bare[2:]))
            continue
        found = re.match(r"""("[^"]*"|'[^']*'|[^:#]+?)\s*:(?:\s+(.*)|)$""", bare)
        if not found:
            raise ValueError(f"line {number}: {bare}")
        name, rest = _value(found[1]), found[2] or ""
        value = [_value(v) for v in rest.strip()[1:-1].split(",") if v.strip()] if rest.strip().startswith("[") else _value(rest)
        if not indented:
            key = name
            out[key] = value
        elif key is None or isinstance(out[key], list) or value is None or isinstance(value, list):
            raise ValueError(f"line {number}: nested deeper than one level")
        else:
            out[key] = (out[key] or {}) | {name: value}
    return out


def read_settings(spark: SparkSession, path: str) -> dict:
    """One settings file, read through Spark so that any store will do; it is as small as a person writes it."""
    return parse_settings("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def read_thresholds(spark: SparkSession, path: str, column: str = "struct_name") -> tuple[DataFrame, float, list]:
    """Thresholds per structure, the default for all others, and the structures that are compared (``structs``)."""
    found = read_settings(spark, path)
    rows = [(name, float(value)) for name, value in (found.get("thresholds") or {}).items()]
    table = spark.createDataFrame(rows, f"{column} {'int' if rows and all(isinstance(n, int) for n, _ in rows) else 'string'}, threshold double")
    return table, float(found.get("default_threshold", 0.01)), found.get("structs") or []


def read_words(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Words that mark a failing line, and phrases that make it harmless."""
    found = read_settings(spark, path)
    return found.get("errors") or [], found.get("whitelist") or []


def read_list(spark: SparkSession, path: str, key: str) -> list:
    """The list under a key, e.g. expected files or labels."""
    found = read_settings(spark, path).get(key)
    if not isinstance(found, list):
        raise ValueError(f"{path} has no list {key}")
    return found
