"""Weighted URL vocabulary: strict and soft terms found by one Aho-Corasick pass over each URL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import ascii_lower, bounded_batches, table
from volspark.llm.registry import query

# One of these rejects a URL.
STRICT = ("adult", "casino", "escort", "hentai", "porn", "porno", "sexcam", "torrent", "viagra", "warez", "xxx")
# Several different ones of these reject a URL.
SOFT = (
    "ads", "bet", "bets", "bingo", "bonus", "cheap", "click", "crack", "dating", "deals", "farm", "free", "jackpot", "keygen", "loan", "loans",
    "lottery", "pharma", "pills", "poker", "prize", "promo", "sex", "slots", "spam", "track", "tracker", "win",
)
SOFT_LIMIT = 2


def _is_word(ch: str) -> bool:
    return "a" <= ch <= "z" or "0" <= ch <= "9"


def _automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    if len(found):
        found.make_automaton()
    return found


def _terms_in(url: str, found) -> tuple[int, set[str]]:
    """Strict hits and the different soft terms that stand as whole words."""
    strict, soft = 0, set()
    for end, (term, is_strict) in found.iter(url) if len(found) else ():
        start = end - len(term) + 1
        if start and _is_word(url[start - 1]) or end + 1 < len(url) and _is_word(url[end + 1]):
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, soft


def _scan(batches: Iterator[pa.RecordBatch], strict: Sequence[str], soft: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the URL, by its hits; all others are handed through as they are."""
    found = _automaton(strict, soft)
    for batch in batches:
        hits = [_terms_in(u, found) if u else (0, ()) for u in batch.column(batch.num_columns - 1).to_pylist()]
        counts = [pa.array([h[0] for h in hits], pa.int32()), pa.array([len(h[1]) for h in hits], pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*batch.schema.names[:-1], "strict_hits", "soft_hits"])


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every URL: id, host, path, rule, verdict, strict_hits, soft_hits.

    A term counts where no ASCII letter or digit touches it; case is ignored for A-Z.  One strict hit or ``soft_limit``
    different soft terms block.  ``rules`` are (verdict, "host/path-prefix") pairs: the longest one that fits (host or a
    subdomain, path begins with the prefix; equal lengths: the first given) overrides the vocabulary.

    A null or empty URL, or one without "://", has an empty host and path and no rule; its whole text is still scanned.
    Repeated rows are judged each; other columns of ``pages`` are ignored, null ids kept.  Very long URLs are scanned whole; an
    empty table gives an empty result.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr("_raw", "://") > 0, F.expr("substr(_raw, instr(_raw, '://') + 3)")).otherwise("")
    rows = pages.select(F.col(id_col).alias(id_col), url.alias("_raw"))
    rows = rows.select(id_col, ascii_lower(F.col("_raw")).alias("_url"), rest.alias("_rest"))
    rows = rows.select(
        id_col,
        ascii_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        "_url",
    )
    bounded_batches(pages.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    scanned = rows.mapInArrow(
        partial(_scan, strict=tuple(strict), soft=tuple(soft)),
        f"`{id_col}` {kind}, host string, path string, strict_hits int, soft_hits int",
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, prefix = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(slash + prefix)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    blocked = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit)
    own = F.when(blocked, "block").otherwise("allow")
    return scanned.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits")


# The rules that the query applies.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _hits_sql(terms):
    one = "(CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END)"
    return " + ".join(one.format(t=t) for t in terms)


_FITS = "(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')"
_CASES = [(w, t, _FITS.format(d=t.partition("/")[0], p="/" + t.partition("/")[2])) for w, t in sorted(RULES, key=lambda r: -len(r[1]))]

SQL = f"""
WITH raw AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
rest AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM raw),
cut AS (SELECT page_id, u, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT *, CAST({_hits_sql(STRICT)} AS INT) AS any_strict, CAST({_hits_sql(SOFT)} AS INT) AS soft_hits FROM cut),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{t}'" for _, t, c in _CASES)} END AS rule,
                 CASE {' '.join(f"WHEN {c} THEN '{w}'" for w, _, c in _CASES)} END AS said FROM hit)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN any_strict > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       soft_hits FROM ruled
"""


@query("op1_url_filter", SQL)
def op1(spark, folder):
    return judge_urls(table(spark, folder, "pages"), RULES).drop("strict_hits")
