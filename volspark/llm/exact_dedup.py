"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import ascii_lower, table
from volspark.llm.registry import query
from volspark.plans.storage import materialize

# A chunk ends at the first sentence or line end after MIN_CHUNK characters, at the latest after MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 4096
_CUT = r"(?s).{%d,%d}?(?:[.!?][ \n]|\n|\z)|.{1,%d}"


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; together they are the text.  The cuts depend on the content alone."""
    return F.regexp_extract_all(text, F.lit(_CUT % (least - 1, most - 2, most)), F.lit(0))


# Identifiers of chunks, weakest first.  The next is taken where the chunk table shows two texts behind one identifier.
_IDENTIFIERS = (lambda c: F.unhex(F.md5(c.cast("binary"))), lambda c: F.unhex(F.sha2(c, 256)))


def chunk_store(texts: DataFrame, identify) -> DataFrame:
    """chunk_id, chunk: every different chunk once.  Equal chunks collapse before the shuffle."""
    rows = texts.select(F.explode(chunks_of(F.col("_text"))).alias("chunk"))
    return rows.select(identify(F.col("chunk")).alias("chunk_id"), "chunk").distinct()


def ambiguous(store: DataFrame) -> bool:
    """Whether an identifier stands for two different chunks."""
    return bool(store.groupBy("chunk_id").count().filter("count > 1").head(1))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers=_IDENTIFIERS) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for every row; texts that agree but for the case of A-Z form a group.

    Each text is cut into content-defined chunks.  The chunk table holds every different chunk once with its identifier
    and its text, so it proves that an identifier means one text; then documents are equal when their ordered lists of
    identifiers are, and only these short lists are shuffled.  The row with the largest id stays.

    Null texts count as empty and empty texts equal each other.  Of several rows with the largest id of a group all are
    marked kept, as they can't be told apart.  Null ids never stay unless the whole group has none (then keep_id is null
    and nothing is kept but marked).  Extra columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    for identify in identifiers:
        if not ambiguous(chunk_store(texts, identify)):
            break
    else:
        raise ValueError("two different chunks share the strongest identifier")
    lists = texts.select(
        "_id", F.transform(chunks_of(F.col("_text")), identify).alias("_recipe"), F.sha2(F.col("_text"), 256).alias("text_sha256")
    )
    lists = materialize(lists, "recipes")
    groups = lists.groupBy("_recipe").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    kept = F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False))
    return lists.join(groups, "_recipe").select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


@query("op7_exact_dedup", SQL)
def op7(spark, folder):
    return exact_groups(table(spark, folder, "documents"))
