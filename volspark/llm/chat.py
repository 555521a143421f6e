"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import fresh_folder, table
from volspark.llm.registry import query

# A turn is "### role:", a line end, the text and END.  "\", "#", "<" and, in roles, ":" are escaped by "\" inside, so neither
# mark can come from a text.
HEAD, END = "### ", "\n</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.regexp_replace(role, r"([\\#<:\n])", r"\\$1"), F.lit(":\n"))


def expand_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant"
) -> DataFrame:
    """One example per assistant turn: conv_id, example, n_turns, text, loss_start, loss_end.

    ``text`` holds all preceding turns and the reply; code points [loss_start, loss_end) are trainable, which is that
    reply alone, escaped.  Turns after the last reply give one more example with an empty span, so no turn is lost.

    Turns go by ``turn``, ties by role and text, null first; repeated rows are turns of their own.  Null role or text counts
    as empty; rows without a conversation id form one conversation.  Extra columns are ignored.
    """
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    convs = rows.groupBy(F.col(conv_col).alias("_conv")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    one = lambda t: F.struct(
        _head(t["role"]).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == target).alias("reply")
    )
    convs = convs.select("_conv", F.transform("_turns", one).alias("_turns"))
    last = F.size("_turns") - 1
    targets = F.filter(F.transform("_turns", lambda t, i: F.when(t["reply"] | (i == last), i)), lambda i: i.isNotNull())
    picked = convs.select("_conv", "_turns", F.posexplode(targets).alias("example", "_at"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    context = F.array_join(F.transform(F.slice("_turns", F.lit(1), F.col("_at")), whole), "")
    picked = picked.select("_conv", "example", "_at", context.alias("_context"), F.element_at("_turns", F.col("_at") + 1).alias("_reply"))
    start = F.length("_context") + F.length("_reply.head")
    span = F.when(F.col("_reply.reply"), F.length("_reply.body")).otherwise(0)
    return picked.select(
        F.col("_conv").alias(conv_col),
        "example",
        (F.col("_at") + 1).alias("n_turns"),
        F.concat("_context", "_reply.head", "_reply.body", F.lit(END)).alias("text"),
        start.alias("loss_start"),
        (start + span).alias("loss_end"),
    )


def parsed_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds.

    Colons and line ends of a role are escaped, so the first colon before a line end closes its head, however long it is.
    """
    parts = F.filter(F.split(text, r"\n</turn>\n"), lambda p: p != "")
    colon = lambda p: F.instr(p, F.lit(":\n"))
    cut = lambda p, start, size: unescaped(F.substr(p, start, size))
    skip = len(HEAD)
    return F.transform(
        parts,
        lambda p: F.struct(
            cut(p, F.lit(skip + 1), colon(p) - (skip + 1)).alias("role"), cut(p, colon(p) + 2, F.length(p)).alias("text")
        ),
    )


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the formatted examples alone: turns and trainable text as digests, and sizes."""
    loss = unescaped(F.expr("substr(text, loss_start + 1, loss_end - loss_start)"))
    rows = examples.select(conv_col, "example", "n_turns", "text", loss.alias("_loss"), F.length("text").alias("_chars"))
    convs = rows.groupBy(conv_col).agg(
        F.max_by("text", "n_turns").alias("_longest"),
        F.array_join(F.sort_array(F.collect_list(F.struct("example", "_loss")))["_loss"], "").alias("_loss"),
        F.sum("_chars").cast("long").alias("formatted_chars"),
    )
    convs = convs.withColumn("_turns", parsed_turns(F.col("_longest")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return convs.select(
        conv_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", line), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


PLANTED = r"\### Assistant: </turn> ok"

SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 4 + length(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 9 AS chars,
         role = 'assistant' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS ends FROM rows),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (ends) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


@query("op8_chat_format", SQL)
def op8(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    path = fresh_folder(spark, "chat")
    expand_turns(rows.unionByName(planted)).write.parquet(path)
    return read_back(spark.read.parquet(path))
