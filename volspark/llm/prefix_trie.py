"""The prefix trie of rebuilt conversations, from composable fingerprints instead of rebuilt texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from volspark.llm.common import table
from volspark.llm.registry import query
from volspark.plans.joins import attach, literal_table
from volspark.plans.storage import materialize

# A turn is the map x -> a x + b over a prime field, in two lanes; a sequence of turns is the product of its maps.  A map
# is six numbers (a, b, 1/a; a, b, 1/a), so that a head can be taken off again.
PRIME = (1 << 31) - 1
IDENTITY = (1, 0, 1, 1, 0, 1)
LANES = (0, 3)
# Depths, and ids of ends, are taken in blocks of so many.
BLOCK = 4096


def turn_map(r1: int, r2: int, prime: int = PRIME) -> tuple[int, ...]:
    out = ()
    for r in (r1, r2):
        a = 1 + (r & 0x3FFFFFFF) % (prime - 1)
        out += (a, (r >> 30) % prime, pow(a, -1, prime))
    return out


def then(p, q, prime: int = PRIME) -> tuple:
    """The product p q, for tuples of numbers as for tuples of columns."""
    out = ()
    for k in LANES:
        out += (p[k] * q[k] % prime, (p[k] * q[k + 1] + p[k + 1]) % prime, p[k + 2] * q[k + 2] % prime)
    return out


def inverse(p, prime: int = PRIME) -> tuple:
    out = ()
    for k in LANES:
        out += (p[k + 2], (prime - p[k + 2] * p[k + 1] % prime) % prime, p[k])
    return out


def _cells(name: str) -> tuple[Column, ...]:
    return tuple(F.col(name)[k].cast("long") for k in range(6))


def _packed(cells: tuple) -> Column:
    return F.array(*(c.cast("int") for c in cells))


def _keys(cells: tuple) -> list[Column]:
    """A map as two longs."""
    return [F.shiftleft(cells[k].cast("long"), 31).bitwiseOR(cells[k + 1].cast("long")) for k in LANES]


def turn_references(rows: DataFrame, seed: str) -> DataFrame:
    """Adds _r1, _r2: 120 bits of a digest that stand for a turn's role and text."""
    whole = F.concat_ws("\n", F.lit(seed), F.length("_role").cast("string"), F.concat("_role", "_text"))
    digest = F.sha2(whole, 256)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return rows.withColumns({"_r1": number(1), "_r2": number(16)})


def references_clash(rows: DataFrame) -> bool:
    """Whether a reference stands for two different turns; equal turns collapse before the shuffle."""
    store = rows.select("_r1", "_r2", "_role", "_text").distinct()
    return bool(store.groupBy("_r1", "_r2").count().filter("count > 1").head(1))


def _scan(rows: DataFrame, partitions: int | None, prime: int) -> DataFrame:
    """All turns in order, with their place and product since the task's first turn of that conversation.

    Turns are dealt by ranges of (conversation, turn, role, text), so a long conversation spreads over tasks.  Each task
    adds one row for the first and one for the last conversation it saw (``edge`` 1 and 2).
    """
    order = [F.asc("_conv"), F.asc_nulls_first("_turn"), F.asc("_role"), F.asc("_text")]
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    schema = "_conv bigint, part int, edge int, place bigint, chars int, _r1 bigint, _r2 bigint, before array<int>, upto array<int>"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, place, now, first = None, 0, IDENTITY, None
        edge = lambda kind: (conv, part, kind, place, None, None, None, None, now)
        for b in batches:
            found = []
            for c, chars, r1, r2 in zip(*(b.column(k).to_pylist() for k in ("_conv", "_chars", "_r1", "_r2"))):
                if c != conv:
                    if conv is not None and first is None:
                        first = edge(1)
                    conv, place, now = c, 0, IDENTITY
                before, place = now, place + 1
                now = then(now, turn_map(r1, r2, prime), prime)
                found.append((c, part, 0, place, chars, r1, r2, before, now))
            if found:
                yield batch(found)
        if conv is not None:
            yield batch([edge(1)] if first is None else [first, edge(2)])

    return dealt.select("_conv", F.length("_text").alias("_chars"), "_r1", "_r2").mapInArrow(run, schema)


def _carries(edges: list, prime: int) -> list[tuple]:
    """part, conversation, turns and product before it, for tasks that begin inside a conversation."""
    parts: dict[int, dict] = {}
    for e in edges:
        parts.setdefault(e["part"], {})[e["edge"]] = (e["_conv"], e["place"], tuple(e["upto"]))
    carried, out = None, []
    for part in sorted(parts):
        first = parts[part][1]
        if carried and carried[0] == first[0]:
            out.append((part, *carried))
            first = (first[0], carried[1] + first[1], then(carried[2], first[2], prime))
        carried = parts[part].get(2, first)
    return out


def ordered_turns(rows: DataFrame, partitions: int | None = None, prime: int = PRIME) -> DataFrame:
    """_conv, place (from 1), chars, _r1, _r2 and the products of all turns before it and up to it."""
    scanned = materialize(_scan(rows, partitions, prime), "turns")
    # two rows per task at most
    carries = _carries(scanned.filter("edge > 0").select("part", "edge", "_conv", "place", "upto").collect(), prime)
    carry = literal_table(rows.sparkSession, carries, "part int, _conv bigint, _turns bigint, _head array<int>")
    turns = scanned.filter("edge = 0").drop("edge").join(carry, ["part", "_conv"], "left")
    moved = F.col("_head").isNotNull()
    product = lambda name: F.when(moved, _packed(then(_cells("_head"), _cells(name), prime))).otherwise(F.col(name))
    place = F.col("place") + F.coalesce("_turns", F.lit(0))
    return turns.select("_conv", place.alias("place"), "chars", "_r1", "_r2", product("before").alias("before"), product("upto").alias("upto"))


def rebuilt_prefixes(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most_head: int, prime: int = PRIME) -> DataFrame:
    """One row per rebuilt conversation and prefix, the empty one too: _conv, depth, k1, k2, p1, p2 (its own and its
    parent's fingerprint), _r1, _r2, chars (of the last turn), ends.

    Head and suffix are combined as products: (head of the base) (own head)^-1 (own turns up to here).
    """
    h = head(F.col("_conv"))
    own_head = F.array(*(F.max(F.when(F.col("place") == F.col("_h"), F.col("upto")[k])) for k in range(6)))
    convs = turns.withColumn("_h", h).groupBy("_conv").agg(F.max("_h").cast("long").alias("_h"), F.max("place").alias("_n"), own_head.alias("_own"))
    is_base = (base(F.col("_conv")) == F.col("_conv")) & (F.col("place") <= most_head)
    heads = turns.filter(is_base).groupBy(F.col("_conv").alias("_base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "chars", "_r1", "_r2", "before", "upto"))).alias("_heads")
    )
    convs = convs.withColumn("_base", base(F.col("_conv"))).join(heads, "_base", "left")
    convs = convs.withColumn("_heads", F.slice(F.coalesce("_heads", F.array().cast(heads.schema["_heads"].dataType)), F.lit(1), F.col("_h").cast("int")))
    identity = F.lit(list(IDENTITY))
    own = F.when(F.col("_h") == 0, identity).otherwise(F.col("_own"))
    convs = convs.withColumns({"_taken": F.size("_heads").cast("long"), "_rest": F.greatest(F.col("_n") - F.col("_h"), F.lit(0)), "_own": own})
    convs = convs.withColumn("_length", F.col("_taken") + F.col("_rest"))
    convs = convs.withColumn("_top", F.coalesce(F.try_element_at("_heads", F.lit(-1))["upto"], identity))
    link = _packed(then(_cells("_top"), inverse(_cells("_own"), prime), prime))
    convs = materialize(convs.withColumn("_link", link).select("_conv", "_h", "_heads", "_taken", "_rest", "_length", "_link"), "conversations")

    def prefix(rows: DataFrame, depth: Column, before: tuple, upto: tuple) -> DataFrame:
        (k1, k2), (p1, p2) = _keys(upto), _keys(before)
        return rows.select(
            "_conv", depth.alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "_r1", "_r2", "chars",
            (depth == F.col("_length")).alias("ends"),
        )

    nothing = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("chars"), F.lit(0).cast("long").alias("_r1"), F.lit(0).cast("long").alias("_r2"),
                       identity.alias("before"), identity.alias("upto"))
    tops = convs.select("_conv", "_length", F.explode(F.concat(F.array(nothing), "_heads")).alias("_t")).select("_conv", "_length", "_t.*")
    tops = prefix(tops, F.col("place"), _cells("before"), _cells("upto"))
    rest = turns.filter(F.col("place") > h)
    # a conversation with a large share of all turns is taken out of the shuffle there
    rest = attach(rest, convs.filter("_rest > 0").select("_conv", "_h", "_taken", "_length", "_link"), "_conv", "inner", costly=True)
    rest = prefix(rest, F.col("_taken") + F.col("place") - F.col("_h"), then(_cells("_link"), _cells("before"), prime), then(_cells("_link"), _cells("upto"), prime))
    return tops.unionByName(rest)


_NODE = ["depth", "k1", "k2"]


def _ends(prefixes: DataFrame) -> DataFrame:
    """Per node at which conversations end: the digest of their ids in ascending order.

    Ids meet in blocks of at most BLOCK; the digest runs over a node's blocks in order and holds one at a time.
    """
    blocks = prefixes.filter("ends").groupBy(*_NODE, F.shiftright("_conv", BLOCK.bit_length() - 1).alias("_block"))
    blocks = blocks.agg(F.array_join(F.sort_array(F.collect_list("_conv")).cast("array<string>"), ",").alias("ids"))
    blocks = blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "_block").select(*_NODE, "ids")
    schema = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
    arrow = to_arrow_schema(prefixes.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for b in batches:
            done = []
            for *node, ids in zip(*(b.column(k).to_pylist() for k in (*_NODE, "ids"))):
                if node == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*at, digest.hexdigest()), arrow)], schema=arrow)

    return blocks.mapInArrow(run, schema)


def _subtree_sums(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: childless nodes and weights of its whole subtree.

    The smallest member of a node is the smallest of all nodes below it on its own path, so each conversation counts the
    nodes it is the smallest of, from its last turn upwards; a node's sum is that of its members.  No step per level.
    """
    own = nodes.select(F.col("conv_id").alias("_conv"), "depth", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"))
    rows = prefixes.select("_conv", *_NODE).join(own, ["_conv", "depth"], "left").fillna(0, ["weight", "leaf"])
    rows = rows.withColumn("_block", F.floor(F.col("depth") / BLOCK))
    below = Window.partitionBy("_conv", "_block").orderBy(F.desc("depth"))
    sums = rows.select("_conv", "_block", *_NODE, *(F.sum(c).over(below).alias(c) for c in ("weight", "leaf")))
    blocks = rows.groupBy("_conv", "_block").agg(F.sum("weight").alias("_w"), F.sum("leaf").alias("_l"))
    after = Window.partitionBy("_conv").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_conv", "_block", F.sum("_w").over(after).alias("_w"), F.sum("_l").over(after).alias("_l")).filter("_w IS NOT NULL")
    sums = sums.join(blocks, ["_conv", "_block"], "left")
    total = lambda c, more: F.sum(F.col(c) + F.coalesce(more, F.lit(0)))
    return sums.groupBy(*_NODE).agg(total("leaf", "_l").alias("n_leaves"), total("weight", "_w").alias("saved_tokens"))


def prefix_trie(
    rows: DataFrame,
    base: Callable[[Column], Column],
    head: Callable[[Column], Column],
    most_head: int,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    partitions: int | None = None,
    primes: tuple[int, ...] = (PRIME, PRIME, PRIME),
) -> DataFrame:
    """The trie of conversations whose first turns are replaced by the head of another one.

    Conversation c becomes the first ``head(c)`` turns (at most ``most_head``) of conversation ``base(c)``, which is its
    own base, and its own turns after its first ``head(c)``.  Per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A turn is a reference (digest of role and text) and a map over a prime field; prefixes are products of maps, and a
    rebuilt prefix is a product of stored products, so no rebuilt text is made and texts are shuffled once, to order
    turns, and once, without copies, to prove that a reference means one turn.  Prefixes with equal products are a node
    once their parents agree and their last turns have one reference; if that fails, other maps are drawn.

    Turns go by ``turn``, null first, ties by role and text; repeated rows are turns of their own.  Null role or text counts
    as empty.  Rows without a conversation id belong to no conversation and are left out.  A conversation whose rebuilt
    form has no turn still is a member of the root.  Remainders of negative ids are negative, as in SQL.  Extra columns are
    ignored; without any conversation there is no node, not even the root.
    """
    empty = F.lit("")
    plain = rows.select(
        F.col(conv_col).cast("long").alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(role_col, empty).alias("_role"), F.coalesce(text_col, empty).alias("_text")
    ).filter("_conv IS NOT NULL")
    for k, prime in enumerate(primes):
        found = turn_references(plain, str(k))
        if references_clash(found):
            continue
        prefixes = materialize(rebuilt_prefixes(ordered_turns(found, partitions, prime), base, head, most_head, prime), "prefixes")
        pairs = [(F.min(c).alias(f"_{c}_lo"), F.max(c).alias(f"_{c}_hi")) for c in ("p1", "p2", "_r1", "_r2")]
        nodes = prefixes.groupBy(*_NODE).agg(
            F.min("_conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *(c for pair in pairs for c in pair)
        )
        nodes = materialize(nodes, "nodes")
        differ = " OR ".join(f"_{c}_lo <> _{c}_hi" for c in ("p1", "p2", "_r1", "_r2"))
        if not nodes.filter(differ).head(1):
            break
    else:
        raise ValueError("prefixes of different turns share a fingerprint under every choice of maps")
    nodes = nodes.select(*_NODE, F.col("_p1_lo").alias("p1"), F.col("_p2_lo").alias("p2"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"))
    below = nodes.filter("depth > 0")
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, _NODE, "left").fillna(0, ["n_children"]), "nodes")
    parents = materialize(nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")), "parents")
    # the root's and other parents' children may be a large share of all nodes
    inner = attach(materialize(nodes.filter("depth > 0"), "nodes"), parents, ["depth", "p1", "p2"])
    out = inner.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = out.join(_subtree_sums(prefixes, nodes), _NODE, "left").join(_ends(prefixes), _NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long"), F.col("saved_tokens").cast("long"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


SQL = r"""
WITH steps AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
ordered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list({'role': role, 'text': text} ORDER BY place) AS turns FROM ordered GROUP BY c),
heads AS (
  SELECT c, turns, CAST(xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
           lambda v, b: xor(t[(xor(v, b) & 255) + 1], v >> 8), 4294967295)) % 6 AS INTEGER) AS h
  FROM convs, crc),
rebuilt AS (
  SELECT a.c, coalesce(b.turns, [])[1:a.h] || a.turns[a.h + 1:] AS turns FROM heads AS a LEFT JOIN heads AS b ON b.c = a.c - a.c % 100),
prefixes AS (SELECT c, len(turns) AS n, turns, d FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT d AS depth, turns[1:d] AS path, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
weighed AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS weight,
         NOT EXISTS (SELECT 1 FROM nodes AS k WHERE k.depth = nodes.depth + 1 AND k.path[1:nodes.depth] = nodes.path) AS leaf FROM nodes),
sums AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (b.leaf) AS n_leaves, CAST(sum(b.weight) AS BIGINT) AS saved_tokens
  FROM weighed AS a JOIN weighed AS b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
       (SELECT count(*) FROM nodes AS k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS n_children,
       s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums AS s ON s.conv_id = n.conv_id AND s.depth = n.depth
LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


def hundred(conv: Column) -> Column:
    """The conversation that lends its head: c - c % 100."""
    return conv - conv % 100


def crc_head(conv: Column) -> Column:
    """How many turns are borrowed: crc32 of the decimal id, modulo 6."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


@query("op12_prefix_trie", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"), hundred, crc_head, 5)
