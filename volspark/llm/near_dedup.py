"""Near-duplicate components by MinHash with tensored banding, verified on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import WordHashes, bounded_batches, table
from volspark.llm.registry import query
from volspark.plans.joins import BROADCAST_ROWS
from volspark.plans.storage import known_rows, materialize, measured

# Two collections of SIDE partial keys, each of HASHES minhashes; a table for every pair of partial keys, one of each.  Two
# sets of similarity 0.8 miss all SIDE * SIDE tables with a chance below 2e-4.
SIDE, HASHES = 13, 3
# Groups of pivots with at most so many members get their pairs directly, others through differences from one pivot.
SMALL = 32
# Rounds in which a document is compared with one pivot before it is with all that are left.
ROUNDS = 3
_BLOCK = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes; words are runs of anything but ASCII white space, A-Z in lower case."""

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHashes()

    def shingles(self, raw: bytes | None) -> np.ndarray:
        """Sorted different shingles; fewer words than a shingle are one shingle, no words none."""
        w = self.hashes.of(raw.lower().split()) if raw else np.zeros(0, np.uint64)
        if not len(w):
            return w
        n = min(self.size, len(w))
        code = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            code = code * _P + w[k : len(w) - n + 1 + k]
        return np.unique(_mixed(code))


def _seeds(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64), rng.integers(0, 1 << 63, count, np.uint64) | np.uint64(1)


def partial_keys(sets: list[np.ndarray], side: int, hashes: int, seed: int = 1) -> np.ndarray:
    """One row per non-empty set with 2 * side partial keys: each mixes ``hashes`` minhashes and its own place."""
    masks, factors = _seeds(2 * side * hashes, seed)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    flat = np.concatenate(sets)
    keys = np.zeros((len(sets), 2 * side), np.uint64)
    for g in range(2 * side):
        code = np.full(len(sets), g + 1, np.uint64)
        for f in range(g * hashes, (g + 1) * hashes):
            code = _mixed(code * _P + np.minimum.reduceat((flat ^ masks[f]) * factors[f], starts))
        keys[:, g] = code
    return keys.view(np.int64)


def _blocks(sets: list[np.ndarray]) -> Iterator[list[int]]:
    block, size = [], 0
    for k, s in enumerate(sets):
        if not len(s):
            continue
        block.append(k)
        size += len(s)
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _sketch(batches: Iterator[pa.RecordBatch], size: int, side: int, hashes: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(size)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [shingler.shingles(t.as_py()) for t in batch.column("_text")]
            low, high = [[] for _ in sets], [[] for _ in sets]
            for block in _blocks(sets):
                for k, row in zip(block, partial_keys([sets[k] for k in block], side, hashes), strict=True):
                    low[k], high[k] = row[:side], row[side:]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), n, pa.array(digest, pa.binary()), pa.array(low, lists), pa.array(high, lists)],
                ["_id", "_n", "_digest", "_low", "_high"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(size)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [shingler.shingles(t.as_py()).view(np.int64) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sets, pa.list_(pa.int64()))], ["_node", "_set"])


def _small_or_shuffled(written: DataFrame, df: DataFrame) -> DataFrame:
    """``df``, of as many rows as the written table: broadcast where they are few."""
    return F.broadcast(df) if known_rows(written) <= BROADCAST_ROWS else df


def _fits(a: Column, b: Column, least: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * least


def contract(links: DataFrame) -> DataFrame:
    """_node, _root for every node of ``links`` (_a, _b): the smallest node reachable.

    Every component hooks to its smallest neighbour, pointers are shortened twice, and links are redrawn between the new
    components until none is left; each round is a written table.
    """
    edges = materialize(links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).filter("_a <> _b").distinct(), "links")
    roots = None
    while known_rows(edges):
        hooks = edges.select(F.col("_b").alias("_node"), F.col("_a").alias("_to")).unionByName(edges.select(F.col("_a").alias("_node"), F.col("_a").alias("_to")))
        hooks = materialize(hooks.groupBy("_node").agg(F.min("_to").alias("_to")), "hooks")
        for _ in range(2):
            nxt = hooks.select(F.col("_node").alias("_to"), F.col("_to").alias("_far"))
            hooks = materialize(hooks.join(nxt, "_to", "left").select("_node", F.coalesce("_far", "_to").alias("_to")), "hooks")
        if roots is None:
            roots = hooks.select("_node", F.col("_to").alias("_root"))
        else:
            step = hooks.select(F.col("_node").alias("_root"), "_to")
            roots = roots.join(step, "_root", "left").select("_node", F.coalesce("_to", "_root").alias("_root"))
        roots = materialize(roots, "roots")
        left = hooks.select(F.col("_node").alias("_a"), F.col("_to").alias("_ra"))
        right = hooks.select(F.col("_node").alias("_b"), F.col("_to").alias("_rb"))
        moved = edges.join(left, "_a").join(right, "_b").select(F.least("_ra", "_rb").alias("_a"), F.greatest("_ra", "_rb").alias("_b"))
        edges = materialize(moved.filter("_a <> _b").distinct(), "links")
    if roots is None:
        return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
    return roots


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (_a, _b) whose whole sets are similar enough."""
    a = sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_sa"))
    b = sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_sb"))
    rows = pairs.select("_a", "_b").join(a, "_a").join(b, "_b")
    both = F.size(F.array_intersect("_sa", "_sb"))
    return rows.select("_a", "_b", both.alias("_both"), (F.size("_sa") + F.size("_sb") - both).alias("_any")).filter(F.col("_both") * 100 >= F.col("_any") * least).select("_a", "_b")


def candidates(nodes: DataFrame) -> DataFrame:
    """_a, _pivot, _shared, _na, _np: every node that shares a table bucket with others, beside the bucket's smallest node.

    Only partial keys that two nodes share can take part in a shared table, so the others go before tables are formed.
    """
    keys = nodes.select(F.explode(F.concat("_low", "_high")).alias("_key"), "_node")
    shared = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_key")
    live = keys.join(shared, "_key", "left_semi").groupBy("_node").agg(F.collect_set("_key").alias("_live"))
    live = live.join(nodes, "_node").select(
        "_node", "_n", F.array_intersect("_low", "_live").alias("_low"), F.array_intersect("_high", "_live").alias("_high")
    )
    live = materialize(live.filter((F.size("_low") > 0) & (F.size("_high") > 0)), "live")
    tables = live.select("_node", "_n", F.explode("_low").alias("_l"), "_high").select("_node", "_n", F.explode(F.transform("_high", lambda h: F.xxhash64(F.col("_l"), h))).alias("_key"))
    first = F.min(F.struct("_node", "_n")).alias("_first")
    buckets = tables.groupBy("_key").agg(first, F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_key", "_first")
    members = tables.join(buckets, "_key").filter(F.col("_node") != F.col("_first._node"))
    return members.groupBy(F.col("_node").alias("_a"), F.col("_first._node").alias("_pivot"), F.col("_n").alias("_na"), F.col("_first._n").alias("_np")).agg(
        F.count(F.lit(1)).alias("_shared")
    )


def _open_groups(stars: DataFrame, comps: DataFrame) -> DataFrame:
    """_group, _node, _n, _comp: the members of pivots that still hold several components, each once.

    Pivots that share a member are one group, named by its pivot with the most members.  A member of many pivots thus meets the
    others of all of them in one place, and the rows grow with the members, not with their places in pivots.
    """
    open_ = _apart(stars.select("_a", F.col("_pivot").alias("_b")), comps).select(F.col("_b").alias("_pivot")).distinct()
    held = materialize(stars.join(open_, "_pivot", "left_semi").select("_pivot", "_a", "_na"), "open")
    if not known_rows(held):
        return held.select(F.col("_pivot").alias("_group"), F.col("_a").alias("_node"), F.col("_na").alias("_n"), F.col("_a").alias("_comp"))
    joined = contract(held.select(F.col("_a").alias("_a"), F.col("_pivot").alias("_b")))
    counted = held.groupBy("_pivot").agg(F.count(F.lit(1)).alias("_held")).join(joined.withColumnRenamed("_node", "_pivot"), "_pivot")
    named = counted.groupBy("_root").agg(F.max_by("_pivot", F.struct("_held", "_pivot")).alias("_group"))
    members = held.select(F.col("_a").alias("_node"), F.col("_na").alias("_n")).distinct()
    members = members.join(joined, "_node").join(named, "_root").join(comps, "_node")
    return materialize(members.select("_group", "_node", "_n", "_comp"), "members")


def _difference_pairs(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Pairs of members of a group (_group, _node, _n, _comp) in different components that may be similar enough.

    Each set is written as that of the node ``_group``, less ``_r`` shingles, plus the ``_add`` ones.  Two sets are similar enough
    when their symmetric difference is at most their sizes times (100 - least) / (100 + least), so two members either share an
    added shingle, or |r - r'| + a + a' is within that bound.  Of the added shingles one of the rarest must be shared: a member
    lacks at most (100 - least) percent of its own set in the other.  No condition loses a pair.
    """
    base = sets.select(F.col("_node").alias("_group"), F.col("_set").alias("_base"))
    rows = members.join(sets.select("_node", "_set"), "_node").join(base, "_group")
    rows = rows.withColumn("_add", F.array_except("_set", "_base")).withColumn("_a", F.size("_add"))
    rows = rows.select("_group", "_node", "_comp", "_n", "_a", (F.size("_base") - F.col("_n") + F.col("_a")).alias("_r"), "_add")
    rows = materialize(rows, "differences")

    # members of a large group are dealt over all tasks before their shingles are written out
    tokens = rows.repartition("_group", "_node").select("_group", "_node", "_comp", F.explode("_add").alias("_t"))
    # An added shingle counts if members of two components have it.  The others stand first in the order, as they are never met.
    # Shingles that the same members have added stand together and are met once.
    often = tokens.groupBy("_group", "_t").agg(
        F.count(F.lit(1)).alias("_df"), F.bit_xor(F.xxhash64("_node")).alias("_who"), F.min("_comp").alias("_least"), F.max("_comp").alias("_most")
    ).filter("_least <> _most").select("_group", "_t", "_df", "_who")
    held = tokens.join(often, ["_group", "_t"]).groupBy("_group", "_node").agg(F.array_sort(F.collect_list(F.struct("_df", "_who", "_t"))).alias("_held"))
    ahead = F.least(F.col("_a"), F.floor(F.col("_n") * (100 - least) / 100) + 1) - (F.col("_a") - F.size("_held"))
    first = F.transform(F.slice("_held", 1, F.greatest(ahead, F.lit(0)).cast("int")), lambda h: F.struct(h["_df"].alias("_df"), h["_who"].alias("_who")))
    kept = rows.drop("_add").join(held, ["_group", "_node"]).withColumn("_key", F.explode(F.array_distinct(first))).drop("_held")
    kept = materialize(kept, "added")
    slack = (F.col("x._n") + F.col("y._n")) * (100 - least) / (100 + least)
    apart = (F.col("x._comp") != F.col("y._comp")) & (F.col("x._node") < F.col("y._node")) & _fits(F.col("x._n"), F.col("y._n"), least)
    gap = F.abs(F.col("x._r") - F.col("y._r"))
    pair = [F.col("x._node").alias("_a"), F.col("y._node").alias("_b")]

    left, right = kept.alias("x"), kept.alias("y")
    shared = left.join(right, [F.col("x._group") == F.col("y._group"), F.col("x._key") == F.col("y._key"), apart, gap + F.abs(F.col("x._a") - F.col("y._a")) <= slack])
    small = rows.drop("_add").filter(F.col("_a") <= F.col("_n") * (100 - least) / least)
    left, right = small.alias("x"), small.alias("y")
    close = left.join(right, [F.col("x._group") == F.col("y._group"), apart, gap + F.col("x._a") + F.col("y._a") <= slack])
    return shared.select(*pair).unionByName(close.select(*pair)).distinct()


# The sign bit: with it turned over, ids order as their sixteen hexadecimal digits do.
_SIGN = -(1 << 63)


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key that orders like the id and differs where one id carries different texts; null without an id."""
    body = F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(_SIGN).cast("long"))), 16, "0")
    return F.concat(body, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _id_of(key: Column, kind: str) -> Column:
    return F.conv(F.substring(key, 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN).cast("long")).cast(kind)


def repeats(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether some id stands on several rows."""
    return bool(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").head(1))


def near_components(
    docs: DataFrame, size: int = 5, least: int = 80, side: int = SIDE, hashes: int = HASHES, small: int = SMALL, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``: see :func:`unique_components`.

    Integer ids may repeat: each text of an id is a document of its own there, whose component is named by the smallest
    id in it; then a row is kept if its own id is that one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    options = dict(size=size, least=least, side=side, hashes=hashes, small=small, rounds=rounds)
    if kind not in ("bigint", "int", "smallint", "tinyint") or not repeats(docs, id_col):
        return unique_components(docs, id_col=id_col, text_col=text_col, **options)
    keyed = docs.select(text_keys(docs, id_col, text_col).alias("_key"), F.col(text_col).alias("_body"))
    found = unique_components(keyed, id_col="_key", text_col="_body", **options)
    own, component = _id_of(F.col("_key"), kind), _id_of(F.col("component_id"), kind)
    return found.select(own.alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(own == component, F.lit(False)).alias("kept"))


def unique_components(
    docs: DataFrame, size: int = 5, least: int = 80, side: int = SIDE, hashes: int = HASHES, small: int = SMALL, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``.

    Texts with a common ``least`` percent of their ``size``-word shingles are linked; components get their smallest id.
    1. Texts with the same set are one class.  2. Candidates come from tensored banding; a bucket is a star around its
    smallest class, so a bucket of any size gives as many pairs as members.  3. Each class is compared with its best pivot,
    then with the next, each time leaving out what is already connected; whole sets decide.  4. Pivots that still hold several
    components and share members are one group, whose members get the remaining comparisons: pairs directly where they are few,
    else by what they differ from one pivot in, which is exact.

    A null, empty or blank text has no shingles and is linked with nothing; fewer words than ``size`` are one shingle.
    Very long texts are compared whole.  Rows that agree in id and text share their component; no id may carry two different
    texts.  A row without an id is not linked: component_id null, not kept.  An empty table gives
    an empty result; extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    sketch = texts.mapInArrow(
        partial(_sketch, size=size, side=side, hashes=hashes), f"_id {kind}, _n long, _digest binary, _low array<long>, _high array<long>"
    )
    sketch = materialize(sketch, "sketch")
    known = sketch.filter(F.col("_id").isNotNull() & F.col("_digest").isNotNull())
    classes = materialize(known.groupBy("_digest").agg(F.min("_id").alias("_node")), "classes")
    nodes = known.join(classes.withColumnRenamed("_node", "_id"), ["_digest", "_id"], "left_semi")
    nodes = nodes.select(F.col("_id").alias("_node"), "_n", "_low", "_high").dropDuplicates(["_node"])

    stars, seen = measured(candidates(nodes), "stars")
    if not seen["rows"]:
        found = classes.select("_digest", F.col("_node").alias("_comp"))
        return _result(sketch, found, id_col)
    comps = stars.select(F.col("_a").alias("_node")).unionByName(stars.select(F.col("_pivot").alias("_node"))).distinct()
    comps = materialize(comps.withColumn("_comp", F.col("_node")), "comps")
    # a set per class; repeated ids may hold different texts, the smallest set stands for them
    wanted = texts.join(_small_or_shuffled(comps, comps.select(F.col("_node").alias("_id"))), "_id", "left_semi")
    sets = wanted.mapInArrow(partial(_sets, size=size), f"_node {kind}, _set array<long>").filter(F.size("_set") > 0)
    sets = materialize(sets.dropDuplicates(["_node"]), "sets")

    left = stars.filter(_fits(F.col("_na"), F.col("_np"), least)).select("_a", "_pivot", "_shared")
    for k in range(rounds + 1):
        left = materialize(left, "left")
        if not known_rows(left):
            break
        best = left
        if k < rounds:
            pick = left.groupBy("_a").agg(F.max_by("_pivot", F.struct("_shared", "_pivot")).alias("_pivot"))
            best = materialize(pick, "best")
        links = materialize(_confirmed(best.withColumnRenamed("_pivot", "_b"), sets, least), "confirmed")
        comps = _joined(comps, links)
        if k < rounds:
            rest = left.join(best, ["_a", "_pivot"], "left_anti")
            left = _apart(rest.withColumnRenamed("_pivot", "_b"), comps).select("_a", F.col("_b").alias("_pivot"), "_shared")

    # pivots whose members are still apart: all of their members' pairs between components are open
    members = _open_groups(stars, comps)
    if known_rows(members):
        sizes = members.groupBy("_group").agg(F.count(F.lit(1)).alias("_c"))
        counted = materialize(members.join(sizes, "_group"), "counted")
        few = counted.filter(F.col("_c") <= small)
        a = few.select("_group", F.col("_node").alias("_a"), F.col("_comp").alias("_ca"), F.col("_n").alias("_na"))
        b = few.select("_group", F.col("_node").alias("_b"), F.col("_comp").alias("_cb"), F.col("_n").alias("_nb"))
        pairs = a.join(b, "_group").filter((F.col("_a") < F.col("_b")) & (F.col("_ca") != F.col("_cb")) & _fits(F.col("_na"), F.col("_nb"), least))
        pairs = pairs.select("_a", "_b")
        many = counted.filter(F.col("_c") > small).drop("_c")
        pairs = pairs.unionByName(_difference_pairs(many, sets, least))
        comps = _joined(comps, materialize(_confirmed(materialize(pairs, "pairs"), sets, least), "confirmed"))
    found = classes.join(comps, "_node", "left").select("_digest", F.coalesce("_comp", "_node").alias("_comp"))
    return _result(sketch, found, id_col)


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between nodes."""
    a = comps.select(F.col("_node").alias("_a"), F.col("_comp").alias("_ca"))
    b = comps.select(F.col("_node").alias("_b"), F.col("_comp").alias("_cb"))
    roots = contract(links.join(a, "_a").join(b, "_b").select(F.col("_ca").alias("_a"), F.col("_cb").alias("_b")))
    roots = roots.select(F.col("_node").alias("_comp"), "_root")
    return materialize(comps.join(roots, "_comp", "left").select("_node", F.coalesce("_root", "_comp").alias("_comp")), "comps")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (_a, _b, ...) that lie in different components."""
    a = comps.select(F.col("_node").alias("_a"), F.col("_comp").alias("_ca"))
    b = comps.select(F.col("_node").alias("_b"), F.col("_comp").alias("_cb"))
    return pairs.join(a, "_a").join(b, "_b").filter("_ca <> _cb").drop("_ca", "_cb")


def _result(sketch: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    rows = sketch.select("_id", "_n", "_digest").join(found, "_digest", "left")
    comp = F.when(F.col("_id").isNotNull(), F.coalesce("_comp", "_id"))
    return rows.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("_id") == comp, F.lit(False)).alias("kept")
    )


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * common >= 80 * (i.c + j.c - common)),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d JOIN (SELECT x, min(root) AS root FROM r GROUP BY 1) m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op10_near_dedup", SQL)
def op10(spark, folder):
    return near_components(table(spark, folder, "documents"), size=4)
