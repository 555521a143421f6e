"""The prefix trie against rebuilt turn lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from volspark.llm import prefix_trie as trie
from volspark.llm.prefix_trie import PRIME, crc_head, hundred

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, _conv int, weight int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return trie.prefix_trie(df, hundred, crc_head, 5, **options)


def check(got, want):
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def chats(n, seed=1, texts=4, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice("abcdefgh"[:texts]) * rng.randrange(1, 3)))
    return rows


def test_equals_brute_force_over_many_tasks(spark):
    rows = chats(450) + [(-5, 0, "user", "a"), (-205, 1, "user", "b"), (-200, 1, "user", "c"), (-200, 3, "user", "d")]
    random.Random(3).shuffle(rows)
    check(run(spark, rows, partitions=7), brute(rows))


def test_a_long_conversation_crosses_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(100, t, "user", f"turn {t % 3}") for t in range(60)] + [(103, t, "user", f"turn {t % 3}") for t in range(45)] + chats(30)
    check(run(spark, rows, partitions=9), brute(rows))


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [
        (None, 0, "user", "no conversation"), (7, None, "user", "first"), (7, None, None, None), (7, 0, "user", None), (7, 0, "user", None),
        (7, 2, None, "x"), (100, 5, "user", "only"), (101, 1, "b", "tie"), (101, 1, "a", "tie"), (101, 1, "a", "other"), (199, 0, "user", "\n"),
        (201, 0, "user", "short without base"), (202, 0, "user", "🙂é" * 3), (203, 0, "us", "er"), (204, 0, "use", "r"),
    ]
    assert any(depth == 0 and ends != hashlib.sha256(b"").hexdigest() for _, depth, *_, ends in brute(rows))
    check(run(spark, rows), brute(rows))
    check(run(spark, rows + rows), brute(rows + rows))


def test_one_text_in_all_conversations_and_very_long_texts(spark):
    rows = [(c, t, "user", "hot") for c in range(300) for t in range(3)] + [(400, 0, "user", "y" * 300_000), (401, 0, "user", "y" * 300_000)]
    check(run(spark, rows, partitions=5), brute(rows))


def test_empty_table(spark):
    assert run(spark, []).collect() == [] and run(spark, [(None, 1, "a", "b")]).collect() == []


def test_clashing_fingerprints_are_found_and_drawn_anew(spark):
    rows = chats(200, 5, 8)
    check(run(spark, rows, primes=(3, PRIME)), brute(rows))
    with pytest.raises(ValueError, match="share a fingerprint"):
        run(spark, rows, primes=(3, 5))


def test_products_compose():
    rng = random.Random(2)
    a, b, c = (trie.turn_map(rng.getrandbits(60), rng.getrandbits(60)) for _ in range(3))
    assert trie.then(trie.then(a, b), c) == trie.then(a, trie.then(b, c))
    assert trie.then(trie.inverse(a), trie.then(a, b)) == b and trie.then(a, trie.inverse(a)) == trie.IDENTITY
    assert trie.then(a, b) != trie.then(b, a)


def test_query_equals_check_sql_and_brute_force(spark, small):
    import duckdb

    from volspark.llm.registry import ORACLES, QUERIES, load

    load()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    got = QUERIES["op12_prefix_trie"](spark, small)
    check(got, base.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_prefix_trie']})").fetchall())
    check(got, brute(base.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()))
