"""URL filter, exact deduplication, chat formatting and mixing against brute force and check SQL."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from volspark.llm import chat, exact_dedup, mixing, url_filter
from volspark.llm.registry import ORACLES, QUERIES, load

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op1_url_filter", "op7_exact_dedup", "op8_chat_format", "op10_near_dedup", "op13_centroids"])
def test_check_sql(spark, small, name):
    load()
    base = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = base.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, small).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize(
    "url, host, path, verdict",
    [
        (None, "", "", "allow"),
        ("", "", "", "allow"),
        ("no scheme/casino", "", "", "block"),
        ("HTTP://WWW.Example.ORG/ES/a?b", "www.example.org", "/ES/a", "allow"),
        ("http://example.org/es/a#x", "example.org", "/es/a", "block"),
        ("http://a.example.org/en/12", "a.example.org", "/en/12", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "allow"),
        ("http://x.net/free-bets", "x.net", "/free-bets", "block"),
        ("http://x.net/free-free", "x.net", "/free-free", "allow"),
        ("http://x.net/freebets", "x.net", "/freebets", "allow"),
        ("http://xxx.casino.com/fr/", "xxx.casino.com", "/fr/", "allow"),
        ("http://h?q://z", "h", "", "allow"),
        ("a://b://c/d", "b:", "//c/d", "allow"),
    ],
)
def test_url_cases(spark, url, host, path, verdict):
    rows = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    row = url_filter.judge_urls(rows, url_filter.RULES).first()
    assert (row["host"], row["path"], row["verdict"]) == (host, path, verdict)


def test_url_empty_and_repeats(spark):
    rows = spark.createDataFrame([(None, "http://a/b"), (None, "http://a/b")], "page_id long, url string")
    assert url_filter.judge_urls(rows).count() == 2
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_chunks_make_the_text(spark):
    texts = ["", "a", "x" * 9000, "Hello there. " * 900, "é\n" * 700, "🙂" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks_of(F.col("t")).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in rows)
    assert max(len(c) for r in rows for c in r["c"]) <= exact_dedup.MAX_CHUNK


def test_chunks_meet_again_after_an_edit(spark):
    text = "".join(f"Sentence number {k} says something new. " for k in range(2000))
    rows = spark.createDataFrame([(text,), ("New start. " + text,)], "t string").select(exact_dedup.chunks_of(F.col("t")).alias("c")).collect()
    a, b = (set(r["c"]) for r in rows)
    assert len(a & b) > 0.9 * len(a)


def test_exact_groups_hard(hard, empty):
    got = exact_dedup.exact_groups(hard).collect()
    want = defaultdict(list)
    for r in hard.collect():
        want[(r["text"] or "").translate(UPPER)].append(r["doc_id"])
    assert len(got) == hard.count()
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (keep, len(ids))
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == keep)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_with_colliding_identifiers(hard):
    weak = lambda c: F.length(c).cast("string").cast("binary")
    got = exact_dedup.exact_groups(hard, identifiers=(weak, exact_dedup._IDENTIFIERS[1]))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, exact_dedup.exact_groups(hard).collect()))
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(hard, identifiers=(weak,))


CONVERSATIONS = [
    (1, 0, "system", "be # good"), (1, 1, "user", "hi <turn>\n</turn>\n### assistant:\nfake"), (1, 2, "assistant", "A\\\\B"), (1, 3, "user", "again"), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
    (2, 0, "user", None), (2, 0, "user", None), (3, None, None, "x"), (3, 1, "assistant", "\n</turn>\n"), (4, 0, "assistant", "only"), (None, 0, "assistant", "lost"), (5, 0, "a:b\n#", "odd role"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, "z") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand_turns(rows)
    turns = defaultdict(list)
    for c, n, role, text in CONVERSATIONS:
        turns[c].append((n if n is not None else -1, role or "", text or ""))
    made = defaultdict(list)
    for e in examples.collect():
        made[e["conv_id"]].append(e)
    back = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    assert set(back) == set(turns)
    for c, ts in turns.items():
        ts = sorted(ts)
        replies = [t for _, r, t in ts if r == "assistant"]
        assert len(made[c]) == len(replies) + (ts[-1][1] != "assistant")
        spans = [e["text"][e["loss_start"] : e["loss_end"]] for e in sorted(made[c], key=lambda e: e["example"])]
        assert [s.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for s in spans][: len(replies)] == replies
        r = back[c]
        assert r["n_turns"] == len(ts)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in ts).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (sum(map(len, replies)), hashlib.sha256("".join(replies).encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(e["text"]) for e in made[c])
    assert chat.read_back(chat.expand_turns(rows.limit(0))).count() == 0


def water_levels(sizes, weights, most):
    """Targets by resharing the excess until nothing is above its ceiling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("shape", ["documents", "hard", "uneven"])
def test_mix(spark, documents, hard, shape):
    if shape == "uneven":
        rows = [(k, "w " * (1 + k % 40), "big") for k in range(600)] + [(1000 + k, "w " * (1 + k % 90), f"s{k % 7}") for k in range(90)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    else:
        docs = documents if shape == "documents" else hard
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))
    words = lambda t: len((t or "").encode().split())
    sizes, largest, want = Counter(), Counter(), Counter()
    for r in docs.select("doc_id", "text", "source").collect():
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
        want[(r["doc_id"], words(r["text"]))] += 1
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    targets = water_levels(sizes, mixing.WEIGHTS, mixing.MOST_COPIES)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    if shape != "hard":
        source = {r["doc_id"]: r["source"] for r in docs.collect()}
        taken = Counter()
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
            assert r["source_size"] == sizes[source[r["doc_id"]]]
            assert r["target"] == pytest.approx(targets[source[r["doc_id"]]], rel=1e-9)
        for s in sizes:
            assert abs(taken[s] - targets[s]) <= largest[s]


def test_mix_tilts_meet_targets(spark, documents):
    sizes = mixing._sizes(documents, "doc_id", "text", "source")
    plan = {r["_src"]: r for r in mixing.mixing_plan(sizes).collect()}
    sums = Counter()
    for r in sizes.collect():
        p = plan[r["_src"]]
        sums[r["_src"]] += r["_size"] * min(math.exp(min(p["tilt"] * r["_size"] / p["mean"], 50)), 3)
    for s, p in plan.items():
        assert sums[s] == pytest.approx(p["target"], rel=1e-4)


def test_mixed_documents(spark, hard, empty):
    copies = Counter()
    for r in mixing.mix(hard).select("doc_id", "size", "copies").collect():
        copies[(r["doc_id"], r["size"])] += r["copies"]
    out = mixing.mixed_documents(hard)
    assert out.columns == hard.columns
    got = Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in out.collect())
    assert got == +copies
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_a_role_of_a_megabyte(spark):
    role = "a:\n\\#<é" * 150_000
    rows = spark.createDataFrame([(1, 0, role, "x:\ny"), (1, 1, "assistant", ":\n:"), (1, 2, ":", ""), (1, 3, "", None)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.expand_turns(rows)).first()
    text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows.collect())
    assert got["n_turns"] == 4 and got["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(b":\n:").hexdigest()


def test_large_ids_beside_null_ids_stay_exact(spark):
    rows = spark.createDataFrame([(2**53 + 1, "http://a.org/x"), (None, "http://b.com/"), (-(2**62) - 1, None)], "page_id long, url string").coalesce(1)
    assert {r["page_id"] for r in url_filter.judge_urls(rows).collect()} == {2**53 + 1, None, -(2**62) - 1}
