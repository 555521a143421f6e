"""Token counts, token files, language, quality, near copies, decontamination and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from volspark.llm import decontamination as D
from volspark.llm import language, near_dedup, quality, token_counts, token_output
from volspark.llm.common import fresh_folder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def scrambled(count, seed=3):
    rng = random.Random(seed)
    parts = [*" \n\t\x1c\x85 　aZé'!3-sΣ́İ​\x00<|>", "<|endoftext|>", "'s", "  ", "Wort", "été.", "the"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(count)]


def test_counter_equals_library():
    counter, plain = token_counts.Counter(BYTES), Tokenizer.from_file(BYTES)
    for text in scrambled(3000):
        assert counter.count(text) == len(plain.encode(text, add_special_tokens=False).ids), repr(text)


def test_encoder_equals_library():
    encoder, plain = token_output.Encoder(WORDS), Tokenizer.from_file(WORDS)
    for text in scrambled(3000):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_count_tokens_and_cache(spark, hard, empty):
    plain = Tokenizer.from_file(BYTES)
    path = fresh_folder(spark, "cache")
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in hard.collect())
    store = lambda: spark.read.parquet(f"{path}/version={token_counts.tokenizer_version(BYTES)}")
    for part in (hard.filter("doc_id < 9"), hard, hard):
        got = token_counts.count_tokens(part, path, BYTES)
        rows = got.collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    # each different text was encoded and stored once over three calls
    assert store().count() == len({r["text"] or "" for r in hard.collect()})
    assert token_counts.count_tokens(empty, fresh_folder(spark, "cache"), BYTES).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(5)
    for base, size in ((300, 0), (300, 1), (300, 4000), (70_000, 3000)):
        ids = rng.choice(np.array([7, 7, 7, 8, 9, 250]), size).astype(np.uint32)
        cuts = np.unique(rng.integers(0, size + 1, 12)) if size else np.zeros(0, np.int64)
        breaks = np.append(cuts[cuts > 0], size) if size else cuts
        g, ends = token_output.repair(ids, breaks, base, 4, 50)
        written = token_output.expansions(g)
        assert token_output.expand(g, written, 0, len(g.symbols)).tolist() == ids.tolist()
        low = prev = 0
        for cut, end in zip(breaks, ends):
            assert token_output.expand(g, written, low, int(end)).tolist() == ids[prev:cut].tolist()
            low, prev = int(end), int(cut)
        for first in range(0, size, 371):
            assert token_output.ids_between(g, first, min(first + 40, size)).tolist() == ids[first : min(first + 40, size)].tolist()
    assert len(token_output.repair(np.tile(np.array([1, 2, 3], np.uint32), 500), np.array([1500]), 10, 4)[0].symbols) < 100


def test_token_files(spark, hard, empty):
    plain = Tokenizer.from_file(WORDS)
    path = fresh_folder(spark, "shards")
    token_output.write_shards(hard, path, WORDS, shard_ids=200)
    got = token_output.read_shards(spark, path).orderBy("start").collect()
    start, want = 0, Counter()
    for r in hard.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    assert spark.read.parquet(path).count() > 3
    path = fresh_folder(spark, "shards")
    token_output.write_shards(empty, path, WORDS)
    assert token_output.read_shards(spark, path).count() == 0


def test_language(spark, documents, hard, empty):
    model = language.learn(documents)
    rows = language.predict_language(documents.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2), model, ["doc_id", "lang", "held"])
    held = [r for r in rows.collect() if r["held"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    for r, text in zip(language.predict_language(hard, model, ["doc_id", "text"]).collect(), hard.collect()):
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.langs and 0 <= r["score"] <= 1
    assert language.predict_language(empty, model, ["doc_id"]).count() == 0
    assert language.learn(empty) is None
    assert {r["lang_pred"] for r in language.predict_language(hard, None, ["doc_id"]).collect()} == {"und"}


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 20):
        code = language.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2 + 99 * np.eye(n, dtype=int)
        assert apart.min() >= max(1, code.shape[1] // 4)


def test_quality(spark, documents, hard, empty, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_quality(documents, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [d for d in truth if got[d]["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert sum(got[d]["predicted"] == truth[d] for d in held) >= 0.9 * len(held)
    scored = quality.score_quality(hard, labels).collect()
    assert len(scored) == hard.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert quality.score_quality(empty, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(hard, labels.limit(0)).collect()} == {0.5}


def test_trees_split_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = quality.train(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.97


def brute_components(rows, size, least=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.setdefault(d, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(seed, count, words=120):
    """Near copies of one text with growing numbers of edits, of which many are similar to some but not to all."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 900)}" for _ in range(words)]
    out = []
    for _ in range(count):
        copy = list(rng.choice(out)) if out and rng.random() < 0.3 else list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            at = rng.randrange(len(copy))
            copy[at : at + rng.choice([0, 1, 1, 2])] = [f"n{rng.randint(0, 99999)}" for _ in range(rng.choice([0, 1, 1]))]
        out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("size, small", [(5, 32), (4, 2)])
def test_near_components(spark, size, small):
    passage = " ".join(f"common{k}" for k in range(60))
    rng = random.Random(9)
    texts = family(1, 90) + family(2, 40, 40) + [passage + " " + " ".join(f"own{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 40))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), size=size, small=small).collect()
    want = brute_components(rows, size)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_components_hard(spark, hard, empty):
    got = near_dedup.near_components(hard).collect()
    assert len(got) == hard.count()
    assert all(r["component_id"] is None and not r["kept"] for r in got if r["doc_id"] is None)
    comp = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert comp[7] == comp[6] == 6 and comp[0] == 0 and comp[1] == 1
    assert near_dedup.near_components(empty).count() == 0


def test_members_of_many_open_pivots_stand_once(spark):
    rng = random.Random(3)
    base = list(range(100))
    sets = {k: base for k in range(4)}
    for k in range(4, 60):
        gone = rng.sample(base, rng.randint(0, 14))
        sets[k] = [t for t in base if t not in gone] + [rng.randint(200, 230) if k % 3 else 1000 * k + j for j in range(rng.randint(0, 14))]
        sets[k] = sorted(set(sets[k]))
    stars = spark.createDataFrame([(k, p, len(sets[k]), 100) for k in range(4, 60) for p in range(4)], "_a long, _pivot long, _na long, _np long")
    comps = spark.createDataFrame([(k, k) for k in sets], "_node long, _comp long")
    members = near_dedup._open_groups(stars, comps)
    assert sorted(r["_node"] for r in members.collect()) == list(range(4, 60))
    assert members.select("_group").distinct().count() == 1
    rows = spark.createDataFrame(list(sets.items()), "_node long, _set array<long>")
    found = {(r["_a"], r["_b"]) for r in near_dedup._difference_pairs(members, rows, 80).collect()}
    similar = lambda a, b: len(a & b) * 100 >= len(a | b) * 80
    want = {(a, b) for a in range(4, 60) for b in range(a + 1, 60) if similar(set(sets[a]), set(sets[b]))}
    assert want and want <= found


def test_contract_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60) if k % 20 != 19] + [(5, 3), (7, 7)], "_a long, _b long")
    got = {r["_node"]: r["_root"] for r in near_dedup.contract(links).collect()}
    assert got == {k: k // 20 * 20 for k in range(61) if k != 60} | ({60: 60} if 60 in got else {})


def brute_contaminated(docs, items):
    out = set()
    for d, text in docs:
        w = D.words_of(text)
        for i, t in items:
            own = D.words_of(t)
            if own and w:
                weights = D.shingle_weights(own)
                places = range(max(1, len(w) - len(own) + 1))
                if any(D.similarity(D.shingle_weights(w[p : p + len(own)]), weights) >= D.LEAST for p in places):
                    out.add((d, i))
    return out


def test_contaminated(spark, empty, hard):
    rng = random.Random(4)
    text = lambda n: " ".join(f"t{rng.randint(0, 400)}" for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([3, 7, 15, 22, 40, 59, 64, 65, 90, 150])] + [(50, None), (51, ""), (52, "..")]
    docs = []
    for k in range(120):
        words = text(rng.randint(0, 200)).split()
        if k % 2:
            copy = items[rng.randrange(10)][1].upper().split()
            if k % 4 == 3 and len(copy) > 45:
                copy[rng.choice([0, 1, len(copy) // 2, len(copy) - 1])] = "edit"
            at = rng.randint(0, len(words))
            words[at:at] = copy
        docs.append((k, ", ".join(words)))
    docs += [(500, None), (501, ""), (502, items[9][1]), (503, " ".join(items[5][1].split()[:52])), (504, items[9][1] * 2)]
    want = brute_contaminated(docs, items)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (100, 4):
        got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(frame, bench, block=block).collect()}
        assert got <= want and len(got) >= len(want)
    assert {r["doc_id"] for r in D.without_contaminated(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert D.contaminated(empty, bench).count() == 0 and D.contaminated(hard, bench.limit(0)).count() == 0
    assert D.without_contaminated(hard, bench).columns == hard.columns and D.without_contaminated(hard, bench).count() == hard.count()


def edge_copies(lengths, seed):
    """(items, texts): copies shortened or reworded at the start, in the middle or at the end, down to similarity LEAST."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    items, texts = [], []
    for k, n in enumerate(lengths):
        own = fresh(n)
        items.append((k, " ".join(own)))
        for edits in range(1, n // 6 + 1):
            for at in (0, (n - edits) // 2, n - edits):
                for new in (edits, 0):
                    copy = own[:at] + fresh(new) + own[at + edits :]
                    texts.append((len(texts), " ".join(fresh(30) + copy + fresh(30))))
    return items, texts


def assert_none_lost(lengths, seed):
    items, texts = edge_copies(lengths, seed)
    index = D.Index(items)
    found = index.matches([D.words_of(t) for _, t in texts], D.WordHashes())
    want = brute_contaminated(texts, items)
    assert len(want) > len(lengths) and {(d, index.items[i][0]) for (d, _), hits in zip(texts, found, strict=True) for i in hits} == want


def test_no_edge_cut_copy_of_a_long_item_is_lost():
    assert_none_lost([80, 127], 5)


def test_no_edge_cut_copy_of_a_short_item_is_lost():
    assert_none_lost([*range(10, 25, 2), 40, 64], 6)


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 1 << 63, 200, np.uint64) * np.uint64(2) + rng.integers(0, 2, 200, np.uint64)
    for size, marks in D.fingerprints(pairs, 100, [1, 2, 5, 6, 9, 20, 64]):
        for p in (0, 17, 99):
            window = pairs[p : p + size - 1]
            bits = [sum(int(x) >> b & 1 for x in window) * 2 > len(window) for b in range(64)]
            assert int(marks[p]) == sum(1 << b for b, v in enumerate(bits) if v)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = D.Index([(k, " ".join(f"v{k}x{j}" for j in range(20))) for k in range(6)])
    own = index.marks[D.window_size(20)]
    marks = rng.integers(0, 1 << 63, 3000, np.uint64)
    for k in range(0, 3000, 3):
        flips = rng.choice(64, rng.integers(0, 14), replace=False)
        marks[k] = own[k % 6] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else own[k % 6]
    places, entries = index._near(D.window_size(20), marks)
    far = np.bitwise_count(marks[:, None] ^ own[None, :])
    assert set(zip(places.tolist(), entries.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= D.RADIUS))))


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    previous = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, previous, small)
        path = f"{tmp_path}/{number}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before = [(r["doc_id"], r["text"]) for r in previous.collect()]
        after = Counter(r["doc_id"] for r in out.collect())
        if number < 4:
            assert out.columns == docs.columns
        if number == 0:
            assert set(after) == {d for d, t in before if any(c.isalpha() for c in t)}
        if number == 1:
            assert set(after) == {root for _, root in brute_components(before, 5).values()}
        if number == 2:
            assert set(after) == {d for d, _ in before} - {d for d, _ in brute_contaminated(before, bench)}
        if number == 3:
            assert max(after.values()) <= 3 and set(after) <= {d for d, _ in before}
        if number == 4:
            assert after == Counter(d for d, _ in before)
        previous = out


def test_stages_take_hard_rows(spark, hard, empty, small):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, small)
            out.collect()
    kept = defaultdict(int)
    for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, small).collect():
        kept[r["doc_id"]] += 1
    assert kept[6] == 1 and 7 not in kept and kept[3] == 2 and kept[None] == 2


def test_number_signs_are_no_letters(spark):
    from volspark.llm.common import has_letter

    assert not any(has_letter(t.encode()) for t in ("½ ² ①", "Ⅷ ٣ 一2"[:3], "12 ३ _ 🙂"))
    assert all(has_letter(t.encode()) for t in ("½ª", "日", "é", "① x"))
    docs = spark.createDataFrame([(k, f"the quick dog {k}", "en") for k in range(40)] + [(100, "½ ² ①", None)], "doc_id long, text string, lang string")
    seen = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs, language.learn(docs), ["doc_id"]).collect()}
    assert seen[100] == "und" and seen[3] == "en"


def test_rare_languages_are_learned_and_copies_do_not_fill_the_sample(spark):
    rows = [(k, f"the quick brown fox number {k} jumps over it", "en") for k in range(3000)]
    rows += [(10_000 + k, "the very same text again and again", "en") for k in range(3000)]
    rows += [(20_000 + k, f"żółty kot {k} śpi na płocie źle", "pl") for k in range(12)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    assert sorted(model.langs) == ["en", "pl"]


def test_shards_with_another_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello world, Foo Bar", "", None, "a  b\n\nc", "ÉTÉ <|endoftext|> x", "don't"]
    encoder = token_output.Encoder(path)
    got = encoder.encode_all([None if t is None else t.encode() for t in texts])
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got == want and not encoder.wordwise
    assert token_output.Encoder(public_tokenizers.path("word_bpe_49k.json")).wordwise


def test_texts_of_one_id_are_compared_each(spark):
    words = lambda seed: " ".join(f"w{(seed * 7919 + i * 31) % 997}" for i in range(40))
    a, b = words(1), words(2)
    docs = spark.createDataFrame([(1, a), (5, a + " end"), (5, b), (9, b), (-3, words(3)), (-3, words(3))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs).collect())
    assert got == [(-3, -3, True), (-3, -3, True), (1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False)]


def test_the_pipeline_keeps_a_unique_text_under_a_repeated_id(spark):
    import corpus_pipeline

    words = lambda seed: " ".join(f"w{(seed * 7919 + i * 31) % 997}" for i in range(40))
    docs = spark.createDataFrame([(1, words(1), "x"), (5, words(1), "x"), (5, words(2), "y"), (5, words(2), "y"), (None, words(1), "z")], "doc_id long, text string, source string")
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, words(1)), (1, words(1)), (5, words(2))]
    assert left.columns == docs.columns


def test_plain_texts_are_cut_into_pieces_without_their_words():
    encoder, library = token_output.Encoder(WORDS), Tokenizer.from_file(WORDS)
    texts = ["It's 12\t\u00c9t\u00e9, 'RE!'s don''t", "a<b <|endoftext", "", "  \x0b\n", "word " * 300]
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_all([t.encode() for t in texts])] == [ids(t) for t in texts]
    assert not encoder.words and "word" in encoder.pieces
    for text in ("a <|EndOfText|> b", "a<|endoftext|>b", "\u65e5\u672c it's", "e\u0301\x85b"):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids(text)
    assert encoder.words
