"""Each operator against its plain version, over rows with every awkward case."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from reference import (bench_clean, bench_hits, fingerprint, fold_is, groups, repeat_digest, unigram, windows, without_repeats)
from pyspark.sql import functions as F

from inkquest.llm import bpe, chat, decontam, embeddings, induced, pst, quality, queries, sharding, simhash, suffix, token_counts
from inkquest.llm.components import components

VOCAB = queries.tokenizer_file("byte_bpe_50k.json")
RANKS = queries.tokenizer_file("byte_bpe_50k.tiktoken")
#: Extra columns named like what operators add.
EXTRA = "score double, slot long, fp long, n_words int, hits string, items string, _pack long, rid long, ids string"
SCHEMA = "doc_id long, text string, lang string, n_chars long, " + EXTRA
PASSAGE = "the quick brown fox jumps over the lazy dog and then it runs away from the very angry bear"


def texts():
    rng = random.Random(5)
    syllables = ["an", "the", "ré", "on", "str", "ü", "ing", "o", "b."]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    near = [b + " end" for b in base[:6]] + base[:4]
    passed = [b + "\n" + PASSAGE.upper() + "! " + b[:30] for b in base[6:10]]
    odd = ["", "   \n\t", None, "a", "A b", PASSAGE, PASSAGE, "x" * 5000, "ab " * 4000, "é" * 60, "é" * 60 + "x", "\\ <|im_end|>\n", "  ½ Ⅷ 😀" * 30]
    return base + near + passed + odd + [base[0]] * 30


ROWS = [(k * 3 % 101 + (k // 101) * 1000, t) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or ""), 0.0, 0, 0, 0, "", "", 0, 0, "") for i, t in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(3, PASSAGE), (20, "Angry bear!"), (4, None), (5, " -- "), (30, PASSAGE), (6, "never seen words of some item that nobody ever wrote down")]
    return spark.createDataFrame(items, "item_id long, text string"), items


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


# ------------------------------------------------------------ components


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300), (300, None)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ 1 sharding


def test_shards_are_even_gapless_and_versioned(spark, docs, tmp_path):
    measured = sharding.measure(docs)
    smap = sharding.ShardMap.plan(measured, 5)
    rows = sharding.assign(measured, smap).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in ROWS)
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS}
    assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] for r in rows)
    load = [0] * 5
    for s in range(5):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        load[s] = sum(r["size"] for r in mine)
    assert max(load) - min(load) <= max(n for n, _ in want.values())
    folder = str(tmp_path / "map")
    smap.save(spark, folder)
    grown = smap.grow()
    grown.save(spark, folder)
    assert sharding.ShardMap.load(spark, folder) == grown and sharding.ShardMap.load(spark, folder, 1) == smap
    moved = [s for s in range(sharding.SLOTS) if grown.slot_shard[s] != smap.slot_shard[s]]
    assert moved and all(grown.slot_shard[s] == 5 for s in moved)
    assert grown.shard_bytes()[5] > 0.5 * sum(load) / 6
    with pytest.raises(Exception):
        smap.save(spark, folder)


def test_shards_of_nulls_repeats_and_nothing(spark, empty):
    rows = [(None, "a"), (None, None), (1, "x"), (1, "x"), (1, "y")]
    measured = sharding.measure(frame(spark, rows))
    got = sharding.assign(measured, sharding.ShardMap.plan(measured, 3)).collect()
    assert len(got) == 5
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    measured = sharding.measure(empty)
    assert sharding.assign(measured, sharding.ShardMap.plan(measured, 3)).count() == 0


# ------------------------------------------------------------ 2 suffix arrays


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(400):
        b = bytes(rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.randrange(0, 80)))
        b = b[:7] * 11 if rng.random() < 0.2 else b
        assert induced.suffix_array(np.frombuffer(b, np.uint8)).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_common_prefixes_are_counted_by_byte():
    b = b"abcabcabcabcabcabcabcabcabcx" * 2
    t = np.frombuffer(b, np.uint8)
    a, c = np.arange(27), np.arange(3, 30)
    want = [next((k for k in range(20) if b[x + k] != b[y + k]), 20) for x, y in zip(a, c)]
    assert induced.common_prefix(induced.words_at(t), a, c, 20).tolist() == want


@pytest.mark.parametrize("pack, cut, shard", [(4_000_000, 500_000, 8_000_000), (3_000, 400, 1_000)])
def test_repeats_against_brute_force(docs, monkeypatch, pack, cut, shard):
    monkeypatch.setattr(suffix, "PACK_BYTES", pack)
    monkeypatch.setattr(suffix, "SLICE", cut)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    got = by_id(suffix.removal_report(docs))
    want = dict(zip([i for i, _ in ROWS], repeat_digest(ROWS)))
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 10_000
    got = by_id(suffix.remove_repeats(docs))
    assert {i: r["text"] for i, r in got.items()} == dict(zip([i for i, _ in ROWS], without_repeats(ROWS)))
    assert got[0]["lang"] == "en" and got[0]["_pack"] == 0


def test_repeats_of_equal_ids_null_ids_and_nothing(spark, empty):
    long = PASSAGE * 2
    got = suffix.removal_report(frame(spark, [(5, long), (5, long), (None, long), (7, None)])).collect()
    n = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in got)
    assert n == [(False, 5, 0), (False, 5, 0), (False, 7, 0), (True, 0, len(long))]
    assert suffix.removal_report(empty).count() == 0 and suffix.remove_repeats(empty).count() == 0


# ------------------------------------------------------------ 3 quality


def test_quality_tells_held_out_rows_apart_and_never_reads_their_labels(spark):
    rng = random.Random(1)
    good = ["ing", "the", "an", "re", "tion", "er", "st"]
    text = lambda bad: " ".join(("".join(rng.choice(good) for _ in range(3)).upper() + "!!" if bad else "".join(rng.choice(good) for _ in range(3))) for _ in range(rng.randint(5, 200)))
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs = frame(spark, rows)
    out = quality.held_out(F.col("doc_id"), 4, 2)
    label = lambda flip: spark.createDataFrame([(i, int((i % 4 != 0) ^ (flip and fold_is(i, 4, 2))), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    a = by_id(quality.score(docs, quality.fit(docs, label(False), usable=~out)))
    b = by_id(quality.score(docs, quality.fit(docs, label(True), usable=~out)))
    assert all(a[i]["score"] == b[i]["score"] for i in a)
    held = [i for i in a if fold_is(i, 4, 2)]
    assert len(held) > 50 and np.mean([(a[i]["score"] >= 0.7) == (i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in a.values()) and a[1]["lang"] == "en"


def test_quality_means_the_same_for_any_size_of_sample(spark, monkeypatch):
    rng = random.Random(5)
    words = [["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)] for _ in range(2)]
    mixed = lambda k: " ".join(rng.choice(words[k if rng.random() < 0.55 else 1 - k]) for _ in range(40))
    rows = [(i, mixed(int(i % 20 >= 3))) for i in range(4000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 20 >= 3)) for i, _ in rows], "doc_id long, quality int")
    means = []
    for most in (6_000, 300):
        monkeypatch.setattr(quality, "SAMPLE_ROWS", most)
        model = quality.fit(docs, labels)
        assert abs(model.prior - 0.85) < 0.01
        means.append(quality.score(docs, model).agg(F.avg("score")).first()[0])
    assert all(abs(m - 0.85) < 0.06 for m in means)


def test_an_oversized_text_does_not_end_the_quality_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 64_000)
    rows = [(i, "x" * (70_000 if i % 3 == 0 else 50_000 if i % 3 == 1 else 100)) for i in range(60)]
    lab = quality.labelled(spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int"))
    got = [len(r["text"]) for r in quality.sample(frame(spark, rows), lab).collect()]
    assert sorted(got) == [100] * 20 + [50_000]


def test_quality_without_labels_texts_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {1.0}
    one = spark.createDataFrame([(ROWS[0][0], 1), (ROWS[1][0], 0), (None, 1), (ROWS[2][0], None), (ROWS[3][0], 7)], "doc_id long, quality int")
    got = by_id(quality.score(docs, quality.fit(docs, one)))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.score(empty, quality.fit(empty, none)).count() == 0


# ------------------------------------------------------------ 4 SimHash


@pytest.mark.parametrize("trie_rows", [50_000, 2])
def test_simhash_against_all_pairs(docs, trie_rows):
    got = by_id(simhash.near_duplicates(docs, trie_rows=trie_rows))
    fp = [fingerprint(t) for _, t in ROWS]
    low = groups([i for i, _ in ROWS], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {i: (r["fp"] % (1 << 64), r["component_id"]) for i, r in got.items()} == {i: (f, c) for (i, _), f, c in zip(ROWS, fp, low)}


@pytest.mark.parametrize("trie_rows", [50_000, 3])
@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_fingerprint_links_are_exactly_the_near_pairs(spark, budget, trie_rows):
    rng = random.Random(budget)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(8)}
    fps |= {0, 1, (1 << 64) - 1, 1 << 63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed + signed[:5] + [None]], "fp long")
    got = [frozenset(map(int, r)) for r in simhash.links(df, budget, trie_rows).collect()]
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= budget}
    assert len(got) == len(set(got)) and set(got) == want


def test_trie_join_in_small_portions(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 300).astype(np.uint64))
    x, y = simhash.trie_join(fps, [(0, len(fps), 0, len(fps))], 2)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == want and len(x) == len(want)


@pytest.mark.parametrize("leaf", [1, 6, 400])
def test_trie_nodes_that_are_not_opened_give_the_same_pairs(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 50)
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    of = rng.integers(0, 4, len(fps))
    for groups_of in (None, of):
        x, y = simhash.trie_join(fps, [(0, len(fps), 0, len(fps))], 2, groups_of)
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2 and (groups_of is None or of[i] != of[j])}
        assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == want and len(x) == len(want)


def test_sides_that_grow_with_the_fingerprints_are_not_broadcast(spark):
    fps = spark.range(500).select((F.col("id") * 7_919).alias("fp"))
    for found in (simhash.links(fps, 8), simhash._with_component(fps, fps.select(F.col("fp").alias("a"), F.lit(0).cast("long").alias("b")))):
        found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()


def test_one_document_of_each_group_stays(spark, empty):
    rows = [(4, PASSAGE), (2, PASSAGE.upper()), (9, "something else here"), (9, "something else here"), (None, PASSAGE), (11, ""), (12, None)]
    got = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [2, 9, 11]
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one_go_with_their_own_group(spark):
    other, third = "quite another text about rivers and boats", "a third one that nobody has copied so far"
    rows = [(3, PASSAGE), (5, PASSAGE), (5, other), (8, other), (None, PASSAGE), (None, third), (None, "alone as well but unlike the rest"), (None, third)]
    got = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == sorted([(3, PASSAGE), (5, other), (0, third), (0, "alone as well but unlike the rest")])


# ------------------------------------------------------------ 5 embeddings


@pytest.mark.parametrize("block", [4096, 7])
def test_vector_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 16))
    x = np.vstack([centre, centre[:30] + 0.08 * rng.normal(size=(30, 16)), centre[:5] + 0.12 * rng.normal(size=(5, 16)), np.repeat(centre[:1], 25, 0), 3 * centre[1:3],
                   centre[0] + 0.05 * rng.normal(size=(40, 16))]).astype(np.float32)
    rows = [(1000 - i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1, None, 1), (2, [0.0] * 16, 1), (3, [1.0, None] + [0.0] * 14, 1), (4, [float("nan")] + [1.0] * 15, 1), (5, [float("inf")] + [1.0] * 15, 1),
           (6, [], 1), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (None, x[0].tolist(), 1), (9, [0.0, -0.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.near_duplicates(df, block=block).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    low = groups([r[0] for r in rows], lambda a, b: near[a, b])
    want = {r[0]: (int(near[i].sum()) - 1, low[i], low[i] == r[0]) for i, r in enumerate(rows)}
    want |= {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)} | {7: (1, 7, True), 8: (1, 7, False), None: (0, None, False)}
    assert got == want


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ------------------------------------------------------------ 6 suffix tree


def word_beginnings(tree, texts, shortest):
    """Contexts from a word's start that the tree keeps beside its automaton: what follows them how often, by plain counting."""
    table, found = tree.symbols.table(), {}
    for t in texts:
        for w in pst.words_of(t):
            for j in range(shortest, len(w) + 1):
                found.setdefault(w[:j], Counter())[w[j:j + 1]] += 1

    def state_behind(context):
        state = 0
        for b in context:
            state = tree.next[state, table[b]]
        return state

    kept = {}
    for c, seen in found.items():
        n, row = sum(seen.values()), tree.logp[state_behind(b" " + c)]
        up = {s: 10.0 ** row[table[s[0]]] if s else 10.0 ** row[table[32]] + 10.0 ** row[table[10]] for s in seen}
        held = any(tree.length[state_behind(f + c)] == len(c) + 1 for f in (b" ", b"\n"))
        if n >= 8 and not held and sum(k * math.log(k / n / up[s]) for s, k in seen.items()) >= 0.5 * math.log(n) * max(len(seen) - 1, 1):
            kept[c] = seen
    return kept


@pytest.mark.parametrize("keys,hot", [((4, 12, 36, 108), 200_000), ((1, 3, 200), 5)])
def test_scores_against_counts_and_by_walking_the_tree(spark, docs, monkeypatch, keys, hot):
    out = quality.held_out(F.col("doc_id"), 7, 2)
    monkeypatch.setattr(pst, "KEYS", keys)
    monkeypatch.setattr(pst, "HOT_WORDS", hot)
    monkeypatch.setattr(pst, "P_MIN", 1e-3)
    monkeypatch.setattr(pst, "HEAD_SHARE", 0.01)
    n, want = unigram(ROWS, lambda i: fold_is(i, 7, 2))
    got = by_id(pst.score(docs, ~out, out))
    for (i, _), (tokens, known, base) in zip(ROWS, want):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold_is(i, 7, 2), tokens, known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    _, tree = pst.learn(docs, ~out)
    if hot > 5:
        kept = word_beginnings(tree, [t for i, t in ROWS if not fold_is(i, 7, 2)], keys[0])
        assert len(kept) > 10
    assert np.allclose((10.0 ** tree.logp[:, :-1]).sum(1) + 10.0 ** tree.logp[:, -1] * (256 - tree.symbols.n), 1, atol=1e-4)
    table = tree.symbols.table()
    for i, t in ROWS:
        state, total, begun = tree.start, 0.0, b""
        for b in b" ".join(pst.words_of(t)) + b"\n":
            row = tree.logp[state]
            p, end = 10.0 ** row[table[b]], b in b" \n"
            if hot > 5 and begun in kept:
                seen, kinds, n_all = kept[begun], len(kept[begun]), sum(kept[begun].values())
                up = 10.0 ** row[table[32]] + 10.0 ** row[table[10]] if end else p
                p *= (seen.get(b"" if end else bytes([b]), 0) + kinds * up) / (n_all + kinds) / up
            total += math.log10(p)
            begun = b"" if end else begun + bytes([b])
            state = tree.next[state, table[b]]
        if hot > 5:
            assert math.isclose(total, got[i]["score"], rel_tol=1e-4)


def test_contexts_are_counted_over_all_texts(spark):
    rows = [(k, "abcab abcab" if k % 2 else "abd") for k in range(60)]
    old = pst.P_MIN
    pst.P_MIN = 1e-9
    try:
        words, tree = pst.learn(frame(spark, rows))
    finally:
        pst.P_MIN = old
    assert {bytes(r["word"]): r["n"] for r in words.collect()} == {b"": 60, b"abcab": 60, b"abd": 30}
    table, state = tree.symbols.table(), tree.start
    for b in b"abca":
        state = tree.next[state, table[b]]
    assert 10 ** tree.logp[state, table[ord("b")]] > 0.95


def test_scores_without_training_or_rows(spark, docs, empty):
    r = by_id(pst.score(docs, F.lit(False), F.lit(True)))
    assert all(x["n_known"] == 0 and x["train_tokens"] == 0 and x["base_score"] == 0 for x in r.values())
    assert pst.score(empty, F.lit(True), F.lit(False)).count() == 0


# ------------------------------------------------------------ 7 BPE, 8 counts


def test_bpe_like_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    extra = [(9000, "<|endoftext|>a<|endoftext|>"), (9001, "it's we'LL \x1c\x1d a\x85b"), (9002, "aaaaaaa" * 300), (9003, " " * 40 + "x")]
    got = by_id(bpe.round_trip_digest(docs.unionByName(frame(spark, extra)), VOCAB))
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs.unionByName(frame(spark, extra)), VOCAB).collect()}
    for i, text in ROWS + extra:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    back = by_id(bpe.decode(bpe.encode(docs, VOCAB), VOCAB))
    assert {i: r["text"] for i, r in back.items()} == {i: t or "" for i, t in ROWS}
    assert bpe.round_trip_digest(empty, VOCAB).count() == 0


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    m = bpe.Merger(VOCAB)
    a = [x.tolist() for t in ["one two three four", "five six seven", "one two three four"] for x in m.encode([t])]
    assert a[0] == a[2] == [x.tolist() for x in bpe.Merger(VOCAB).encode(["one two three four"])][0]


def test_length_histogram_and_limits(spark, docs, empty):
    n = sorted(len(token_counts.encoding(RANKS).encode_ordinary(t or "")) for _, t in ROWS)
    sums = token_counts.suffix_sums(token_counts.lengths_histogram(docs, RANKS), width=16)
    rows = {r["length"]: r for r in sums.collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (n.count(x), sum(k >= x for k in n), sum(k for k in n if k >= x))
        assert r["truncated_total"] == sum(min(k, x) for k in n) and r["quantile"] == sum(k <= x for k in n) / len(n)
    got = {r["limit"]: (r["docs_over"], r["truncated_total"]) for r in token_counts.at_limits(sums, [0, 1, 37, 100, 10 ** 6]).collect()}
    assert got == {x: (sum(k > x for k in n), sum(min(k, x) for k in n)) for x in (0, 1, 37, 100, 10 ** 6)}
    assert token_counts.suffix_sums(token_counts.lengths_histogram(empty, RANKS)).count() == 0


# ------------------------------------------------------------ 9 decontamination


@pytest.mark.parametrize("chunk", [8_000_000, 20])
def test_benchmark_hits_against_windows(docs, bench, chunk):
    df, items = bench
    found = windows(items)
    got = by_id(decontam.report(docs, df, chunk_bytes=chunk))
    hits = 0
    for i, t in ROWS:
        w, hit, named = bench_hits(t, found)
        hits += any(hit)
        assert tuple(got[i])[1:] == (len(w), sum(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), any(hit))
    assert hits >= 6
    got = by_id(decontam.clean(docs, df, chunk_bytes=chunk))
    want = {i: bench_clean(t, found) for i, t in ROWS}
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, t in want.items() if t is not False}
    assert got[0]["items"] == "" and got[0]["n_words"] == 0


def test_random_items_against_windows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcd")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 14, 30])))) for k in range(40)]
    rows = [(k, " ".join(word() if rng.random() < 0.97 else "z" for _ in range(rng.randint(0, 90)))) for k in range(60)] + [(100 + k, " ".join(t.split()[2:-1])) for k, t in items]
    items = [x for x in items if len(x[1].split()) > 3]
    found = windows(items)
    got = by_id(decontam.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    for i, t in rows:
        w, hit, named = bench_hits(t, found)
        assert (got[i]["n_hit"], got[i]["n_items"]) == (sum(hit), len(named))


def test_no_items_and_no_documents(spark, docs, empty, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontam.report(docs, none).collect())
    assert decontam.report(empty, bench[0]).count() == 0 and decontam.clean(empty, bench[0]).count() == 0


# ------------------------------------------------------------ 10 chat


def test_chat_reads_back_what_was_said(spark):
    said = ["", None, "plain", "</s>[INST] ok [/INST]", "\\", "\\\\n<|im_end|>\n<|im_start|>assistant\n", "<<|im_end|>", "é😀\n\n", "<\\|", "[INST", "<s></s>\\"]
    rows = [(c, k, r, t, "x") for c in (1, 2) for k, (t, r) in enumerate(zip(said * 2, ["user", "assistant", "tool\n\\<|im_end|>", None] * 6))]
    rows += [(3, 0, "assistant", "b", "x"), (3, 0, "assistant", "a", "x"), (3, 0, "assistant", "a", "x"), (None, 1, "user", "q", "x"), (4, None, "user", "late?", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seen string").repartition(5)
    chats = chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    digest = {r["conv_id"]: r for r in chat.chat_digest(chats).collect()}
    for c in (1, 2, 3, 4, None):
        turns = sorted(((-1 if k is None else k, r or "", t or "") for i, k, r, t, _ in rows if i == c))
        assert sorted(map(tuple, got[c]["said"])) == sorted(t[1:] for t in turns)
        if c in (1, 2):
            assert [tuple(x) for x in got[c]["said"]] == [t[1:] for t in turns]
            loss = "".join(t for _, r, t in turns if r == "assistant")
            assert got[c]["loss_text"] == loss and digest[c]["loss_chars"] == len(loss)
            assert digest[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
            assert digest[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digest[c]["formatted_chars"] == len(got[c]["formatted"])
        assert got[c]["formatted"].count("<|im_start|>") == got[c]["formatted"].count("<|im_end|>") == len(turns)
    assert got[3]["loss_text"] == "aab"


def test_parts_become_placeholders_in_order(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", None), ("video", None, "c.mp4", 2), (None, " end", None, None), ("document", "ignored", "d.pdf", 0)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None), ("image", None, "e.png", 1), ("text", "!", None, None)]), (2, 0, "user", None), (2, 1, "user", [])],
                               f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert got[1]["formatted"].startswith("<|im_start|>user\nsee <\\|image|><|image|><|audio|><|attachment|> end<|document|><|im_end|>\n")
    assert [tuple(a) for a in got[1]["attachments"]] == [("image", "a.png", 768), ("audio", "b.wav", 25), ("video", "c.mp4", 2), ("document", "d.pdf", 512), ("image", "e.png", 256)]
    assert got[1]["attachment_tokens"] == 768 + 25 + 2 + 512 + 256
    t = got[1]["turns"][1]
    assert [got[1]["formatted"][t["start"] + s["start"]:][:s["length"]] for s in t["loss"]] == ["ok", "!"]
    assert got[2]["formatted"] == "<|im_start|>user\n<|im_end|>\n" * 2
    assert chat.format_chat(df.limit(0)).count() == 0


def test_the_language_model_learns_more_from_more(spark):
    """Contexts that begin with a word grow with the corpus, and held-out texts score better than by word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = []
    for part in (docs.where("doc_id % 4 = 0"), docs):
        words, tree = pst.learn(part)
        groups = {}
        for r in words.where("word <> X''").collect():
            groups.setdefault(bytes(r["word"])[:4], []).append((bytes(r["word"]), r["n"]))
        kept.append(sum(pst._deeper(tree, sorted(g), 4)[1] for g in groups.values()))
    assert kept[1] > 2.5 * kept[0] > 0
    out = quality.held_out(F.col("doc_id"), 7, 2)
    r = pst.score(docs, ~out, out).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    print("held-out score, base:", r["s"], r["b"], "contexts", kept)


@pytest.mark.parametrize("keys,hot", [((4, 12, 36, 108), 3), ((4, 6, 9), 2)])
def test_contexts_of_frequent_beginnings_are_counted_wherever_their_words_meet(spark, monkeypatch, keys, hot):
    """Beginnings that many words share count as others do, also those of fewer bytes than their words meet by."""
    rows = [(1, b"", 900)] + [(1, w.encode(), n) for w, n in [("interna", 40), ("internal", 300), ("internally", 90), ("international", 500), ("internationally", 70),
                                                            ("internet", 400), ("interneta", 0), ("interpret", 200), ("interpreter", 60), ("intention", 80), ("other", 700), ("oth", 9)]]
    words = spark.createDataFrame([(w, n) for _, w, n in rows], "word binary, n long")
    text = " ".join(w.decode() for _, w, n in rows for _ in range(n // 10) if w)
    _, tree = pst.learn(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    monkeypatch.setattr(tree, "length", np.minimum(tree.length, 3))
    shared = spark.sparkContext.broadcast(tree)

    def deeper():
        return {bytes(r["word"]): r["deeper"] for r in pst.deepen(words, shared).collect()}

    want = deeper()
    monkeypatch.setattr(pst, "KEYS", keys)
    monkeypatch.setattr(pst, "HOT_WORDS", hot)
    got = deeper()
    assert len(pst._crowded(words)) > 3 and any(want.values()) and got.keys() == want.keys()
    assert all(math.isclose(got[w], want[w], rel_tol=1e-9, abs_tol=1e-12) for w in want)
