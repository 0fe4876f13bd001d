"""Prefix tries, the byte-level transducer and tokenizer alignment against plain versions."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkquest.llm import alignment, prefix_trie, queries, transducer

RANKS, A, B = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["", None, " ", "   \n\t", "a", "  two  blanks \n\n x", "é" * 60, "  ½ Ⅷ 😀" * 20, "\x1c\x1d a b 　\x85 c", "你好ต้นไม้" * 40, "<|endoftext|></s><0x41>",
       "▁x ▁", "don't I'LL 'S", "x" * 3000, "aaaa" * 500 + " " * 700, "\x00\x01", "áà", "plain words and numbers 12345 67,8.9"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def some_texts(n=60):
    rng = random.Random(3)
    parts = ["an", "the", "ré", "on", "str", "ü", "ing", "o", "b.", " ", " ", "\n", "7", "好", "😀", "'s"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def frame(spark, texts):
    rows = [(k, t, "x", "y", 0) for k, t in enumerate(texts)] + [(None, "null id", "", "", 0), (0, texts[0], "again", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, ids string, rid long").repartition(3), rows


# ------------------------------------------------------------ 12 transducer


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_library(spark, tik):
    df, rows = frame(spark, ODD + some_texts())
    got = sorted(map(tuple, transducer.round_trip_digest(df, RANKS).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tik.decode_bytes(ids))))
    assert got == sorted(want, key=str)
    encoded = transducer.encode(df, RANKS)
    assert sorted((str(r["doc_id"]), r["text"]) for r in transducer.decode(encoded, RANKS).collect()) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert transducer.encode(df.limit(0), RANKS).count() == 0 and transducer.round_trip_digest(df.limit(0), RANKS).count() == 0


def test_small_vocabularies_against_merging():
    """Random merges of a tiny alphabet, with tokens that merging never makes and merges out of order."""
    rng = random.Random(9)
    for _ in range(40):
        words = [b"a", b"b", b"c"]
        for _ in range(rng.randint(1, 14)):
            w = rng.choice(words) + rng.choice(words) if rng.random() < 0.85 else bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5)))
            if w not in words:
                words.append(w)
        fst = transducer.Transducer({w: k for k, w in enumerate(words)})
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 200 if rng.random() < 0.1 else 14)))
            want = [fst.ranks[p] for p in fst.merged(data)]
            cut = rng.randint(0, len(data))
            assert [t for some in fst.read([data[:cut], data[cut:]]) for t in some] == want


def test_tokens_are_emitted_while_a_long_word_is_read(tik):
    fst = transducer.encoder(RANKS).fst
    word = "".join(random.Random(1).choice("abcdefghij") for _ in range(1_000_000)).encode()
    begin, first = time.time(), None
    out = []
    for k, some in enumerate(fst.read(word[i:i + 1000] for i in range(0, len(word), 1000))):
        first = first or (k, len(some))
        out += some
    assert time.time() - begin < 60 and first[1] < 200
    assert b"".join(fst.bytes_of[i] for i in out) == word
    assert out[:1000] == tik._encode_single_piece(word)[:1000]


def test_utf8_machine_is_pythons_decoder():
    rng, m = random.Random(2), transducer.Utf8Machine()
    kinds = [0x41, 0x7F, 0x80, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(5000):
        data, state, held, out = bytes(rng.choice(kinds) for _ in range(rng.randint(0, 9))), m.start, b"", ""
        for b in data:
            text, state, held = m.feed(state, held, bytes((b,)))
            out += text
        assert out + ("�" if held else "") == data.decode("utf-8", "replace")


# ------------------------------------------------------------ 13 alignment


def plain_alignment(t):
    """(a ids, b ids, groups, links) by comparing byte ranges."""
    v = alignment.vocabularies(A, B)
    if not t:
        return [], [], [], []
    a, b, want = v.a.encode(" " + t, add_special_tokens=False).ids, v.b.encode(t), (" " + t).encode()
    if b"".join(v.a_bytes[i] for i in a) != want or b"".join(v.b_bytes[i] for i in b) != want:
        return [], [], [], []

    def spans(ids, names):
        ends = np.cumsum([len(names[i]) for i in ids])
        return list(zip([0, *ends[:-1].tolist()], ends.tolist()))

    sa, sb = spans(a, v.a_bytes), spans(b, v.b_bytes)
    links, j = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[j][1] <= s:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < e:
            links.append((i, k))
            k += 1
    groups, low = [], 0
    for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
        groups.append(([a[i] for i, (s, _) in enumerate(sa) if low <= s < cut], [b[i] for i, (s, _) in enumerate(sb) if low <= s < cut]))
        low = cut
    return a, b, groups, links


@pytest.mark.parametrize("head_share", [2e-6, 3e-3, 2.0])
def test_alignment_against_byte_ranges(spark, monkeypatch, head_share):
    monkeypatch.setattr(alignment, "HEAD_SHARE", head_share)
    df, rows = frame(spark, ODD + some_texts())
    plain = [plain_alignment(t) for _, t, *_ in rows]
    count = Counter((a[i], b[k]) for a, b, _, links in plain for i, k in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for (i, *_), (a, b, groups, links) in zip(rows, plain):
        pairs = [(a[x], b[y]) for x, y in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), sha(text) if a else ""))
    assert sorted(map(tuple, alignment.report(df, A, B).collect()), key=str) == sorted(want, key=str)
    assert alignment.report(df.limit(0), A, B).count() == 0


def test_alignment_gives_links_and_cuts(spark):
    df, rows = frame(spark, ODD + some_texts(20))
    got = Counter(str((r["doc_id"], r["a_ids"], r["b_ids"], [tuple(x) for x in r["links"]], [tuple(x) for x in r["cuts"]])) for r in alignment.align(df, A, B).collect())
    want = Counter()
    for i, t, *_ in rows:
        a, b, groups, links = plain_alignment(t)
        na, nb, cuts = 0, 0, []
        for x, y in groups:
            na, nb = na + len(x), nb + len(y)
            cuts.append((na, nb))
        want[str((i, a, b, links, cuts))] += 1
    assert got == want


def test_long_texts_are_encoded_in_parts(monkeypatch):
    v = alignment.vocabularies(A, B)
    rng = random.Random(4)
    texts = [" ".join(some_texts(60)), "x" * 4000, "word " * 3000, "  ".join(rng.choice(["a", "bé", "7", "."]) for _ in range(2000))]
    whole = [tuple(map(list, ids)) for ids in v.tokens(texts)]
    monkeypatch.setattr(alignment, "PART_CHARS", 40)
    assert [tuple(map(list, ids)) for ids in v.tokens(texts)] == whole and len(v.split(texts[2])) > 300


@pytest.mark.parametrize("kept", [0, 100, 300_000])
def test_words_are_encoded_once(monkeypatch, kept):
    v = alignment.vocabularies(A, B)
    texts = [*ODD, *some_texts(), "the ½ cup ﬁt ﬁt the end", "of  two", "a\u0301 b\u0301c ² x", "the word " * 300]
    want, asked = v.tokens(texts), Counter()
    monkeypatch.setattr(alignment, "KEPT_WORDS", kept)
    words = alignment.Words(v)
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda new: asked.update(new) or learn(new))
    for _ in range(3):
        a, b, a_count, b_count = words.encode(texts)
        for flat, n, k in ((a, a_count, 0), (b, b_count, 1)):
            assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [list(x[k]) for x in want]
    assert asked["word"] == (3 if kept == 0 else 1) and (max(asked.values()) == 1) == (kept > 1000)
    assert [len(x) for x in words.encode([])] == [0, 0, 0, 0] and [len(x) for x in words.encode(["", None])] == [0, 0, 2, 2]


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_lanes_do_not_change_links(lane):
    rng = np.random.default_rng(lane)
    a_end, b_end, na, nb = [], [], [], []
    for size in [0, 1, 5, 300, 0, 40]:
        for ends, n in ((a_end, na), (b_end, nb)):
            cut = np.unique(np.r_[rng.integers(1, size + 1, rng.integers(1, size + 1)), size]) if size else np.empty(0, int)
            ends.append(cut)
            n.append(len(cut))
    args = np.concatenate(a_end).astype(np.int64), np.concatenate(b_end).astype(np.int64), np.array(na), np.array(nb)
    for x, y in zip(alignment.lockstep(*args, lane=lane), alignment.lockstep(*args, lane=10 ** 6)):
        assert np.array_equal(x, y)


# ------------------------------------------------------------ 11 prefix trie


def plain_trie(convs):
    """Nodes by grouping all prefixes; ``convs`` maps ids to lists of (role, text)."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)

    def subtree(p):
        leaves, saved = int(not kids[p]), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for k in kids[p]:
            a, b = subtree(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *subtree(p), sha(",".join(map(str, sorted(ends[p])))))
                   for p, m in members.items()), key=str)


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = told.get(c - c % 5, [])[:h] + turns[h:]
    return told, out


def conversation_rows():
    rng = random.Random(8)
    rows = [(c, k, rng.choice(["user", "assistant"]), rng.choice(["hi", "é", "", "a longer turn", f"own {c}"])) for c in range(150) if c % 7 for k in range(rng.randint(1, 9))]
    rows += [(c, k, "user", "same") for c in range(1000, 1120) for k in range(3)]  # many copies
    rows += [(c, k, "user", f"deep {k}") for c in (2000, 2001) for k in range(120)]
    rows += [(3000, None, "user", "late"), (3000, 0, None, None), (3001, 5, "user", None), (None, 0, "user", "nobody"), (3004, 1, "a:b", "c"), (3003, 1, "a", "b:c")]
    return rows


@pytest.mark.parametrize("partitions,shard_rows", [(8, 200_000), (40, 200_000), (3, 1)])
def test_trie_against_all_prefixes(spark, monkeypatch, partitions, shard_rows):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, size long, name string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seqs = prefix_trie.sequences(df)
        told, rebuilt = plain_rebuilt(rows)
        assert sorted(map(tuple, prefix_trie.nodes(seqs).collect()), key=str) == plain_trie(told)
        assert sorted(map(tuple, prefix_trie.nodes(queries.rebuilt(seqs)).collect()), key=str) == plain_trie(rebuilt)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_tries_without_turns_or_conversations(spark):
    seqs = prefix_trie.sequences(spark.createDataFrame([(1, 0, "u", "x")], "conv_id long, turn long, role string, text string"))
    bare = seqs.withColumn("turns", F.lit(None).cast(seqs.schema["turns"].dataType))
    assert [tuple(r) for r in prefix_trie.nodes(bare).collect()] == [(1, 0, None, 1, 0, 1, 0, sha("1"))]
    assert prefix_trie.nodes(seqs.limit(0)).count() == 0


def test_medians_balance_the_tree():
    order = list(prefix_trie.medians(1000))
    assert sorted(order) == list(range(1000))
    tree = prefix_trie.TernaryTree()
    for m in order:
        tree.insert([m])
    deep = {1: 0}
    for v in range(1, len(tree.symbol)):
        for to in (tree.low[v], tree.high[v]):
            if to:
                deep[to] = deep[v] + 1
    assert max(deep.values()) <= 10


# ------------------------------------------------------------ near duplicates of a stage


def test_near_copies_of_any_group_size_leave_one_document(spark, monkeypatch):
    """Copies with a few changed words go, others stay; a large group is thinned before wide links are searched."""
    from reference import fingerprint, jaccard, shingles

    from inkquest.llm import simhash

    monkeypatch.setattr(simhash, "GROUP_SHOWN", 3)
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(150, 400))] for _ in range(40)]
    rows = [" ".join(b) for b in base]

    def copy(b, changes):
        c = list(b)
        for at in rng.sample(range(len(c)), changes):
            c[at] = rng.choice(vocab)
        return " ".join(c)

    near = [copy(b, max(1, len(b) // 120)) for b in base[:20] for _ in range(2)] + [copy(base[0], 1) for _ in range(60)]
    far = [copy(b, len(b) // 4) for b in base[20:]]
    rows += near + far
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(rows)], "doc_id long, text string, fp long").repartition(4)
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    sets = [shingles(t, 5) for t in rows]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8]
    lost = set(range(len(rows))) - kept
    assert set(range(40)) | {len(rows) - 1 - k for k in range(20)} <= kept
    should = {b for _, b in pairs}
    assert len(should & lost) >= 0.9 * len(should) and lost <= should
    fp = [fingerprint(t, 5) for t in rows]
    assert all(any((fp[a] ^ fp[b]).bit_count() <= 8 for a, c in pairs if c == b) for b in lost)


def test_blocks_grow_with_the_input():
    from inkquest.llm import simhash

    assert [simhash.blocks_for(n, 8) for n in (1, 100_000, 1_000_000, 50_000_000)] == [2, 2, 3, 4]
    assert len(simhash._masks(8, 3)) == 165 and all(m.bit_count() >= 15 for m in simhash._masks(8, 3))


def test_labels_of_absent_documents_take_no_place_in_the_sample(spark, monkeypatch):
    from inkquest.llm import quality

    monkeypatch.setattr(quality, "SAMPLE_ROWS", 100)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(0, 20_000, 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 200 == 0)) for k in range(20_000)], "doc_id long, quality int")
    got = quality.sample(docs, quality.labelled(labels)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 100, 1: 100}


def test_links_between_groups_leave_no_fingerprint_out(spark):
    """Of large groups every fingerprint is searched for wide links, also where the top of a trie is opened."""
    from inkquest.llm import simhash

    rng = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = {}
    for g in range(6):
        head = rng.getrandbits(64)
        rows |= {flip(head, 2): g for _ in range(120)}
        rows |= {flip(x, rng.randint(3, 8)): 100 * g + k + 10 for k, x in enumerate(rng.sample([x for x, c in rows.items() if c == g], 15))}
    want = {tuple(sorted((signed(a), signed(b)))) for a in rows for b in rows if a < b and rows[a] != rows[b] and (a ^ b).bit_count() <= 8}
    df = spark.createDataFrame([(signed(x), g) for x, g in rows.items()], "fp long, component long")
    assert len(want) > 90
    for trie_rows in (50_000, 40):
        got = [tuple(sorted(r)) for r in simhash.links(df, 8, trie_rows).collect()]
        assert set(got) == want and len(got) == len(want)
    assert simhash.links(df.select("fp"), 8).count() > 20_000


def test_pairs_of_near_copies_grow_with_their_number_only(spark, monkeypatch):
    """Texts are compared with few of a large group, and none of those left out by their sketches is similar."""
    import numpy as np

    from inkquest.llm import simhash

    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    base, rows = [rng.choice(vocab) for _ in range(200)], []
    for _ in range(400):
        c = list(base)
        for at in rng.sample(range(len(c)), rng.randint(1, 6)):
            c[at] = rng.choice(vocab)
        rows.append(" ".join(c))
    counts, compare = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *more: counts.append(pairs.count()) or compare(pairs, *more))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    kept = simhash.keep_one(df).count()
    assert sum(counts) < 10 * len(rows)
    hashes = [simhash.shingle_hashes(t, 5).view(np.uint64) for t in rows]
    sketches = np.array([simhash.sketch(h) for h in hashes])
    x, y = np.triu_indices(len(rows), 1)
    may, _ = simhash.may_reach(0.8, sketches, x, y)
    similar = np.array([len(np.intersect1d(hashes[a], hashes[b], True)) * 1.8 >= 0.8 * (len(hashes[a]) + len(hashes[b])) for a, b in zip(x.tolist(), y.tolist())])
    assert similar.any() and not may.all() and not (similar & ~may).any()
    fps = np.array([simhash.fingerprint(t, 5) for t in rows])
    linked = similar & (np.bitwise_count((fps[x] ^ fps[y]).view(np.uint64)) <= 8)
    group = list(range(len(rows)))
    for a, b in zip(x[linked].tolist(), y[linked].tolist()):
        if group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    assert kept == len(set(group)) and linked.sum() > 10 * len(rows)
