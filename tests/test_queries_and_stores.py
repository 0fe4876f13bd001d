"""Lexicons, query strings, stores, table functions and centrality against plain versions."""

import json
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkquest.functions import patterns as P, table_functions
from inkquest.operators import extract as D, graph as G, lexicon as L, query_strings as Q, search as E, store as S

# ------------------------------------------------------------ lexicons


@pytest.mark.parametrize("part_terms", [L.PART_TERMS, 30_000])
def test_a_lexicon_of_a_hundred_thousand_terms(spark, part_terms):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9))) for _ in range(240_000)} | set("abcdexyz")
    words = {w for w in words if w.strip()}
    assert len(words) > 100_000
    texts = ["".join(rng.choice("ABcdé  x") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", None, "aaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    terms = spark.createDataFrame([(w,) for w in words] + [("a",), (None,), ("",)], "_term string")
    got = {(r["doc_id"], r["_term"]): r["n"] for r in L.term_counts(docs, terms, part_terms=part_terms).collect()}
    want = {}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for a in range(len(low)):
            for b in range(a + 1, min(a + 9, len(low)) + 1):
                if low[a:b] in words:
                    want[i, low[a:b]] = want.get((i, low[a:b]), 0) + 1
    assert got == want
    assert L.term_counts(docs, terms.limit(0)).count() == 0


def test_long_lexicons_do_not_shuffle_texts(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    plan = L.term_counts(docs, spark.createDataFrame([("b",)], "_term string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


# ------------------------------------------------------------ query strings


@pytest.mark.parametrize("text,ops,leaves", [
    ('"a1 b1" AND (cc OR NOT dd)', [0, 1, 2, Q.NOT, Q.OR, Q.AND], [("a1 b1", True), ("cc", True), ("dd", False)]),
    ("aa bb OR cc", [0, 1, Q.AND, 2, Q.OR], [("aa", True), ("bb", True), ("cc", True)]),
    ("NOT (aa OR NOT bb)", [0, 1, Q.NOT, Q.OR, Q.NOT], [("aa", False), ("bb", True)]),
    ("NOT NOT aa", [0], [("aa", True)]), ('AND OR ) "open phrase', [0], [("open phrase", True)]), ("((aa OR", [0], [("aa", True)]),
    ("and or not", [0, 1, 2, Q.AND, Q.AND], [("and", True), ("or", True), ("not", True)]), ("", [], []), (None, [], []), ('"" x', [], []),
])
def test_parser(text, ops, leaves):
    assert Q.parse(text)[:2] == (ops, leaves)


def test_query_strings_against_texts(spark):
    rng = random.Random(6)
    vocab = ["aa", "bb", "cc", "dd", "ee"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def random_query(depth=0):
        roll = rng.random()
        if depth > 3 or roll < 0.4:
            return rng.choice(vocab)
        if roll < 0.6:
            return '"' + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 3))) + '"'
        if roll < 0.75:
            return "NOT " + random_query(depth + 1)
        return "(" + random_query(depth + 1) + rng.choice([" AND ", " OR ", " "]) + random_query(depth + 1) + ")"

    queries = [random_query() for _ in range(40)] + ["", "NOT zz", '"aa aa" OR qq']

    def holds(ops, on):
        stack = []
        for op in ops:
            if op >= 0:
                stack.append(op in on)
            elif op == Q.NOT:
                stack.append(not stack.pop())
            else:
                a, b = stack.pop(), stack.pop()
                stack.append(a and b if op == Q.AND else a or b)
        return bool(stack and stack[0])

    want = set()
    for q, text in enumerate(queries):
        ops, leaves, _ = Q.parse(text)
        for d, t in enumerate(texts):
            if holds(ops, {k for k, (w, _) in enumerate(leaves) if f" {w} " in f" {t} "}):
                want.add((q, d))
    got = Q.query_string_search(E.build_index(docs, positions=True), spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), None)
    rows = got.collect()
    assert {(r["query_id"], r["doc_id"]) for r in rows} == want and len(rows) == len(want)


def test_a_stored_positional_index_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "bb aa"), (3, "cc")], "doc_id long, text string")
    E.build_index(docs, positions=True).save(str(tmp_path / "index"))
    q = spark.createDataFrame([(1, '"aa bb"'), (2, "NOT aa")], "query_id long, query string")
    got = Q.query_string_search(str(tmp_path / "index"), q)
    assert {(r["query_id"], r["doc_id"]) for r in got.collect()} == {(1, 1), (2, 3)}
    plan = E.Index.load(spark, str(tmp_path / "index"), spark.createDataFrame([("aa",)], "term string")).postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan


# ------------------------------------------------------------ stores


def deep(a, b):
    return {**a, **{k: deep(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}


def node_rows():
    rng = random.Random(2)
    shape = lambda d: {rng.choice("abc"): shape(d + 1) if d < 3 and rng.random() < 0.5 else rng.randint(0, 9) for _ in range(rng.randint(0, 3))}
    rows = [(rng.choice(["person", "company"]), rng.choice(["Ann B.", "ann b", "ANN B!", "Carl", "carl  ", "D"]), k * 10, k, json.dumps(shape(0))) for k in range(60)]
    return rows + [("person", None, 1, 100, "{}"), ("person", " !", 1, 101, "{}"), ("person", "Eve", 7, 102, None), ("person", "eve", 8, 103, "not json"), ("person", "Eve", 9, 104, "[1]")]


NODE = "type string, name string, source_id long, seq long, metadata string"


@pytest.mark.parametrize("cuts,deltas", [([0, 65], 4), ([0, 5, 20, 20, 41, 65], 4), ([0, 5, 20, 33, 41, 65], 1)])
def test_the_graph_is_the_same_in_any_batches(spark, tmp_path, cuts, deltas):
    rows = node_rows()
    edges = [(1, 2, "knows", "first", 0), (1, 2, "knows", "second", 1), (2, 2, "self", "", 2), (2, 1, "knows", None, 3), (None, 1, "x", "", 4)]
    graph = S.GraphStore(spark, str(tmp_path / "g"), buckets=3, deltas=deltas)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        nodes, some = spark.createDataFrame(rows[a:b], NODE), spark.createDataFrame(edges if k == 0 else [], "src long, dst long, type string, excerpt string, seq long")
        graph.apply(k, nodes, some)
        graph.apply(k, nodes, some)  # replayed
    want = {}
    for kind, name, source, _, metadata in rows:
        norm = re.sub(r"[^a-z0-9\s]", "", (name or "").lower()).strip()
        if not norm:
            continue
        try:
            given = json.loads(metadata) if metadata else {}
        except ValueError:
            given = {}
        given = given if isinstance(given, dict) else {}
        first = want.setdefault((kind, norm), [name, source, 0, {}])
        first[2] += 1
        first[3] = deep(first[3], given)
    got = {(r["type"], r["name_normalized"]): [r["name"], r["source_id"], r["mentions"], json.loads(r["metadata"])] for r in graph.nodes().collect()}
    assert got == want
    assert {tuple(r) for r in graph.edges().collect()} == {(1, 2, "knows", "first", 2), (2, 1, "knows", None, 1)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    counts = S.KeyedStore(spark, str(tmp_path / "s"), "k long, n long", ("k",), lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), buckets=4, deltas=2)
    assert counts.read().count() == 0
    for b in range(7):
        assert counts.apply(spark.createDataFrame([(1, 1), (1, 1)], "k long, n long"), b)
    assert not counts.apply(spark.createDataFrame([(1, 1)], "k long, n long"), 6)
    assert counts.apply(spark.createDataFrame([], "k long, n long"), 7)
    version, last, folders = counts._manifest()
    assert (version, last) == (8, 7) and len(folders) == 1 and all(len(f) <= 2 for f in folders.values())
    assert [tuple(r) for r in counts.read().collect()] == [(1, 14)]


# ------------------------------------------------------------ SQL table function


def test_table_function_equals_span_extraction(spark):
    texts = ["Mail bob@example.com or 10.0.0.1 on 2024-01-05, password: hunter2", "", None, "Ann Lee of Acme Corp paid $ 20.00", "é mail x@y.org é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table_functions.register(spark)
    want = sorted(tuple(r) for r in D.extract_spans(docs.where("text IS NOT NULL"), P.REGISTRY).collect())
    got = spark.sql("SELECT doc_id, s.* FROM {d}, LATERAL extract_spans(text) AS s", d=docs)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 5
    few = spark.sql("SELECT doc_id, s.* FROM {d}, LATERAL extract_spans(text, 'email, ip_address', 0) AS s", d=docs)
    assert "context" not in few.columns and {r["pattern"] for r in few.collect()} == {"email", "ip_address"}
    for bad in ("extract_spans(1)", "extract_spans(text, 'nothing')", "extract_spans(text, text)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT s.* FROM {{d}}, LATERAL {bad} AS s", d=docs).collect()


# ------------------------------------------------------------ centrality


def test_larger_graphs_have_larger_blocks_of_thinner_slices(spark, monkeypatch):
    """The sketches are the same however they are cut, and a sketch goes to fewer blocks."""
    from inkquest.operators import graph as G

    assert [G._blocks_and_slices(n) for n in (0, 1_000_000, 2_000_000, 5_760_000)] == [(1, 4), (20, 4), (20, 8), (29, 16)]
    e = spark.createDataFrame([(k, (k * 7 + j) % 90) for k in range(90) for j in (1, 5)], "src long, dst long")
    results = []
    for size, most in ((50_000, 20), (10, 4)):
        monkeypatch.setattr(G, "BLOCK_NODES", size)
        monkeypatch.setattr(G, "MOST_BLOCKS", most)
        results.append({r["id"]: (round(r["centrality"], 6), round(r["reached"], 6)) for r in G.harmonic_centrality(e, 2).collect()})
    assert results[0] == results[1] and len(results[0]) == 90


def test_harmonic_centrality_within_its_error(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(30)] + [(500, k) for k in range(100, 400)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(80)] + [(7, 7), (30, 500)]
    df = spark.createDataFrame(edges, "src long, dst long")
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def exact(start):
        seen, front, d, total = {start}, [start], 0, 0.0
        while front:
            d += 1
            front = sorted({o for n in front for o in near[n]} - seen)
            seen |= set(front)
            total += len(front) / d
        return total

    got = {r["id"]: r["centrality"] for r in G.harmonic_centrality(df).collect()}
    assert set(got) == set(near)
    for n in near:
        assert abs(got[n] - exact(n)) <= 0.1 * exact(n) + 0.5
    assert G.harmonic_centrality(df.limit(0)).count() == 0


def test_centrality_and_communities_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(6)
    pairs = [(1, k) for k in range(2, 40)] + [(rng.randrange(2, 40), rng.randrange(40, 70)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "src long, dst long").repartition(1)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {n: n for n in near}
    for _ in range(2):
        votes = {n: Counter(label[o] for o in near[n]) for n in near}
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    want = sorted(map(tuple, G.harmonic_centrality(df, 2).collect()))
    monkeypatch.setattr(G, "BLOCK_NODES", 9)
    monkeypatch.setattr(G, "TASK_ROWS", 20)
    got = sorted(map(tuple, G.harmonic_centrality(df, 2).collect()))
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1:] for x in got], [x[1:] for x in want])
    assert {r["id"]: r["label"] for r in G.communities(df, 2).collect()} == label


# ------------------------------------------------------------ known texts


def test_an_inbox_in_one_or_many_batches(spark, tmp_path):
    from inkquest.streaming import known

    texts = [f"text number {k % 23} " * 5 for k in range(60)] + ["short"] * 3
    rows = [(f"f{k:02d}", t) for k, t in enumerate(texts)]
    make = lambda part: spark.createDataFrame(part, "doc_id string, text string")
    totals = []
    for name, cuts in (("one", [0, 63]), ("many", [0, 9, 9, 30, 50, 63])):
        inbox = known.Inbox(spark, str(tmp_path / name), groups=4, bits=1 << 10)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            inbox.take(make(rows[a:b]), k)
            inbox.take(make(rows[a:b]), k)  # replayed
        totals.append({r["status"]: (r["n"], r["chars"]) for r in inbox.progress().collect()})
        docs = spark.read.schema("doc_id string, text string").parquet(str(tmp_path / name / "documents")).collect()
        assert len(docs) == len({r["text"] for r in docs}) == 23
        assert spark.read.parquet(str(tmp_path / name / "nodes")).count() == 23
    assert totals[0] == totals[1] and {s: n for s, (n, _) in totals[0].items()} == {"inserted": 23, "duplicate": 37, "too_short": 3}


def test_filters_miss_no_known_hash(spark, tmp_path):
    from inkquest.streaming.known import KnownHashes

    store = KnownHashes(spark, str(tmp_path / "k"), groups=3, bits=256, sets=3)
    make = lambda ids: spark.createDataFrame([(f"h{k}",) for k in ids], "hash string")
    for b in range(2):
        store.add(make(range(b * 20, b * 20 + 20)), b)
    asked = make(range(0, 400))
    assert {r["hash"] for r in store.known(asked).collect()} == {f"h{k}" for k in range(40)}
    maybe = store.maybe(asked).count()
    assert 40 <= maybe < 300
    assert store.known(make([])).count() == 0
