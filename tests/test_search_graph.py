"""Search, graph, case and stream operators against hand values or brute force."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from inkquest.operators import activity as A, claims as C, graph as G, reports as R, rules, search as E
from inkquest.sources import readers as S
from inkquest.streaming import jobs as J
from inkquest.session import shared_dir


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "red dog"), (3, "blue cat sat"), (4, "fox den")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red fox red")], "query_id long, query string")
    got = {r.doc_id: r.score for r in E.tfidf_search(docs, q, 10).collect()}
    idf = math.log(1 + 4 / 3)
    assert got[1] == pytest.approx(2 * (1 + math.log(2)) * idf + idf, abs=1e-6)
    assert got[2] == pytest.approx(2 * idf, abs=1e-6) and got[4] == pytest.approx(idf, abs=1e-6) and 3 not in got


def test_missing_and_zero_scores(spark):
    s = spark.createDataFrame([("document", 1, 0, 0, 0)], "target_type string, target_id long, pertinence int, suspicion int, confidence int")
    d = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.doc_id: (r.pertinence, r.suspicion, r.confidence) for r in E.with_scores(d, s, "document", "doc_id").collect()}
    assert got == {1: (0, 0, 0), 2: (50, 0, 50)}


def test_substring_routes_agree(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(80))) for i in range(60)]
    terms = [("".join(rng.choice("abc") for _ in range(rng.randint(2, 6))),) for _ in range(80)]
    d, t = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(sorted(set(terms)), "term string")
    want = {(i, w) for i, x in texts for (w,) in set(terms) if w in x}
    for small in (0, 1000):
        assert {(r.doc_id, r.term) for r in E.substring_join(d, t, small=small).collect()} == want


def test_fuzzy_names_brute_force(spark):
    rng = random.Random(6)
    names = [(i, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(2))) for i in range(80)]
    n = spark.createDataFrame(names, "name_id long, name string")
    q = n.select(F.col("name_id").alias("query_id"), F.expr("left(name, length(name) - 1)").alias("query"))

    def tri(s):
        return {f"  {w} "[i:i + 3] for w in s.split() for i in range(len(w) + 1)}

    want = set()
    for i, a in names:
        for j, b in names:
            x, y = tri(a[:-1]), tri(b)
            if a[:-1] in b or len(x & y) / len(x | y) > 0.3:
                want.add((i, j))
    assert {(r.query_id, r.name_id) for r in E.fuzzy_names(n, q).collect()} == want


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("method", ["levenshtein", "ratio"])
def test_similar_names_brute_force(spark, method):
    from difflib import SequenceMatcher

    rng = random.Random(8)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 24))) for _ in range(40)]
    names = set(base)
    for b in base:
        for _ in range(3):
            s = list(b)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(s) + 1)
                rng.choice([lambda: s.insert(k, "x"), lambda: s and s.pop(min(k, len(s) - 1)), lambda: s.__setitem__(min(k, len(s) - 1), "y") if s else None])()
            if s:
                names.add("".join(s))
    rows = [(i, "t", n) for i, n in enumerate(sorted(names))]
    got = {(r.id_a, r.id_b) for r in G.similar_names(spark.createDataFrame(rows, "id long, type string, name string"), method=method).collect()}
    want = set()
    for (i, _, a), (j, _, b) in combinations(rows, 2):
        sim = 1 - _lev(a, b) / max(len(a), len(b)) if method == "levenshtein" else SequenceMatcher(None, a, b).ratio()
        if sim >= 0.85 - 1e-12:
            want.add((i, j))
    assert got == want


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "e") for a, b in pairs], "src long, dst long, type string")


def test_graph_mini(spark):
    e = _edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 1)])
    n = spark.createDataFrame([(i, "t", f"n{i}") for i in range(1, 8)], "id long, type string, name string")
    start = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.distance for r in G.hop_distances(e, start, 5).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert {r.id: r.path for r in G.shortest_paths(e, start, n, 5).collect()}[5] == [1, 3, 4, 5]
    assert {r.id: r.degree for r in G.degrees(e, n).collect()} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 1, 6: 0, 7: 0}
    goals = spark.createDataFrame([(4,)], "id long")
    assert {r.path for r in G.bounded_paths(e, n.select("id"), goals, 2).collect()} == {"3 -> 4", "2 -> 3 -> 4"}


def test_propagation_caps(spark):
    s = spark.createDataFrame([(1, 40, 50), (2, 30, 50), (3, 10, 95), (4, 0, 50)], "id long, suspicion int, pertinence int")
    got = {r.id: (r.suspicion, r.pertinence) for r in G.propagate_scores(s, _edges(spark, [(1, 3), (3, 2), (3, 1), (3, 4)])).collect()}
    assert got == {1: (40, 50), 2: (30, 50), 3: (40, 100), 4: (0, 50)}


def test_components_of_long_chain_and_merge(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "id_a long, id_b long")
    got = {r.component: r.n for r in G.components(pairs).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 61, 100: 2}
    nodes = spark.createDataFrame([(1, "abcd"), (2, "abc"), (3, "abcde")], "id long, name string")
    chain = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    merged = G.merge_nodes(nodes, chain)
    assert {(r.id, r.canonical_id) for r in merged.collect()} == {(1, 2), (3, 2)}
    re = G.rewire(_edges(spark, [(1, 9), (3, 9), (1, 2)]), merged)
    assert {(r.src, r.dst) for r in re.collect()} == {(2, 9)}


def test_rubric_points(spark):
    sub = spark.createDataFrame([(1, "convicted"), (2, "not_charged"), (3, "charged")], "subject_id long, status_code string")
    ev = spark.createDataFrame([(1, 90), (1, 85), (1, 10), (3, 90)], "subject_id long, confidence int")
    wi = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a")], "subject_id long, witness string")
    da = spark.createDataFrame([(1,), (1,)], "subject_id long")
    got = {r.subject_id: (r.score, r.tier) for r in R.case_rubric(sub, ev, wi, da).collect()}
    assert got == {1: (100, "ready"), 2: (0, "insufficient"), 3: (25, "insufficient")}


def test_fold_hits_both_clamps(spark):
    rng = random.Random(9)
    kinds = ["supported", "refuted", "evidence"]
    rows = [(h, i, rng.choice(kinds), rng.choice(["found", "nothing"])) for h in range(5) for i in range(700)]
    start = {h: h / 4 for h in range(5)}
    for h, _, k, x in rows:
        v = start[h]
        start[h] = min(1, v + .2) if k == "supported" else max(0, v - .3) if k == "refuted" else max(0, min(1, v + (.1 if x == "found" else -.05)))
    hyp = spark.createDataFrame([(h, h / 4) for h in range(5)], "id long, confidence double")
    got = {r.id: r.confidence for r in R.fold_evidence(hyp, spark.createDataFrame(rows, "id long, seq long, kind string, text string")).collect()}
    assert got == {h: pytest.approx(v, abs=1e-6) for h, v in start.items()}


def test_percentiles(spark):
    rng = random.Random(10)
    vals = [(1, float(rng.randint(0, 50))) for _ in range(997)] + [(2, 3.0)]
    r = {x.grp: x for x in R.latency_profile(spark.createDataFrame(vals, "g long, v double"), "g", "v", 8).collect()}
    s = sorted(v for g, v in vals if g == 1)
    assert (r[1].p50, r[1].p95, r[1].p99) == (s[498], s[int(997 * .95)], s[int(997 * .99)]) and r[2].p99 == 3.0


def test_claims(spark):
    rows = [(1, "f1", 2000, "alpha beta gamma delta one"), (2, "f1", 2010, "alpha beta gamma delta two"), (3, "f1", 2010, "alpha beta gamma zzz"),
            (4, "f2", 2000, "the of alpha beta gamma"), (5, "f1", 2000, "alpha beta gamma delta one")]
    c = spark.createDataFrame(rows, "claim_id long, field string, year int, claim string")
    assert {(r.rep_a, r.rep_b, r.shared, r.copies_a) for r in C.era_contradictions(c).collect()} == {(1, 2, 4, 2)}
    assert {(r.rep_a, r.rep_b) for r in C.cross_field_patterns(c).collect()} == {(1, 4), (2, 4), (3, 4)}


def test_manifest_and_years(spark):
    raw = ["2002", "6-Jan  B-727-31  N908AB  AAA  BBB  44 XX, JOHN ROE, 2 FEMALES, CARGO, 77", "noise", "Apr-15 G-IV N123CD BBB AAA 45 MALE"]
    lines = spark.createDataFrame([("f", i, r) for i, r in enumerate(raw)], "file string, line_no long, raw string")
    codes = spark.createDataFrame([("AAA", "Alpha"), ("BBB", "Beta")], "code string, place string")
    short = spark.createDataFrame([("XX", "Xavier Xu")], "short string, name string")
    got = {r.line_no: r for r in S.parse_manifest(lines, codes, short).collect()}
    assert got[1].parties == ["Xavier Xu", "JOHN ROE", "UNIDENTIFIED FEMALE", "UNIDENTIFIED FEMALE"]
    assert (got[1].from_place, got[1].to_place, got[1].registration, got[1].vehicle) == ("Alpha", "Beta", "N908AB", "B-727")
    assert got[3].parties == ["UNIDENTIFIED MALE"] and set(got) == {1, 3}
    assert {r.line_no: r.year for r in S.manifest_years(lines).collect()} == {1: 2002, 2: 2002, 3: 2002}


def test_csv_shapes(spark):
    df = spark.createDataFrame([("t", None, "a long enough cell", "x")], "title string, body string, other string, tiny string")
    r = S.shape_csv(df).first()
    assert r.content == "a long enough cell" and r.title == "t" and r.metadata == {"other": "a long enough cell", "tiny": "x"} and r.id is not None
    with pytest.raises(ValueError):
        S.read_any(spark, "/x", "pdf")


def test_model_responses(spark):
    good = 'Sure:\n```json\n{"extractions":[{"doc_id":1,"nodes":[{"type":"person","name":"Ann Roe"}]},{"doc_id":99,"nodes":[]}]}\n``` bye'
    rows = [(1, [1, 2], good), (2, [3], '[{"doc_id":3,"nodes":[{"type":"org","name":"Acme"}]}]'), (3, [4], "{broken"), (4, [5], "no json at all")]
    p = S.parse_responses(spark.createDataFrame(rows, "batch_id long, doc_ids array<long>, response_text string"))
    assert {(r.batch_id, r.doc_id) for r in p.where("error is null").collect()} == {(1, 1), (2, 3)}
    assert {r.batch_id for r in p.where("error is not null").collect()} == {3, 4}
    assert {r["name"] for r in S.response_part(p, "nodes").collect()} == {"Ann Roe", "Acme"}


EVENTS = "/root/testdata/sf0.001/events*.parquet"


def _stream(spark):
    schema = spark.read.parquet(EVENTS).schema
    return J.event_stream(spark, EVENTS, schema)


def _history(spark):
    rows = spark.read.parquet(EVENTS).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.t, r.event_id)):
        by.setdefault(r.user_id, []).append((r.t, r.event_id))
    return by


def test_sliding_limit_stream(spark):
    want = {}
    for es in _history(spark).values():
        kept = []
        for t, i in es:
            kept = [k for k in kept if t - k < 7200]
            want[i] = len(kept) < 2
            if want[i]:
                kept.append(t)
    got = {r.event_id: r.accepted for r in J.drain(J.decide(_stream(spark), "user_id", J.SlidingLimit(2, 7200)), "t").collect()}
    assert got == want and not all(want.values())


def test_token_bucket_stream(spark):
    want = {}
    for es in _history(spark).values():
        tokens, at = 2, None
        for t, i in es:
            tokens = min(2, tokens + (t - at) / 36000) if at is not None else tokens
            at, want[i] = t, tokens >= 1
            tokens -= want[i]
    got = {r.event_id: r.accepted for r in J.drain(J.decide(_stream(spark), "user_id", J.TokenBucket(1 / 36000, 2)), "t").collect()}
    assert got == want and not all(want.values())


def test_ttl_stream(spark):
    want = {}
    for es in _history(spark).values():
        at = None
        for t, i in es:
            want[i] = at is None or t - at >= 36000
            at = t if want[i] else at
    got = {r.event_id: r.accepted for r in J.drain(J.decide(_stream(spark), "user_id", J.TtlCache(36000)), "t").collect()}
    assert got == want and not all(want.values())


def test_inbox_is_idempotent_across_runs(spark):
    inbox, target, ck = (shared_dir(spark, p) for p in ("in", "out", "ck"))
    text = "a sentence that is long enough to pass the gate of fifty characters"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{inbox}/a")
    first = J.ingest_inbox(spark, inbox, target, ck)
    assert [r.status for r in first.collect()] == ["inserted"]
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{inbox}/b")
    again = J.ingest_inbox(spark, inbox, target, ck)
    assert sorted(r.status for r in again.collect()) == ["duplicate", "inserted"]
    assert spark.read.parquet(f"{target}/documents").count() == 1


def test_suggestions(spark):
    rows = [(1, "about alpha", 0, "alpha"), (1, "about alpha", 1, "Beta Gamma Club"), (1, "about alpha", 2, "topic words"), (1, "about alpha", 3, "12-34 5"), (1, "about alpha", 4, "x")]
    df = spark.createDataFrame(rows, "query_id long, query string, pos int, suggestion string")
    assert [r.suggestion for r in rules.filter_suggestions(df, ["topic"], ["spam"]).orderBy("rank").collect()] == ["topic words"]
    assert [r.suggestion for r in rules.filter_suggestions(df, ["topic"], ["spam"], strict=False).orderBy("rank").collect()] == ["topic words", "Beta Gamma Club"]


def test_matched_ratio_of_names_in_order_is_computed_once(spark, monkeypatch):
    """Without copies of a name only the smaller id's name is compared with the other, not both ways."""
    from difflib import SequenceMatcher

    asked, ratio = [], G.matched_ratio
    monkeypatch.setattr(G, "matched_ratio", lambda a, b, least=0.0: asked.append((a, b)) or ratio(a, b, least))
    rows = [(9, "t", "abcabdabcabd"), (2, "t", "abcabcabdabd"), (5, "t", "abcabdabcab"), (7, "t", "abdabcabdabc")]
    got = {(r.id_a, r.id_b): r.similarity for r in G.similar_names(spark.createDataFrame(rows, "id long, type string, name string"), ratio=0.7, method="ratio").collect()}
    want = {(i, j): round(s, 6) for i, _, a in rows for j, _, b in rows if i < j and (s := SequenceMatcher(None, a, b).ratio()) >= 0.7}
    assert got == want and asked
    assert all(str(a) != str(d) or str(b) != str(c) for a, b in asked for c, d in asked)


@pytest.mark.parametrize("method", ["levenshtein", "ratio"])
def test_names_of_one_pattern_meet_by_what_differs(spark, method):
    """Numbered names share their beginning; only those that may be similar are compared, copies once."""
    from difflib import SequenceMatcher

    kind = "Supplier#%09d"
    rows = [(i, "t", kind % (i * 37 % 900)) for i in range(1000)] + [(2000, "u", kind % 1), (2001, "t", "x" * 70), (2002, "t", "x" * 69 + "y"), (2003, "t", "é" * 9), (2004, "t", "é" * 8)]
    df = spark.createDataFrame(rows, "id long, type string, name string")
    got = {(r.id_a, r.id_b): r.similarity for r in G.similar_names(df, method=method).collect()}
    low = {i: n.lower() for i, _, n in rows}
    sim = {}
    for a in set(low.values()):
        for b in set(low.values()):
            sim[a, b] = 1 - _lev(a, b) / max(len(a), len(b)) if method == "levenshtein" and a <= b else SequenceMatcher(None, a, b).ratio() if method == "ratio" else 0
    want = {(i, j): round(s, 6) for (i, t, _), (j, u, _) in combinations(rows, 2) if t == u
            and (s := sim[low[i], low[j]] if method == "ratio" else sim[min(low[i], low[j]), max(low[i], low[j])]) >= 0.85 - 1e-12}
    assert got == want
    alone = df.dropDuplicates(["type", "name"])
    pairs = G.similar_names(alone, method=method)
    rows = [(r.id_a, r.id_b) for r in pairs.collect()]
    first = {r.id for r in alone.collect()}
    assert len(rows) == len(set(rows)) and set(rows) == {(i, j) for i, j in want if i in first and j in first}
    plan = pairs._jdf.queryExecution().toString()
    assert "SortMergeJoin [key#" in plan and "BroadcastHashJoin [key#" not in plan  # names are few, their variants are not
    one, lengths = G._distinct_names(df)
    plan = G._variant_plan(lengths, 0.85, method)
    few = {k: v for k, v in plan.items() if G._few_variants(v, *k)}
    assert (18, 18) in few and (70, 70) not in few
    if method == "levenshtein":
        ends = {r.id: r.component for r in G.components(G.name_links(df)).collect()}
        assert ends == {r.id: r.component for r in G.components(spark.createDataFrame(list(want), "id_a long, id_b long")).collect()}
        assert G.name_links(df).count() < len(want)


def test_node_search_hands_on_only_what_may_be_best(spark):
    """Numbered nodes are all similar; the best are those of the search that keeps all pairs."""
    nodes = spark.createDataFrame([(k, f"Supplier#{k:09d}") for k in range(0, 2400, 3)] + [(5000, "lier"), (5001, "#"), (5002, None)], "id long, name string")
    asked = spark.createDataFrame([(k, f"supplier{k:08d}") for k in range(0, 240, 9)] + [(-1, "lie"), (-2, "??")], "query_id long, query string")
    scores = spark.createDataFrame([("node", k, k * 7 % 60, k * 3 % 100, 60) for k in range(0, 2400, 6)], "target_type string, target_id long, suspicion int, pertinence int, confidence int")
    got = {tuple(r) for r in E.node_search(nodes, asked, scores, 5).collect()}
    assert got == {tuple(r) for r in E.node_search(nodes, asked, scores, 5, fetch=100_000).collect()}
    named = nodes.where("name IS NOT NULL")
    ids = E.with_scores(named.select("id"), scores, "node", "id")
    n = E._similar_blocks(named, asked, ids, 5, 0.3, block=300, query_block=10).count()
    assert 0 < n < 27 * 802 / 4


def test_gram_join_reads_long_texts_once(spark):
    """The grams of a text of a million characters are found in one pass, line ends and characters beyond 16 bits included."""
    import time

    words = " ".join(f"w{k * 7919 % 100_003}" for k in range(160_000))
    d = spark.createDataFrame([(1, words), (2, "abc\ndefgh and \U0001f600smile"), (3, ""), (4, None), (5, "no")], "doc_id long, text string")
    t = spark.createDataFrame([("w7919 w15838",), ("c\ndef",), ("\U0001f600smil",), ("absent word",), ("w7919 w15839",)], "term string")
    begun = time.time()
    got = {(r.doc_id, r.term) for r in E.substring_join(d, t, small=0, by_gram=True).collect()}
    assert got == {(1, "w7919 w15838"), (2, "c\ndef"), (2, "\U0001f600smil")}
    assert time.time() - begun < 60
