"""The exploration of trails against a plain loop over lists."""

import random

from pyspark.sql import functions as F

from inkquest.operators import trails


def plain(targets, pending, hits, suggestions, curated, limit):
    """One trail, worked off step by step."""
    hot, pending, targets, seen, out, cold = [], list(pending), list(targets), set(), [], 0
    while len(out) < limit:
        if hot:
            q, source = hot.pop(0), "hot"
        elif pending:
            q, source = pending.pop(0), "pending"
        elif targets:
            q, source, cold = targets.pop(0), "target", 0
        else:
            break
        if q.lower() in seen:
            continue
        seen.add(q.lower())
        n = len([d for d in hits.get(q, []) if d in curated])
        out.append((len(out) + 1, q, n, "hot" if n >= 3 else "warm" if n else "cold", source))
        if n:
            cold = 0
            for s, relevant, noise in suggestions.get(q, []):
                if s.lower() in seen or (n < 3 and s in pending):
                    continue
                queue = hot if n >= 3 else pending
                if relevant:
                    queue.insert(0, s)
                elif not noise and s not in pending:
                    queue.append(s)
        else:
            cold += 1
            if cold >= 3 and not hot:
                pending, cold = [], 0
    return out


def test_trails_follow_the_plain_loop(spark):
    rng = random.Random(12)
    words = [f"q{k}" for k in range(40)] + ["Q3", "Q7", "Q11"]
    curated = set(range(60))
    hits = {w: [rng.randrange(200) if rng.random() < 0.8 else rng.randrange(60) for _ in range(rng.choice([0, 2, 5, 8]))] for w in words}
    hits = {w: sorted(set(d)) for w, d in hits.items()}
    said = {w: [(s, rng.random() < 0.4, rng.random() < 0.3) for s in rng.sample(words, rng.randint(0, 4))] for w in words}
    trail_targets = {t: rng.sample(words, rng.randint(0, 6)) for t in range(5)}
    trail_pending = {t: rng.sample(words, rng.randint(0, 4)) for t in range(5)}
    rows = lambda d: spark.createDataFrame([(t, k, q) for t, qs in d.items() for k, q in enumerate(qs)], "trail long, ord int, query string")
    hit_rows = spark.createDataFrame([(w, d) for w, ds in hits.items() for d in ds], "query string, doc_id long")
    said_rows = spark.createDataFrame([(w, k, *s) for w, ss in said.items() for k, s in enumerate(ss)], "query string, ord int, suggestion string, relevant boolean, noise boolean")
    asked = {}

    def search(queries):
        asked["q"] = queries
        return queries.join(hit_rows, "query").select("query_id", "doc_id")

    def suggest(found):
        return asked["q"].join(said_rows, "query").select("query_id", "ord", "suggestion", "relevant", "noise")

    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        got = trails.explore_trails(rows(trail_targets), search, suggest, spark.createDataFrame([(d,) for d in curated], "doc_id long"), rows(trail_pending), max_queries=7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    for t in range(5):
        mine = sorted((r["step"], r["query"], r["curated_hits"], r["heat"], r["source"]) for r in got if r["trail"] == t)
        assert mine == plain(trail_targets[t], trail_pending[t], hits, said, curated, 7), t
    assert trails.explore_trails(rows({}), search, suggest, spark.createDataFrame([], "doc_id long")).count() == 0
