"""The registered queries and the pipeline over the smallest tables, against plain versions."""

import hashlib

import pytest
from reference import bench_clean, bench_hits, fingerprint, fold_is, groups, jaccard, repeat_digest, shingles, unigram, windows, without_repeats

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from inkquest.llm import quality, queries, stages
from inkquest.session import shared_dir

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]


def run(spark, name):
    return {r[0]: r for r in entry.queries()[name](spark, FOLDER).collect()}


def test_all_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert {f"op{n}" for n in range(1, 11)} <= names and "pipeline" in entry.queries()


def test_suffix_query(spark, docs):
    got = run(spark, "op2_suffix_dedup")
    assert {i: tuple(r)[1:] for i, r in got.items()} == dict(zip([i for i, _ in docs], repeat_digest(docs)))


def test_simhash_query(spark, docs):
    got = run(spark, "op4_simhash")
    fp = [fingerprint(t) for _, t in docs]
    low = groups([i for i, _ in docs], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (f"{f:016x}", c) for (i, _), f, c in zip(docs, fp, low)}


def test_scoring_query(spark, docs):
    got = run(spark, "op6_suffix_tree_lm")
    n, want = unigram(docs, lambda i: fold_is(i, 7, 2))
    for (i, _), (tokens, known, base) in zip(docs, want):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (tokens, known, n)
        assert abs(got[i]["base_score"] - base) < 1e-6 * abs(base)


def test_benchmark_query(spark, docs, items):
    got, found = run(spark, "op9_decontamination"), windows(items)
    for i, t in docs:
        w, hit, named = bench_hits(t, found)
        assert tuple(got[i])[1:] == (len(w), sum(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), any(hit))


def test_token_count_query(spark, docs):
    from inkquest.llm.token_counts import encoding

    got = run(spark, "op8_token_counts")
    n = [len(encoding(queries.tokenizer_file("byte_bpe_50k.tiktoken")).encode_ordinary(t)) for _, t in docs]
    assert {k: (r["n_docs"], r["truncated_total"]) for k, r in got.items()} == {k: (n.count(k), sum(min(k, x) for x in n)) for k in set(n)}


def test_pipeline_stage_by_stage(spark, docs, items):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "benchmark", "encode"]
    df, columns, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), None, []
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, f"test-{name}")
        stage(spark, df, FOLDER).write.parquet(path)
        df = spark.read.parquet(path)
        kept.append(df)
        if name != "encode":
            assert df.columns == columns
    rows = [[(r["doc_id"], r["text"]) for r in k.collect()] for k in kept[:-1]]
    model = quality.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"), usable=~quality.held_out(F.col("doc_id"), 4, 2))
    scores = {i: 1 / (1 + 2.718281828459045 ** -(model.slope * quality.difference(model, t) + model.shift)) for i, t in docs}
    assert sorted(rows[0]) == sorted((i, t) for i, t in docs if scores[i] >= 0.7)
    fp, sets = [fingerprint(t, 5) for _, t in rows[0]], [shingles(t, 5) for _, t in rows[0]]
    low = groups([i for i, _ in rows[0]], lambda a, b: fp[a] == fp[b] or (fp[a] ^ fp[b]).bit_count() <= 8 and jaccard(sets[a], sets[b]) >= 0.8)
    assert sorted(rows[1]) == sorted(r for r, c in zip(rows[0], low) if r[0] == c)
    assert sorted(rows[2]) == sorted(zip([i for i, _ in rows[1]], without_repeats(rows[1])))
    found = windows(items)
    clean = [(i, bench_clean(t, found)) for i, t in rows[2]]
    assert sorted(rows[3]) == sorted(r for r in clean if r[1] is not False)
    t = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["text"], r["ids"], r["n_tokens"]) for r in kept[-1].collect()}
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in rows[3]}
    assert got == {i: (x, ids[i], len(ids[i])) for i, x in rows[3]} and kept[-1].columns[:len(columns)] == columns
    assert {str(r) for r in corpus_pipeline.run(spark, FOLDER).collect()} == {str(r) for r in kept[-1].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].collect())


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({c: F.lit(f"my {c}") for c in ("score", "n_words", "hits", "items", "lost_id", "fp", "_pack", "n_removed", "n_spans")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema.names == docs.schema.names, name
        assert out.select("score", "n_words", "items", "_pack", "n_removed").distinct().collect() == [("my score", "my n_words", "my items", "my _pack", "my n_removed")], name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
