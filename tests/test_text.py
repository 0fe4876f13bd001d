"""Hand-computed values and properties of the text functions and the span machinery."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from inkquest.functions import patterns as P, text as X
from inkquest.operators import extract as D, ingest as I


def one(spark, text, *cols):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select(*cols).first()


def test_tokens(spark):
    r = one(spark, "It's A-1 test, ÉTÉ x2!", *[X.tokenize("text", v) for v in ("index", "cased", "words", "query")])
    assert r[0] == ["it", "test", "x2"]
    assert r[1] == ["test"]
    assert r[2] == ["it", "test", "été", "x2"]
    assert r[3] == ["it", "test"]


def test_jaccard_and_empty(spark):
    df = spark.createDataFrame([("ab cd ef", "cd ef gh"), ("", "ab")], "a string, b string")
    assert [r[0] for r in df.select(X.token_jaccard("a", "b")).collect()] == [0.5, 0.0]


def test_numbers(spark):
    r = one(spark, "5 kids, $3.5M and 20% of 1,200", X.numeric_values("text"), X.numeric_values("text", strict=False))
    assert [(v.value, v.unit) for v in r[0]] == [(5.0, ""), (3.5e6, "M"), (20.0, "%"), (1200.0, "")]
    assert r[1][0].value == 5000.0


def test_titles_and_dates(spark):
    assert one(spark, " who is the owner of this ", X.conversation_title("text"))[0] == "The owner of this"
    assert one(spark, "   ", X.conversation_title("text"))[0] == "New Chat"
    assert one(spark, "x" * 60, X.conversation_title("text"))[0] == "X" + "x" * 46 + "..."
    assert one(spark, "On 7 March 2011 at 9", X.fuzzy_date("text"))[0] == "2011-03-07"
    assert one(spark, "year 1999", X.fuzzy_date("text"))[0] == "1999-06-15"
    assert one(spark, "no date", X.fuzzy_date("text"))[0] is None


def test_entropy(spark):
    r = one(spark, "aabb", X.char_entropy("text"), X.uniqueness_score("text"))
    assert r[0] == pytest.approx(1.0)
    assert r[1] == pytest.approx((0.7 * 1 + 0.3 * 0.5) * 100)


@pytest.mark.parametrize("n,size,lap", [(1, 5, 2), (10, 5, 2), (11, 5, 2), (0, 5, 2)])
def test_chunks_rebuild_the_text(spark, n, size, lap):
    text = "".join(chr(97 + i % 26) for i in range(n))
    c = one(spark, text, X.chunks("text", size, lap))[0]
    want = [text[i:i + size] for i in range(0, n, size - lap)]
    assert c == want


def test_running_prefixes_cross_blocks(spark):
    vals = [random.Random(3).randint(0, 9) for _ in range(1000)]
    df = spark.createDataFrame([(vals,)], "v array<int>")
    got = df.select(P.running(F.col("v"), F.lit(7), lambda a, b: a + b)).first()[0]
    want = [7]
    for v in vals:
        want.append(want[-1] + v)
    assert got == want


def test_loop_forms_match_plain_patterns(spark):
    rng = random.Random(5)
    words = ["Foo", "Bar", "bar", "Inc", "Inc.", "Corp", "Company", "The", "Society", "A", "12", "x.com", "a.b.org", "u-v.net.1", ",", "\n",
             "Baz2", "Qux,", "Main", "Street", "/a/b.c", "Dr.", "Paris", "US", "1.22.333", "$5", "Co", "fooBar"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))).replace(" ,", ",") for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    pats = [p for p in P.REGISTRY if p.loop_form] + [p for _, _, p in D.kind_patterns() if p.loop_form] + [p for p in D.COMPACT if p.loop_form]
    for p in pats:
        got = {r[0]: r[1] for r in df.select("doc_id", P.values_of("text", p)).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [m.group(0) for m in re.finditer(p.regex, t)], (p.name, t)


def test_long_runs_do_not_overflow(spark):
    text = "Foo Bar " * 20_000 + "a.b." * 5_000 + "com"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    v = {r.pattern for r in D.extract_values(df).collect()}
    assert "person_name" in v and "domain" in v
    assert D.typed_entities(df, ["person", "organization", "location"]).count() >= 1


def test_span_offsets_are_exact(spark):
    text = "é id 12 in 112 and 12; mail a.b@c.org é\nthen 12"
    p = P.Pattern("n", r"\b12\b", "x", 1.0)
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.start, r.end, r.value) for r in D.extract_spans(rows, [p]).collect()]
    assert got == [(m.start(), m.end(), "12") for m in re.finditer(r"\b12\b", text)]


def test_redaction_covers_the_union(spark):
    text = "call token = abcdef1234 now; card 4111111111111111 and ghp_" + "a" * 36 + "."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    red = D.redact(df).first().redacted
    assert len(red) == len(text)
    mask = [False] * len(text)
    for p in P.select_patterns(sensitive=True):
        for m in re.finditer(p.regex, text):
            mask[m.start():m.end()] = [True] * (m.end() - m.start())
    assert red == "".join("*" if m else c for c, m in zip(text, mask)) and "4111" not in red


def test_extraction_sentence(spark):
    text = "On January 15, 2024 and 2024-02-01 John Smith met Jane Q. Doe, paid $5.5 million plus $100,000 to Acme Widgets Inc in Lyon, France; john@mail.example.com"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {}
    for r in D.typed_entities(df).collect():
        got.setdefault(r.kind, set()).add(r.value)
    assert got["date"] == {"January 15, 2024", "2024-02-01"}
    assert {"John Smith", "Jane Q. Doe"} <= got["person"]
    assert "Acme Widgets Inc" in got["organization"] and "$5.5 million" in got["amount"] and "$100,000" in got["amount"]
    assert "Lyon, France" in got["location"] and got["email"] == {"john@mail.example.com"}


@pytest.mark.parametrize("text,exact,plain", [("$5M", 5e6, 0.0), ("USD 5", 5.0, 0.0), ("2 thousand dollars", 2000.0, 2.0), ("$1.5 million", 1.5e6, 1.5e6), ("3 billion euros", 3e9, 3e9)])
def test_amounts(spark, text, exact, plain):
    r = one(spark, text, D.amount_value("text"), D.amount_value("text", "plain"))
    assert (r[0], r[1]) == (exact, plain)


def test_proximity_limits(spark):
    p = [P.Pattern("a", "AA", "x", 1.0), P.Pattern("b", "BB", "x", 1.0)]
    rows = [(1, "AABB"), (2, "AA" + " " * 50 + "BB"), (3, "AA" + "." * 200 + "BB"), (4, "AA" + " " * 201 + "BB"), (5, "AA works at BB")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.relationship, r.distance) for r in D.proximity_relations(df, p).collect()}
    assert got == {(2, "associated_with", 50), (5, "works_at", 10)}


def test_amount_anomalies_cut_anywhere(spark):
    rng = random.Random(2)
    vals = [(1, float(rng.choice(range(0, 400, 10)))) for _ in range(300)]
    df = spark.createDataFrame(vals, "g long, a double")
    want = sorted((r.kind, r.amount, r.detail) for r in D.amount_anomalies(df, "g", "a", span=10_000).collect())
    for span in (10, 25, 70):
        assert sorted((r.kind, r.amount, r.detail) for r in D.amount_anomalies(df, "g", "a", span=span).collect()) == want
    s = sorted({v for _, v in vals})
    seq = {s[i] for i in range(len(s) - 2) if abs((s[i + 1] - s[i]) - (s[i + 2] - s[i + 1])) < 0.01}
    assert {a for k, a, _ in want if k == "sequence"} == seq


def test_numbering(spark):
    keys = random.Random(1).sample(range(100_000), 3000)
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, g long")
    got = [r.rn for r in I.numbered(df, "k", buckets=16).orderBy("k").collect()]
    assert got == list(range(1, 3001))
    for g in range(3):
        part = [r.rn for r in I.numbered_within(df, "g", "k", span=5000).where(f"g = {g}").orderBy("k").collect()]
        assert part == list(range(1, len(part) + 1))


def test_quality_gate(spark):
    long = "word " * 20
    df = spark.createDataFrame([(1, long), (2, long), (3, "short"), (4, long + "x"), (5, "short")], "doc_id long, text string")
    known = spark.createDataFrame([(long + "x",)], "t string").select(I.text_hash("t").alias("hash"))
    got = {r.doc_id: r.status for r in I.quality_gate(df, known).collect()}
    assert got == {1: "inserted", 2: "duplicate", 3: "too_short", 4: "duplicate", 5: "too_short"}


def test_attachment_checks(spark):
    from inkquest.operators.attachments import attachment_findings

    png = bytes.fromhex("89504E470D0A1A0A") + b"data" + b"IEND" + bytes.fromhex("AE426082")
    rows = [(1, "a.png", png), (2, "a.jpg", png), (3, "b.png", png + b"hidden bytes here"), (4, "c.jpg", bytes.fromhex("FFD8FFE0") + b"Exif" + bytes.fromhex("0FFD9A") * 9 + bytes.fromhex("FFD9"))]
    got = {r.file_id: r for r in attachment_findings(spark.createDataFrame(rows, "file_id long, name string, content binary")).collect()}
    assert got[1].findings == "" and not got[1].hidden
    assert got[2].findings == "extension_mismatch"
    assert got[3].findings == "trailing_data" and got[3].hidden
    assert got[4].findings == "location_marks" and got[4].trailing_bytes == 0


def test_entropy_reads_a_text_once_and_keeps_the_edges(spark):
    rows = spark.createDataFrame([(1, "aabb"), (2, ""), (3, None), (4, "é😀é😀")], "k int, t string")
    got = {r["k"]: (r["h"], r["u"]) for r in rows.select("k", X.char_entropy("t").alias("h"), X.uniqueness_score("t").alias("u")).collect()}
    assert got[1][0] == 1.0 and got[2] == (0.0, 0.0) and got[3] == (None, 0.0) and got[4][0] == 1.0
    plan = rows.select(X.char_entropy("t").alias("h"), X.uniqueness_score("t").alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan and plan.count("ArrowEvalPython") == 1


def test_windows_are_those_of_every_query_and_text(spark):
    from inkquest.operators import terms as T

    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{words} Blue! {words} red"), (2, "co-op of blue"), (3, "nothing"), (4, "red-blue tail")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "blue red"), (2, "co coop"), (3, "tail absent"), (4, "")], "query_id long, query string")
    want = T.query_hits(docs, queries).select("query_id", "doc_id", X.hit_window("text", "terms").alias("window"))
    got = T.query_windows(docs, queries)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
    marked = {(r.query_id, r.doc_id): r.window for r in got.collect()}
    assert marked[2, 2] == "<mark>co-op</mark> of blue" and marked[3, 4] == "red-blue <mark>tail</mark>" and marked[1, 1].startswith("w50 w51") and "<mark>Blue!</mark> w0" in marked[1, 1]
    # a text meets its queries once, as one row, with its distinct words; a window hashes the terms, not each of its words reads them
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "array_intersect" in plan and "min(at#" in plan and plan.count("max(hit#") > 1


def test_table_function_reads_as_the_plain_patterns_and_looks_for_guards_once(monkeypatch):
    """Loop forms, dead runs and guards change nothing but the time; a text without a digit is not searched for phones."""
    import random
    import re

    from inkquest.functions import table_functions as T

    rng = random.Random(4)
    bits = ["Acme Holdings Foundation", "the new Company", "john@site.example.org", "+33 1 42 68 53 00", "10.0.0.255", "fe80:1:2:3:4:5:6:7", "00:1B:44:11:3A:B7", "2024-05-01T10:11:12Z",
            "12 March 2021", "9:30 pm", "$1,234.50", "20 USD", "@handle", "#tag", "run(x, y)", "import os", "password: hunter2", "/usr/lib/x.so", "C:\\\\dir\\\\f", "www.example.co.uk", "A.B", "etc.so on",
            "deadbeef" * 4, "deadbeef" * 5, "deadbeef" * 8, "AKIA" + "A1" * 8, "é ü", "John Smith", "Mary\nJane Watson", "eyJa.eyJb.c", "x" * 50, "\n", "x. y"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)] + ["", "Plain words of a text. " * 50]
    for text in texts:
        folded = re.sub(r"[^\x00-\x7f]", " ", text)
        want = [(p.name, m.start(), m.end()) for p in P.REGISTRY for m in re.finditer(p.regex, folded, re.ASCII)]
        assert [(r[0], r[3], r[4]) for r in T.ExtractSpans().eval(text)] == want
    searched = []
    monkeypatch.setattr(T, "_cache", {None: [(p, lambda t, p=p: searched.append(p.name) or find(t), guard) for p, find, guard in T._compiled(None)]})
    assert list(T.ExtractSpans().eval("no such thing in a text")) == [] and not {"phone", "domain", "time"} & set(searched) and "organization" in searched


def test_a_report_of_patterns_searches_the_texts_once(spark):
    from inkquest.operators import extract

    seen = spark.sparkContext.accumulator(0)

    def look(rows):
        for r in rows:
            seen.add(1)
            yield r

    docs = spark.createDataFrame(spark.createDataFrame([(k, f"call {k}@site.org on 2024-05-01") for k in range(40)], "doc_id long, text string").rdd.mapPartitions(look), "doc_id long, text string")
    assert extract.pattern_report(extract.extract_values(docs)).count() > 2 and seen.value == 40
