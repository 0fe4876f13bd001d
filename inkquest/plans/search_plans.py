"""Search over the whole corpus with every benchmark passage as a query (survey rows E1-E27, I10)."""

from pyspark.sql import functions as F

from ..functions import text as X, wordlists as W
from ..operators import extract as D, query_strings as Q, search as E
from . import sqltext as S
from .extract_plans import _COMPACT_SQL
from .inputs import messages, passages, scores
from .registry import query
from ..session import reuse, shared_dir

_TEXT = "subject || ' ' || body || ' ' || sender"
QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
WEIGHT = {
    "log": "(1 + ln(f)) * ln(1 + n / (1 + df))",
    "norm": "f::DOUBLE / doc_len * ln(1 + n / df)",
    "bm25": "ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / a))",
}


def posting_ctes(text=_TEXT, src="messages"):
    return f"""tk AS MATERIALIZED (SELECT doc_id, {S.tok(text)} AS w FROM {src}),
po AS MATERIALIZED (SELECT doc_id, n AS doc_len, term, count(*) AS f FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM tk) GROUP BY ALL),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM po GROUP BY 1), tot AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM tk)"""


def score_ctes(formula, qsrc="queries", p=""):
    return f"""{p}qt AS MATERIALIZED (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({S.tok('query')}) AS term FROM {qsrc}) GROUP BY ALL),
{p}sc AS MATERIALIZED (SELECT query_id, doc_id, round(sum(qf * {WEIGHT[formula]}), 6) AS score, count(*) AS hits
  FROM {p}qt JOIN po USING (term) JOIN dfs USING (term), tot GROUP BY 1, 2),
{p}hit_all AS (SELECT {p}sc.* FROM {p}sc JOIN (SELECT query_id, count(*) AS need FROM {p}qt GROUP BY 1) USING (query_id) WHERE hits = need)"""


def base(formula, qsrc="queries"):
    return f"{S.MESSAGES}, {S.SCORES}, {QUERIES}, {posting_ctes()}, {score_ctes(formula, qsrc)}"


def topk(src, k, order="score DESC, doc_id", group="query_id", cols="query_id, doc_id, score", rank="rank"):
    return f"SELECT {cols}, {rank} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS INTEGER) AS {rank} FROM {src}) WHERE {rank} <= {k}"


def corpus(t):
    return t.text("documents", "doc_id"), E.index_text(F.split_part("text", F.lit("\n"), F.lit(1)), "text",
                                                         F.concat("source", F.lit("@"), "source", F.lit(".example")))


@query("postings_E1", f"WITH {S.MESSAGES}, {posting_ctes()} SELECT term, doc_id, CAST(f AS BIGINT) AS f, CAST(doc_len AS INTEGER) AS doc_len FROM po")
def _(t):
    d, text = corpus(t)
    return E.build_index(d, text).postings.select("term", "doc_id", "f", "doc_len")


@query("tfidf_search_log_E2", f"WITH {base('log')} {topk('sc', 10)}")
def _(t):
    d, text = corpus(t)
    return E.tfidf_search(d, passages(t), 10, "log", text)


def _fts_sql(src):
    return f"""un AS (SELECT s.query_id, s.doc_id, s.score, CASE WHEN best > 0 THEN score / best ELSE 0 END AS unit FROM {src} s JOIN (SELECT query_id, max(score) AS best FROM {src} GROUP BY 1) USING (query_id)),
bl AS (SELECT un.*, coalesce(pertinence, 50) AS pertinence, coalesce(suspicion, 0) AS suspicion, CASE WHEN target_id IS NULL THEN 70 ELSE coalesce(confidence, 50) END AS confidence,
  round(0.5 * unit + 0.5 * coalesce(pertinence, 50) / 100, 6) AS blend FROM un LEFT JOIN scores ON target_id = doc_id)"""


def stored_index(t) -> str:
    """The corpus indexed once into a new folder, in two parts as if the second half came later."""
    d, text = corpus(t)
    path = shared_dir(t.spark, "index")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for k in (0, 1):
        E.build_index(d.where(half == k), text).save(path, f"{k:06d}")
    return path


@query("stored_index_search_E2", f"WITH {base('log')} {topk('sc', 10)}")
def _(t):
    return E.tfidf_search(None, passages(t), 10, "log", stored=stored_index(t))


@query("stored_index_scored_E11", f"""WITH {base('bm25')}, {{fts}},
c AS (SELECT *, round(0.4 * blend + 0.3 * pertinence / 100 + 0.2 * suspicion / 100 + 0.1 * confidence / 100, 6) AS composite FROM bl)
{topk('c', 20, 'composite DESC, doc_id', cols='query_id, doc_id, score, composite')}""".replace("{fts}", _fts_sql("sc")))
def _(t):
    return E.scored_corpus_search(None, passages(t), scores(t), 20, stored=stored_index(t)).select("query_id", "doc_id", "score", "composite", "rank")


@query("tfidf_search_norm_E3", f"WITH {base('norm')} {topk('sc', 10)}")
def _(t):
    d, text = corpus(t)
    return E.tfidf_search(d, passages(t), 10, "norm", text)


@query("fts_search_E4", f"WITH {base('bm25')}, {_fts_sql('hit_all')} {topk('bl', 20, 'blend DESC, doc_id', cols='query_id, doc_id, score, blend')}")
def _(t):
    d, text = corpus(t)
    return E.fts_search(d, passages(t), scores(t), 20, text).select("query_id", "doc_id", "score", "blend", "rank")


@query("fts_search_any_E5", f"WITH {base('bm25')} {topk('sc', 20)}")
def _(t):
    d, text = corpus(t)
    return E.tfidf_search(d, passages(t), 20, "bm25", text)


# clauses: first word required, all further words optional, the fixed word "thou" excluded, the first two words as a phrase
_CLAUSES = f"""clauses AS (
 SELECT query_id, 'and' AS op, w[1] AS term FROM (SELECT query_id, {S.tok('query')} AS w FROM queries)
 UNION ALL SELECT query_id, 'or', unnest(w[2:]) FROM (SELECT query_id, {S.tok('query')} AS w FROM queries)
 UNION ALL SELECT query_id, 'not', 'thou' FROM queries
 UNION ALL SELECT query_id, 'phrase', w[1] || ' ' || w[2] FROM (SELECT query_id, {S.tok('query')} AS w FROM queries))"""


@query("boolean_search_E6", f"""WITH {S.MESSAGES}, {QUERIES}, {posting_ctes()}, {_CLAUSES},
cw AS (SELECT query_id, op, unnest({S.tok('term')}) AS term FROM clauses),
qt AS (SELECT query_id, term, count(*) AS qf FROM cw WHERE op <> 'not' GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, round(sum(qf * {WEIGHT['bm25']}), 6) AS score FROM qt JOIN po USING (term) JOIN dfs USING (term), tot GROUP BY 1, 2),
must AS (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id, term FROM cw WHERE op IN ('and', 'phrase')) JOIN po USING (term) GROUP BY 1, 2
  HAVING (query_id, count(*)) IN (SELECT (query_id, count(DISTINCT term)) FROM cw WHERE op IN ('and', 'phrase') GROUP BY query_id)),
bad AS (SELECT query_id, doc_id FROM cw JOIN po USING (term) WHERE op = 'not'),
norm AS (SELECT doc_id, ' ' || trim(regexp_replace(lower({_TEXT}), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x FROM messages),
ok AS (SELECT sc.* FROM sc JOIN must USING (query_id, doc_id) JOIN norm USING (doc_id) JOIN (SELECT query_id AS q, term FROM clauses WHERE op = 'phrase') ON q = query_id
  WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM bad) AND contains(x, ' ' || term || ' '))
{topk('ok', 20)}""")
def _(t):
    d, text = corpus(t)
    w = passages(t).select("query_id", X.tokenize("query").alias("w"))
    def clause(op, term):
        return w.select("query_id", F.lit(op).alias("op"), term.alias("term"))
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    others = F.explode(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))))
    clauses = (clause("and", first).unionByName(clause("or", others)).unionByName(clause("not", F.lit("thou")))
               .unionByName(clause("phrase", F.concat_ws(" ", first, second))))
    return E.boolean_search(d, clauses, 20, text)


# "first second" AND (third OR NOT fourth) OR "all further words", as a string, for every passage, from stored positional postings
@query("query_strings_E6", f"""WITH {S.MESSAGES}, {QUERIES}, {posting_ctes()}, qw AS (SELECT query_id, {S.tok('query')} AS w FROM queries),
dx AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS x FROM tk),
m AS (SELECT query_id, doc_id FROM qw, dx WHERE (contains(x, ' ' || w[1] || ' ' || w[2] || ' ') AND (contains(x, ' ' || w[3] || ' ') OR NOT contains(x, ' ' || w[4] || ' ')))
  OR (len(w) > 4 AND contains(x, ' ' || array_to_string(w[5:], ' ') || ' '))),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(w[:3] || w[5:]) AS term FROM qw) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, round(sum(qf * {WEIGHT['bm25']}), 6) AS score FROM qt JOIN po USING (term) JOIN dfs USING (term), tot GROUP BY 1, 2),
ok AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM m LEFT JOIN sc USING (query_id, doc_id)) {topk('ok', 20)}""")
def _(t):
    d, text = corpus(t)
    path = shared_dir(t.spark, "positional-index")
    E.build_index(d, text, positions=True).save(path)
    w = passages(t).select("query_id", X.tokenize("query").alias("w"))
    word = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(""))
    rest = F.array_join(F.slice("w", F.lit(5), F.greatest(F.size("w") - 4, F.lit(0))), " ")
    strings = w.select("query_id", F.format_string('"%s %s" AND (%s OR NOT %s) OR "%s"', word(0), word(1), word(2), word(3), rest).alias("query"))
    return Q.query_string_search(path, strings, 20)


@query("search_or_substring_E6", f"""WITH {base('bm25')}, em AS (SELECT * FROM queries WHERE query_id NOT IN (SELECT query_id FROM hit_all)),
u AS (SELECT query_id, doc_id, score FROM hit_all UNION ALL SELECT query_id, doc_id, 0.0 FROM em JOIN messages ON contains(lower({_TEXT}), lower(query)))
{topk('u', 20)}""")
def _(t):
    d, text = corpus(t)
    return E.search_or_substring(d, passages(t), 20, text)


def _terms_cte(limit, src="queries"):
    from .text_plans import _terms_sql
    return f"""st AS (SELECT query_id, a, list_transform(a, lambda t: lower(t)) AS la FROM (SELECT query_id, {_terms_sql('query', limit)} AS a FROM {src})),
sub AS (SELECT query_id AS qid, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS ord, unnest(u) AS query FROM (
  SELECT query_id, list_filter(a, lambda t, i: list_position(la, lower(t)) = i)[:{limit}] AS u FROM st)),
subq AS (SELECT qid * 100 + ord AS query_id, qid, ord, query FROM sub)"""


@query("fan_out_E7", f"""WITH {S.MESSAGES}, {QUERIES}, {posting_ctes()}, {_terms_cte(4)}, {score_ctes('log', 'subq')},
b AS ({topk('hit_all', 15)})
SELECT query_id // 100 AS query_id, doc_id, min(rank) AS best_rank, CAST(arg_min(query_id % 100, rank * 100 + query_id % 100) AS INTEGER) AS term_ord, count(*) AS terms_hit FROM b GROUP BY 1, 2""")
def _(t):
    d, text = corpus(t)
    return E.fan_out(d, passages(t), text=text)


_NAMES = "names AS (SELECT min(p_partkey) AS name_id, p_name AS name FROM part GROUP BY p_name), nq AS (SELECT name_id AS query_id, left(name, length(name) - 1) AS query FROM names)"
_TRI = lambda c: (f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), "
                  "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))")


@query("fuzzy_names_E8", f"""WITH {_NAMES}, p AS (SELECT query_id, name_id, contains(lower(name), lower(query)) AS inside, {_TRI('name')} AS a, {_TRI('query')} AS b FROM names, nq),
s AS (SELECT query_id, name_id, inside, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS x FROM p)
SELECT query_id, name_id, round(x, 6) AS similarity FROM s WHERE inside OR x > 0.3""")
def _(t):
    names = t("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("name_id"))
    q = names.select(F.col("name_id").alias("query_id"), F.expr("left(name, length(name) - 1)").alias("query"))
    return E.fuzzy_names(names, q).withColumn("similarity", F.round("similarity", 6))


@query("score_lookup_E9_E10", f"""WITH {S.SCORES} SELECT doc_id, coalesce(pertinence, 50) AS pertinence, coalesce(suspicion, 0) AS suspicion, coalesce(confidence, 50) AS confidence,
 round(0.4 * 0.5 + 0.3 * coalesce(pertinence, 50) / 100 + 0.2 * coalesce(suspicion, 0) / 100 + 0.1 * coalesce(confidence, 50) / 100, 6)::DOUBLE AS composite
 FROM documents LEFT JOIN scores ON target_id = doc_id""")
def _(t):
    d = E.with_scores(t("documents").select("doc_id"), scores(t), "document", "doc_id")
    return d.withColumn("composite", F.round(E.composite(F.lit(0.5), F.col("pertinence"), F.col("suspicion"), F.col("confidence")), 6))


@query("scored_corpus_search_E11", f"""WITH {base('bm25')}, {_fts_sql('sc')},
c AS (SELECT *, round(0.4 * blend + 0.3 * pertinence / 100 + 0.2 * suspicion / 100 + 0.1 * confidence / 100, 6) AS composite FROM bl)
{topk('c', 20, 'composite DESC, doc_id', cols='query_id, doc_id, score, composite')}""")
def _(t):
    d, text = corpus(t)
    return E.scored_corpus_search(d, passages(t), scores(t), 20, text).select("query_id", "doc_id", "score", "composite", "rank")


_SUS, _PERT, _CUR = ["token", "the ", "license"], ["contact", "und ", "que "], ["src1"]
_hits = lambda c, ws: " + ".join(f"contains({c}, '{w}')::INT" for w in ws)
@query("auto_score_E12", f"""WITH {S.MESSAGES}, x AS (SELECT doc_id, lower(subject || ' ' || body) AS t, lower(sender) AS s FROM messages)
SELECT doc_id, CAST(least(35 * ({_hits('s', _CUR)}) + 15 * ({_hits('t', _SUS)}), 100) AS INTEGER) AS suspicion,
 CAST(least(50 + 45 * ({_hits('s', _CUR)}) + 10 * ({_hits('t', _PERT)}), 100) AS INTEGER) AS pertinence, 70 AS confidence, 0 AS anomaly FROM x""")
def _(t):
    m = E.auto_score(messages(t), F.concat_ws(" ", "subject", "body"), F.col("sender"), _CUR, _SUS, _PERT)
    return m.select("doc_id", "suspicion", "pertinence", "confidence", "anomaly")


def _node_kind_hits(t):
    """Part names that share trigrams with any word of the passage, as node results with their best similarity."""
    names = t("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("name_id"))
    words = passages(t).select("query_id", F.explode(F.array_distinct(X.tokenize("query"))).alias("query"))
    hits = E.fuzzy_names(names, words.select(F.col("query").alias("query_id"), "query").distinct(), 0.1)
    return words.join(hits.withColumnRenamed("query_id", "query"), "query").groupBy("query_id", F.lit("node").alias("kind"), F.col("name_id").alias("id")).agg(
        F.round(F.max("similarity"), 6).alias("score"))


_FUZZY = f"""names AS (SELECT min(p_partkey) AS name_id, p_name AS name FROM part GROUP BY p_name), nw AS (SELECT DISTINCT query_id, unnest({S.tok('query')}) AS query FROM queries),
nq AS MATERIALIZED (SELECT query, {_TRI('query')} AS b FROM (SELECT DISTINCT query FROM nw)), na AS MATERIALIZED (SELECT name_id, name, {_TRI('name')} AS a FROM names),
fp AS (SELECT query, name_id, contains(lower(name), lower(query)) AS inside, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS x FROM na, nq),
nh AS (SELECT query_id, 'node' AS kind, name_id AS id, round(max(x), 6) AS score FROM fp JOIN nw USING (query) WHERE inside OR x > 0.1 GROUP BY query_id, name_id)"""


def _share(src, n):
    return f"SELECT query_id, kind, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM {src}) WHERE r <= {n}"


@query("merged_search_E13", f"""WITH {base('log')}, {_FUZZY}, dh AS (SELECT query_id, 'document' AS kind, doc_id AS id, score FROM sc),
u AS ({_share('dh', 10)} UNION ALL {_share('nh', 10)}) {topk('u', 20, 'score DESC, kind, id', cols='query_id, kind, id, score')}""")
def _(t):
    d, text = corpus(t)
    docs = E.tfidf_search(d, passages(t), 10, "log", text).select("query_id", F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "score")
    return E.merged_search(docs, _node_kind_hits(t), limit=20)


_KW1 = f"""kq AS (SELECT query_id, {S.qwords('query')} AS w FROM queries), kw AS (SELECT DISTINCT query_id, unnest(list_filter(w, lambda t: NOT list_contains({S.KEYWORD_STOP}, t))) AS term FROM kq),
ch AS (SELECT DISTINCT query_id, 'chunk' AS kind, doc_id AS id, 0.5::DOUBLE AS score FROM kw JOIN messages ON contains(lower(body), term))"""


@query("universal_search_E14", f"""WITH {base('log')}, {_FUZZY}, {_KW1}, dh AS (SELECT query_id, 'document' AS kind, doc_id AS id, score FROM sc),
u AS ({_share('dh', 10)} UNION ALL {_share('ch', 10)} UNION ALL {_share('nh', 10)}) {topk('u', 30, 'score DESC, kind, id', cols='query_id, kind, id, score')}""")
def _(t):
    d, text = corpus(t)
    docs = E.tfidf_search(d, passages(t), 10, "log", text).select("query_id", F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "score")
    stop = X.str_array(W.KEYWORD_STOP)
    words = passages(t).select("query_id", F.explode(F.filter(X.tokenize("query", "query"), lambda w: ~F.array_contains(stop, w))).alias("term")).distinct()
    chunk = E.substring_join(t.text("documents", "doc_id"), words).select(
        "query_id", F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"), F.lit(0.5).alias("score")).distinct()
    return E.merged_search(docs, chunk, _node_kind_hits(t), limit=30)


@query("keyword_substring_search_E15", f"""WITH {S.MESSAGES}, {QUERIES}, kw AS (SELECT DISTINCT query_id, unnest(w[:3]) AS term FROM (
  SELECT query_id, list_filter({S.qwords('query')}, lambda t: NOT list_contains({S.KEYWORD_STOP}, t)) AS w FROM queries)),
h AS (SELECT DISTINCT query_id, doc_id FROM kw JOIN messages ON length(term) >= 4 AND contains(lower(body), term))
{topk('h', 50, 'doc_id', cols='query_id, doc_id')}""")
def _(t):
    return E.keyword_substring_search(t.text("documents", "doc_id"), passages(t))


@query("searchable_corpus_E16", """
WITH deg AS (SELECT o_custkey AS id, count(*) AS d FROM orders GROUP BY 1)
(SELECT 'email' AS kind, doc_id AS id, text AS content FROM documents WHERE length(text) > 50)
UNION ALL (SELECT 'content', page_id, html FROM pages WHERE length(html) > 100)
UNION ALL (SELECT 'node', c_custkey, c_name || ' (' || coalesce(d, 0) || ')' FROM customer LEFT JOIN deg ON id = c_custkey WHERE length(c_name) > 2)""")
def _(t):
    deg = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("d"))
    mail = t("documents").where("length(text) > 50").select(F.lit("email").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    pages = t("pages").where("length(html) > 100").select(F.lit("content").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("content"))
    nodes = t("customer").where("length(c_name) > 2").join(deg, "c_custkey", "left").select(
        F.lit("node").alias("kind"), F.col("c_custkey").alias("id"),
        F.concat("c_name", F.lit(" ("), F.coalesce("d", F.lit(0)).cast("string"), F.lit(")")).alias("content"))
    return mail.unionByName(pages).unionByName(nodes)


@query("nearest_vectors_E17", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM x GROUP BY 1), s AS (SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(list_cosine_similarity(v, c), 6) AS cosine FROM e, q)
SELECT query_id, vec_id, cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def _(t):
    return E.nearest_vectors(t("embeddings"), _centroids(t), 10)


@query("nearest_vectors_lsh_E17")
def _(t):
    """Every twentieth vector searched among all."""
    return E.nearest_vectors_lsh(t("embeddings"), t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


def _centroids(t):
    """Mean vector of every label: one query per label over all vectors."""
    parts = t("embeddings").select(F.col("label").cast("bigint").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("embedding"))


@query("document_lookup_E18", """SELECT l.doc_id + 5 AS doc_id, left(text, 2000) AS body, CASE WHEN text IS NULL THEN 'missing' ELSE 'found' END AS status
 FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 5""")
def _(t):
    return E.lookup(t("documents"), t("labels").select((F.col("doc_id") + 5).alias("doc_id")))


@query("retrieval_context_E19", rf"""WITH {base('log')}, r AS ({topk('sc', 8)}),
s AS (SELECT query_id, rank, '[' || rank || '] #' || r.doc_id || ': ' || left(trim(regexp_replace(body, '\s+', ' ', 'g')), 400) AS line FROM r JOIN messages m ON m.doc_id = r.doc_id)
SELECT query_id, count(*) AS n_docs, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context FROM s GROUP BY 1""")
def _(t):
    d, text = corpus(t)
    hits = E.tfidf_search(d, passages(t), 8, "log", text)
    return E.retrieval_context(hits, t("documents"))


@query("result_digest_E20", f"""WITH {base('log')}, r AS ({topk('sc', 25)}), x AS (SELECT query_id, lang AS kind, split_part(text, chr(10), 1) AS title, min(rank) AS rank
  FROM r JOIN documents d ON d.doc_id = r.doc_id GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank, title) AS pos FROM x)
SELECT query_id, kind, count(*) AS n, string_agg(title, ' | ' ORDER BY pos) AS titles FROM p WHERE pos <= CASE kind WHEN 'en' THEN 5 WHEN 'fr' THEN 4 ELSE 6 END GROUP BY 1, 2""")
def _(t):
    return E.result_digest(_titled(t, 25), {"en": 5, "fr": 4}, 6)


def _titled(t, k):
    d, text = corpus(t)
    hits = E.tfidf_search(d, passages(t), k, "log", text)
    title = t("documents").select("doc_id", F.col("lang").alias("kind"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return title.join(hits, "doc_id").select("query_id", "kind", "title", "rank", "doc_id")


@query("follow_ups_E21", rf"""WITH {base('log')}, r AS ({topk('sc', 5)}), x AS (SELECT query_id, rank, regexp_extract_all({S.fold("split_part(text, chr(10), 1)")}, '\b[A-Z][A-Za-z]{{3,}}\b') AS w
  FROM r JOIN documents d ON d.doc_id = r.doc_id), y AS (SELECT query_id, rank, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM x),
f AS (SELECT y.query_id, word, min(rank * 100000 + pos) AS place FROM y JOIN queries q ON q.query_id = y.query_id WHERE NOT contains(lower(query), lower(word)) GROUP BY 1, 2),
a AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, word) AS ord, word FROM f), u AS (SELECT * FROM a WHERE ord <= 3
  UNION ALL SELECT query_id, 1000 AS ord, 'Show the timeline' FROM queries UNION ALL SELECT query_id, 1001, 'List the main names' FROM queries UNION ALL SELECT query_id, 1002, 'Compare the sources' FROM queries)
{topk('u', 3, 'ord', cols='query_id, word', rank='pos')}""")
def _(t):
    return E.follow_ups(_titled(t, 5), passages(t))


_EXP = f"""hits AS ({topk('sc', 12)}), m AS (SELECT query_id, hits.doc_id, sender, subject FROM hits JOIN messages USING (doc_id)), {_COMPACT_SQL},
feat AS (SELECT query_id, 'domain' AS feature, split_part(split_part(sender, '@', 2), '.', 1) AS term FROM m UNION ALL SELECT query_id, 'local', lower(split_part(sender, '@', 1)) FROM m
 UNION ALL SELECT query_id, 'word', unnest(regexp_extract_all({S.fold('lower(subject)')}, '\\b[a-z]{{5,15}}\\b')) FROM m
 UNION ALL SELECT query_id, kind, lower(value) FROM hits JOIN ce USING (doc_id) WHERE kind IN ('person', 'org')),
fc AS (SELECT query_id, feature, term, count(*) AS n, row_number() OVER (PARTITION BY query_id, feature ORDER BY count(*) DESC, term) AS r FROM feat GROUP BY query_id, feature, term
  HAVING length(term) > 3 AND count(*) >= CASE feature WHEN 'local' THEN 2 WHEN 'word' THEN 3 ELSE 1 END),
ex AS (SELECT query_id, feature, term, n FROM fc WHERE r <= CASE feature WHEN 'org' THEN 1 WHEN 'local' THEN 1 ELSE 2 END)"""


def _expansion(t):
    d, text = corpus(t)
    hits = reuse(E.tfidf_search(d, passages(t), 12, "log", text))
    hit_docs = t("documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return d, text, hits, E.expansion_terms(hits, messages(t), D.compact_entities(hit_docs), cut=E.EXPANSION_CUT)


@query("expansion_terms_E22", f"WITH {base('log')}, {_EXP} SELECT query_id, feature, term, n FROM ex")
def _(t):
    return _expansion(t)[3]


@query("expansion_search_E22", f"""WITH {base('log')}, {_EXP}, exq AS (SELECT (query_id, feature, term) AS query_id, term AS query FROM ex), {score_ctes('log', 'exq', 'x')},
xr AS ({topk('xhit_all', 8)}), xf AS (SELECT struct_extract(query_id, 1) AS query_id, doc_id, max(score) AS score FROM xr GROUP BY 1, 2)
SELECT query_id, doc_id, score FROM xf WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM hits)""")
def _(t):
    d, text, hits, feats = _expansion(t)
    return E.expand_once(d, hits, feats, 8, text)


@query("peak_month_E23", f"""WITH {base('log')}, h AS ({topk('sc', 50)}), c AS (SELECT query_id, strftime(date_sent, '%Y-%m') AS month, count(*) AS n FROM h JOIN messages USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT query_id, arg_min(month, (-n, month)) AS month, max(n) AS n FROM c GROUP BY 1""")
def _(t):
    d, text = corpus(t)
    return E.peak_month(E.tfidf_search(d, passages(t), 50, "log", text), messages(t))


# every turn searched in the corpus by its first five terms, five hits each
@query("cross_reference_E24", f"""WITH {S.MESSAGES}, queries AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations), {posting_ctes()}, {_terms_cte(5)}, {score_ctes('log', 'subq')},
b AS ({topk('hit_all', 5)})
SELECT query_id // 100 AS query_id, doc_id, min(rank) AS best_rank, CAST(arg_min(query_id % 100, rank * 100 + query_id % 100) AS INTEGER) AS term_ord, count(*) AS terms_hit FROM b GROUP BY 1, 2""")
def _(t):
    d, text = corpus(t)
    turns = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return E.fan_out(d, turns, 5, 5, text)


@query("frontier_E25", rf"""WITH {S.MESSAGES}, {S.SCORES} SELECT doc_id, array_to_string(list_filter(string_split_regex(subject, '\s+'), lambda w: w <> '')[:4], ' ') AS next_query
FROM messages WHERE doc_id NOT IN (SELECT target_id FROM scores) AND (contains(lower(subject), 'the') OR contains(lower(subject), 'ent')) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def _(t):
    return E.frontier(messages(t), scores(t), ["the", "ent"], 100, 4)


@query("heat_E26", f"""WITH {base('log')}, h AS ({topk('sc', 12)}) SELECT query_id, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS curated_hits, count(*) AS hits,
 CASE WHEN sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) >= 3 THEN 'hot' WHEN sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) > 0 THEN 'warm' ELSE 'cold' END AS heat
 FROM h LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = h.doc_id GROUP BY 1""")
def _(t):
    d, text = corpus(t)
    return E.heat(E.tfidf_search(d, passages(t), 12, "log", text), t("labels").where("quality = 1").select("doc_id"))


@query("explore_E26")
def _(t):
    d, text = corpus(t)
    return E.explore(d, passages(t), messages(t), D.compact_entities, t("labels").where("quality = 1").select("doc_id"), rounds=2, text=text)


@query("answer_quality_E27", """WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, text AS answer, CAST(length(text) % 3 AS INTEGER) AS sources, CAST(length(text) % 2 AS INTEGER) AS suggestions FROM conversations),
s AS (SELECT *, 100 - CASE WHEN NOT contains(lower(answer), 'analysis') THEN 20 ELSE 0 END - CASE WHEN NOT contains(lower(answer), 'finding') THEN 15 ELSE 0 END
 - CASE WHEN NOT (contains(answer, 'NEXT') OR contains(lower(answer), 'next step')) THEN 15 ELSE 0 END - CASE WHEN length(answer) < 200 THEN 20 ELSE 0 END - CASE WHEN length(answer) > 2000 THEN 10 ELSE 0 END
 - CASE WHEN NOT (contains(answer, '#') AND regexp_matches(answer, '[0-9]')) AND sources > 0 THEN 15 ELSE 0 END - CASE WHEN sources = 0 THEN 10 ELSE 0 END
 - CASE WHEN suggestions = 0 AND sources > 0 THEN 10 ELSE 0 END AS sc FROM a)
SELECT answer_id, CAST(greatest(sc, 0) AS INTEGER) AS score, CASE WHEN sc >= 80 THEN 'GOOD' WHEN sc >= 60 THEN 'OK' ELSE 'POOR' END AS quality,
 array_to_string(list_filter([CASE WHEN NOT contains(lower(answer), 'analysis') THEN 'missing_analysis' END, CASE WHEN NOT contains(lower(answer), 'finding') THEN 'missing_findings' END,
  CASE WHEN NOT (contains(answer, 'NEXT') OR contains(lower(answer), 'next step')) THEN 'missing_next_step' END, CASE WHEN length(answer) < 200 THEN 'too_short' END, CASE WHEN length(answer) > 2000 THEN 'too_long' END,
  CASE WHEN NOT (contains(answer, '#') AND regexp_matches(answer, '[0-9]')) AND sources > 0 THEN 'no_citations' END, CASE WHEN suggestions = 0 AND sources > 0 THEN 'no_suggestions' END], lambda x: x IS NOT NULL), ',') AS issues FROM s""")
def _(t):
    a = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"),
                                  F.pmod(F.length("text"), F.lit(3)).alias("sources"), F.pmod(F.length("text"), F.lit(2)).alias("suggestions"))
    return E.answer_quality(a)


@query("run_score_E27", """SELECT count(*) AS tested, count(*) FILTER (quality = 1) AS evidence_found, count(*) FILTER (quality = 1 AND toxic = 0) AS leads,
 round(40.0 * count(*) FILTER (quality = 1) / count(*) + 60.0 * count(*) FILTER (quality = 1 AND toxic = 0) / count(*), 1)::DOUBLE AS quality_score FROM labels""")
def _(t):
    return E.run_score(t("labels").select((F.col("quality") == 1).alias("evidence"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("lead")))


@query("evidence_records_I10", f"""WITH {base('log')}, n AS (SELECT query_id, count(*) AS n FROM sc GROUP BY 1), f AS (
  SELECT query_id, array_to_string(list(doc_id ORDER BY rank), ',') AS ids FROM ({topk('sc', 50)}) GROUP BY 1)
SELECT query_id, n AS results, ids, left(sha256('{{"ids":"' || ids || '","query_id":' || query_id || ',"results":' || n || '}}'), 16) AS evidence_hash FROM n JOIN f USING (query_id)""")
def _(t):
    from ..operators.ingest import evidence_hash
    d, text = corpus(t)
    terms = E.query_terms(passages(t))
    scored = E.score_terms(E.build_index(d, text, terms), terms, "log")
    total = scored.groupBy("query_id").agg(F.count("*").alias("results"))
    first = E.ranked(scored, 50).groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",").alias("ids"))
    return total.join(first, "query_id").select("query_id", "results", "ids", evidence_hash("query_id", "results", "ids").alias("evidence_hash"))


_NODE_SCORES = "nsc AS (SELECT 'node' AS target_type, s_suppkey AS target_id, CAST(s_suppkey * 7 % 60 AS INTEGER) AS suspicion, CAST(s_suppkey * 3 % 100 AS INTEGER) AS pertinence, 60 AS confidence FROM supplier WHERE s_suppkey % 3 <> 0)"


# every fifth supplier asked for by its name without the last character, written without punctuation
@query("node_search_E8", f"""WITH {_NODE_SCORES}, nn AS (SELECT s_suppkey AS id, s_name AS name, trim(regexp_replace(lower(s_name), '[^a-z0-9\\s]', '', 'g')) AS norm FROM supplier),
nq AS (SELECT id AS query_id, left(norm, length(norm) - 1) AS query FROM nn WHERE id % 5 = 0), b AS (SELECT id, name, {_TRI('name')} AS a FROM nn UNION SELECT id, norm, {_TRI('norm')} FROM nn),
p AS (SELECT query_id, id, contains(lower(name), lower(query)) AS inside, a, {_TRI('query')} AS b FROM b, nq),
s AS (SELECT query_id, id, round(max(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))), 6) AS similarity FROM p
  WHERE inside OR len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) > 0.3 GROUP BY 1, 2),
c AS (SELECT query_id, id, similarity, round(0.4 * similarity + 0.3 * coalesce(pertinence, 50) / 100 + 0.2 * coalesce(suspicion, 0) / 100 + 0.1 * coalesce(confidence, 50) / 100, 6) AS composite
  FROM s LEFT JOIN nsc ON target_id = id) {topk('c', 20, 'composite DESC, id', cols='query_id, id, similarity, composite')}""")
def _(t):
    s = t("supplier")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    norm = X.normalize_name("name")
    asked = nodes.where("id % 5 = 0").select(F.col("id").alias("query_id"), norm.alias("q")).select("query_id", F.expr("left(q, length(q) - 1)").alias("query"))
    k = F.col("s_suppkey")
    rated = s.where("s_suppkey % 3 <> 0").select(F.lit("node").alias("target_type"), k.alias("target_id"), F.pmod(k * 7, F.lit(60)).alias("suspicion"),
                                                F.pmod(k * 3, F.lit(100)).alias("pertinence"), F.lit(60).alias("confidence"))
    return E.node_search(nodes, asked, rated, 20)


@query("unscored_messages_E25", f"""WITH {S.MESSAGES}, {S.SCORES} SELECT count(*) AS unscored, count(*) FILTER (contains(lower(subject), 'the') OR contains(lower(subject), 'ent')) AS on_topic
FROM messages WHERE doc_id NOT IN (SELECT target_id FROM scores)""")
def _(t):
    return E.unscored(messages(t), scores(t), ["the", "ent"])


# every passage is a trail; its words of five letters or more are the targets, the first two of each trail are run
@query("explore_trails_E26")
def _(t):
    from ..operators import trails
    d, text = corpus(t)
    path = shared_dir(t.spark, "trail-index")
    E.build_index(d, text).save(path)
    words = passages(t).select(F.col("query_id").alias("trail"), F.posexplode(F.array_distinct(F.filter(X.tokenize("query"), lambda w: F.length(w) >= 5))).alias("ord", "query"))
    subject = messages(t).select("doc_id", F.explode(F.array_distinct(F.filter(X.tokenize("subject"), lambda w: F.length(w) >= 6))).alias("suggestion"))

    def suggest(hits):
        seen = hits.join(subject, "doc_id").groupBy("query_id", "suggestion").agg(F.count("*").alias("n"))
        return E.top_per(seen, "query_id", 5, F.desc("n"), "suggestion", rank="ord").select("query_id", "ord", "suggestion", (F.col("n") > 1).alias("relevant"), F.lit(False).alias("noise"))

    return trails.explore_trails(words, lambda q: E.tfidf_search(None, q, 12, stored=path), suggest, t("labels").where("quality = 1").select("doc_id"), max_queries=2)
