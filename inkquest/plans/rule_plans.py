"""Rule classifiers over whole tables (survey rows C0-C7)."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexicon as L, rules as R, search as E
from . import sqltext as S
from .inputs import messages, passages
from .registry import query
from .search_plans import QUERIES, base, corpus, topk

LISTS = {"legal": ["license", "copyright", "terms"], "access": ["token", "password"], "article": ["the ", "die ", "les "]}
# every benchmark word of ten or more letters, weighted by length: a lexicon that grows with the table
_LEX = f"lex AS (SELECT DISTINCT 'word' AS list_name, w AS term, length(w) / 100.0::DOUBLE AS weight FROM (SELECT unnest({S.tok('text')}) AS w FROM benchmark) WHERE length(w) >= 10)"


def lexicon(t):
    w = t("benchmark").select(F.explode(X.tokenize("text")).alias("term")).where("length(term) >= 10").distinct()
    return w.select(F.lit("word").alias("list_name"), "term", (F.length("term") / 100).alias("weight"))


@query("filtered_listing_C0", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr' AND text ILIKE '%tion%' AND n_chars >= 200 ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 40 OFFSET 10")
def _(t):
    return R.listing(t("documents"), {"lang": "fr", "source": None}, {"text": "tion"}, {"n_chars": 200}, ["n_chars"], limit=40, offset=10).select("doc_id", "lang", "n_chars")


@query("matched_lists_C1_C5", f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in ws)} THEN '{n}' END" for n, ws in sorted(LISTS.items()))}], lambda x: x IS NOT NULL), ',') AS lists FROM documents""")
def _(t):
    return t("documents").select("doc_id", F.array_join(R.matched_lists("text", LISTS), ",").alias("lists"))


@query("lexicon_matches_C1_F9", f"WITH {_LEX} SELECT doc_id, list_name, term, weight FROM documents, lex WHERE contains(lower(text), term)")
def _(t):
    return R.lexicon_matches(t.text("documents", "doc_id"), lexicon(t)).select("doc_id", "list_name", "term", "weight")


@query("lexicon_matches_by_gram_C1_F9", f"WITH {_LEX} SELECT doc_id, term FROM documents, lex WHERE contains(lower(text), term)")
def _(t):
    # the route of large lexicons, forced
    return E.substring_join(t.text("documents", "doc_id"), lexicon(t), small=0, by_gram=True).select("doc_id", "term")


# every word of the benchmark and every letter of the alphabet
@query("lexicon_automaton_C1_F9", f"""WITH lex AS (SELECT DISTINCT w AS term FROM (SELECT unnest({S.tok('text')}) AS w FROM benchmark) UNION SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')))
SELECT doc_id, term FROM documents, lex WHERE contains(lower(text), term)""")
def _(t):
    words = t("benchmark").select(F.explode(X.tokenize("text")).alias("_term")).union(t.spark.range(97, 123).select(F.chr("id").alias("_term")))
    return L.term_counts(t.text("documents", "doc_id"), words).select("doc_id", F.col("_term").alias("term"))


@query("lexicon_score_D17", f"""WITH {_LEX}, m AS (SELECT doc_id, count(*) AS terms, sum(weight) AS w FROM documents, lex WHERE contains(lower(text), term) GROUP BY 1)
SELECT d.doc_id, coalesce(terms, 0) AS terms, round(least(coalesce(w, 0), 1.0), 6) AS score, round(least(coalesce(w, 0), 1.0), 6) > 0.1 AS flagged FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""")
def _(t):
    return R.weighted_score(t.text("documents", "doc_id"), lexicon(t))


@query("noise_names_C2", r"""SELECT doc_id, (length(s) < 4 OR contains(s, 'menu') OR contains(s, 'cookie') OR regexp_matches(translate(s, ' -', ''), '^[0-9]+$')) AS noise
FROM (SELECT doc_id, trim(lower(split_part(text, chr(10), 1))) AS s FROM documents)""")
def _(t):
    return messages(t).select("doc_id", R.is_noise("subject", ["menu", "cookie"]).alias("noise"))


_SUGG = rf"""sg AS (SELECT conv_id AS query_id, query, CAST(turn * 1000 + generate_subscripts(w, 1) AS BIGINT) AS pos, unnest(w) AS suggestion FROM (
  SELECT c.conv_id, c.turn, f.text AS query, regexp_extract_all({S.fold('c.text')}, '\b[A-Z][a-z]+ [a-z]+\b') AS w FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0 AND c.turn > 0)),
tg AS (SELECT *, CASE WHEN contains(trim(lower(suggestion)), 'the') OR contains(trim(lower(suggestion)), 'en') THEN 0 WHEN length(suggestion) > 8 AND regexp_matches(suggestion, '^\s*[A-Z]\S*(?:\s+[A-Z]\S*)+\s*$') THEN 1 END AS tier
 FROM sg WHERE NOT contains(lower(query), trim(lower(suggestion))) AND NOT (length(trim(lower(suggestion))) < 4 OR contains(lower(suggestion), 'ation')))"""


@query("filter_suggestions_C3", f"""WITH {_SUGG}, ok AS (SELECT * FROM tg WHERE tier IS NOT NULL)
{topk('ok', 4, 'tier, pos, suggestion', cols='query_id, suggestion, tier')}""")
def _(t):
    c = t("conversations")
    first = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    later = c.where("turn > 0").select(F.col("conv_id").alias("query_id"), "turn", F.posexplode(F.regexp_extract_all(
        X.ascii_fold("text"), F.lit(r"\b[A-Z][a-z]+ [a-z]+\b"), F.lit(0))).alias("i", "suggestion"))
    s = later.join(first, "query_id").select("query_id", "query", (F.col("turn") * 1000 + F.col("i") + 1).alias("pos"), "suggestion")
    return R.filter_suggestions(s, ["the", "en"], ["ation"], strict=False)


# one rule per nation-sized list: the distinct first words of the part names in order, suggesting their brands
_RULES = """rules AS (SELECT dense_rank() OVER (ORDER BY r_name) AS rule_order, lower(left(r_name, 2)) AS term, n_nationkey AS pos, lower(substring(r_name, 2, 3)) || ' ' || n_name AS suggestion FROM region JOIN nation ON n_regionkey = r_regionkey)"""


def _rules(t):
    r = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    order = F.dense_rank().over(E.Window.partitionBy(F.lit(0)).orderBy("r_name"))
    return r.select(order.alias("rule_order"), F.lower(F.expr("left(r_name, 2)")).alias("term"), F.col("n_nationkey").alias("pos"),
                    F.concat(F.lower(F.substring("r_name", 2, 3)), F.lit(" "), "n_name").alias("suggestion"))


@query("topic_suggestions_C4", f"""WITH {QUERIES}, {_RULES}, f AS (SELECT query_id, min(rule_order) AS rule_order FROM queries, rules WHERE contains(lower(query), term) GROUP BY 1),
o AS (SELECT query_id, pos, suggestion FROM f JOIN rules USING (rule_order) UNION ALL SELECT query_id, 0, 'timeline' FROM queries WHERE query_id NOT IN (SELECT query_id FROM f)),
k AS (SELECT o.* FROM o JOIN queries USING (query_id) WHERE NOT contains(lower(query), lower(suggestion))) {topk('k', 3, 'pos, suggestion', cols='query_id, suggestion')}""")
def _(t):
    return R.topic_suggestions(passages(t), _rules(t), ["timeline"])


@query("topic_links_C4", f"WITH {QUERIES}, {_RULES} SELECT DISTINCT q.query_id, b.suggestion FROM queries q, rules a, rules b WHERE contains(lower(query), a.term) AND a.rule_order = b.rule_order")
def _(t):
    return R.topic_links(passages(t), _rules(t))


@query("content_mix_C6", f"""WITH {base('log')}, r AS ({topk('sc', 25)}), x AS (SELECT query_id, (contains(lower(sender), 'src1') OR contains(lower(subject), 'the ')) AS junk,
  (contains(lower(sender), '@src2') AND length(subject) < 50 AND NOT contains(lower(subject), 'fwd') AND NOT contains(lower(subject), 're:')) AS pers FROM r JOIN messages USING (doc_id)),
n AS (SELECT query_id, count(*) AS total, count(*) FILTER (junk) AS junk, count(*) FILTER (pers AND NOT junk) AS personal FROM x GROUP BY 1)
SELECT *, CASE WHEN junk / total > 0.7 THEN 'mostly_automated' WHEN junk / total > 0.4 THEN 'mixed' WHEN personal > 3 THEN 'personal' ELSE 'standard' END AS mix FROM n""")
def _(t):
    d, text = corpus(t)
    hits = E.tfidf_search(d, passages(t), 25, "log", text).join(messages(t).select("doc_id", "sender", "subject"), "doc_id")
    return R.content_mix(hits, ["src1"], ["the "], ["src2"])


@query("message_signals_C7", f"""WITH {S.MESSAGES}, x AS (SELECT doc_id, {S.fold("lower(subject || ' ' || body)")} AS t, hour(date_sent) AS h FROM messages)
{' UNION ALL '.join(f"SELECT doc_id, '{n}' AS signal FROM x WHERE regexp_matches(t, '{r}')" for n, r in R.SIGNALS)} UNION ALL SELECT doc_id, 'out_of_hours' FROM x WHERE h >= 22 OR h < 6""")
def _(t):
    return R.message_signals(messages(t))
