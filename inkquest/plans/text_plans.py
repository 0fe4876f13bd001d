"""Text functions over whole tables (survey rows B1-B23)."""

from pyspark.sql import functions as F

from ..functions import text as X, wordlists as W
from . import sqltext as S
from .registry import query

# ---- B1
@query("tokenize_variants_B1", rf"""
SELECT doc_id, array_to_string({S.tok('text')}, ' ') AS index_tokens,
  array_to_string(list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda t: length(t) > 2), ' ') AS cased_tokens,
  array_to_string({S.words('text')}, ' ') AS word_tokens, array_to_string({S.qwords('text')}, ' ') AS query_tokens
FROM documents""")
def _(t):
    return t("documents").select("doc_id", *[
        F.array_join(X.tokenize("text", v), " ").alias(n) for v, n in
        (("index", "index_tokens"), ("cased", "cased_tokens"), ("words", "word_tokens"), ("query", "query_tokens"))])


# ---- B2, B3
@query("normalize_text_B2", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def _(t):
    return t("documents").select("doc_id", X.normalize_text("text").alias("norm"))


@query("normalize_name_B3", r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9\s]', '', 'g')) AS stripped,
       lower(trim(p_name)) AS plain FROM part""")
def _(t):
    label = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t("part").select("p_partkey", X.normalize_name(label).alias("stripped"),
                            X.normalize_name("p_name", "plain").alias("plain"))


# ---- B4: every turn against the turn before it
@query("token_jaccard_B4", rf"""
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
k AS (SELECT conv_id, turn, list_distinct({S.tok('text')}) AS a, list_distinct({S.tok('nxt')}) AS b FROM p WHERE nxt IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE
  ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS jaccard FROM k""")
def _(t):
    # a turn and its successor meet by an equi-join, so a long conversation is no hot window
    c = t("conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("nxt"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(X.token_jaccard("text", "nxt"), 9).alias("jaccard"))


# ---- B5
@query("content_key_groups_B5", "SELECT count(DISTINCT text) AS distinct_texts, count(*) AS n FROM documents")
def _(t):
    by_key = t("documents").groupBy(X.content_key("text").alias("k")).agg(F.count("*").alias("c"))
    return by_key.agg(F.count("*").alias("distinct_texts"), F.sum("c").alias("n"))


# ---- B6
_NUM = r"(\d[\d,]*(?:\.\d+)?)\s*(?:([KkMmBb](?:illion)?|USD|EUR)\b|(%))?"
_NUM_LOOSE = r"(\d[\d,]*(?:\.\d+)?)\s*(?:([KkMmBb](?:illion)?|USD|EUR)|(%))?"


def _num_sql(regex, mode):
    ex = lambda i: f"regexp_extract_all({S.fold('text')}, '{regex}', {i})"
    return f"""SELECT doc_id, '{mode}' AS mode, v.n AS ordinal, round(try_cast(replace(v.a, ',', '') AS DOUBLE) *
      CASE lower(left(coalesce(v.b, ''), 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END, 4) AS value, coalesce(v.b, '') || coalesce(v.c, '') AS unit
    FROM (SELECT doc_id, unnest(list_transform({ex(1)}, lambda x, i: {{'n': i, 'a': x, 'b': {ex(2)}[i], 'c': {ex(3)}[i]}})) AS v
          FROM documents)"""


@query("numeric_values_B6", _num_sql(_NUM, "strict") + " UNION ALL " + _num_sql(_NUM_LOOSE, "loose"))
def _(t):
    d = t("documents")
    def one(strict, mode):
        return d.select("doc_id", F.lit(mode).alias("mode"), F.posexplode(X.numeric_values("text", strict))).select(
            "doc_id", "mode", (F.col("pos") + 1).cast("bigint").alias("ordinal"),
            F.round("col.value", 4).alias("value"), F.col("col.unit").alias("unit"))
    return one(True, "strict").unionByName(one(False, "loose"))


# ---- B7, A19
@query("clean_pages_B7_A19", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\{[^}]*\}', ' ', 'g'), '\s+', ' ', 'g')) AS body,
  length(regexp_replace(html, '[^a-zA-Z0-9_\s]', '', 'g')) AS plain_chars, length(regexp_replace(html, '[0-9]+', '', 'g')) AS no_digits,
  replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS url_html,
  regexp_replace(chr(27) || '[1m' || url || chr(27) || '[0m', '\x1b\[[0-9;]*[a-zA-Z]', '', 'g') AS url_plain FROM pages""")
def _(t):
    esc = F.lit("\x1b")
    return t("pages").select(
        "page_id", X.strip_markup("html").alias("body"),
        F.length(X.strip_punctuation("html")).cast("bigint").alias("plain_chars"),
        F.length(X.strip_digits("html")).cast("bigint").alias("no_digits"),
        X.escape_html("url").alias("url_html"),
        X.strip_ansi(F.concat(esc, F.lit("[1m"), "url", esc, F.lit("[0m"))).alias("url_plain"))


# ---- B8
@query("text_stats_B8", rf"""
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS a, {S.words('text')} AS b,
  list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '') AS s FROM documents)
SELECT doc_id, 'split' AS variant, length(text) AS chars, len(a) AS words, len(s) AS sentences, len(list_distinct(a)) AS unique_words,
  CASE WHEN len(a) > 0 THEN round(list_sum(list_transform(a, lambda t: length(t)))::DOUBLE / len(a), 6) ELSE 0 END AS avg_word_length,
  CASE WHEN len(a) > 0 THEN round(len(list_distinct(a))::DOUBLE / len(a), 6) ELSE 0 END AS lexical_diversity FROM w
UNION ALL
SELECT doc_id, 'tokens', length(text), len(b), greatest(len(regexp_extract_all(text, '[.!?]')), 1), len(list_distinct(b)),
  CASE WHEN len(b) > 0 THEN round(list_sum(list_transform(b, lambda t: length(t)))::DOUBLE / len(b), 6) ELSE 0 END,
  CASE WHEN len(b) > 0 THEN round(len(list_distinct(b))::DOUBLE / len(b), 6) ELSE 0 END FROM w""")
def _(t):
    d = t("documents")
    def one(v):
        return d.select("doc_id", F.lit(v).alias("variant"), X.text_stats("text", v).alias("s")).select(
            "doc_id", "variant", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("chars", "words", "sentences", "unique_words")],
            F.round("s.avg_word_length", 6).alias("avg_word_length"),
            F.round("s.lexical_diversity", 6).alias("lexical_diversity"))
    return one("split").unionByName(one("tokens"))


# ---- B9, B10
@query("top_keywords_B9", rf"""
WITH k AS (SELECT doc_id, list_filter({S.words('text')}, lambda t: length(t) > 2 AND NOT list_contains({S.KEYWORD_STOP}, t)) AS ks,
   len({S.words('text')}) AS n FROM documents),
e AS (SELECT doc_id, n, unnest(ks) AS term FROM k), c AS (SELECT doc_id, n, term, count(*) AS cnt FROM e GROUP BY ALL)
SELECT doc_id, term, cnt, round(cnt::DOUBLE / n, 6) AS tf, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, term) AS rn FROM c) WHERE rn <= 20""")
def _(t):
    from ..operators.terms import top_keywords
    return top_keywords(t("documents"), k=20).select(
        "doc_id", "term", "cnt", F.round("tf", 6).alias("tf"), F.col("rank").cast("bigint").alias("rank"))


@query("ngram_counts_B10", rf"""
WITH w AS (SELECT {S.words('text')} AS b FROM documents)
SELECT g AS ngram, count(*) AS cnt FROM (
  SELECT unnest(list_transform(b[:len(b) - 1], lambda x, i: x || ' ' || b[i + 1])) AS g FROM w WHERE len(b) >= 2) GROUP BY 1""")
def _(t):
    from ..operators.terms import ngram_counts
    return ngram_counts(t("documents"), n=2)


# ---- B11: frequency in each document of the part-name words
@query("term_frequency_B11", rf"""
SELECT doc_id, CASE WHEN len(b) > 0 THEN round(len(list_filter(b, lambda t: t = 'the'))::DOUBLE / len(b), 9) ELSE 0 END AS tf
FROM (SELECT doc_id, {S.words('text')} AS b FROM documents)""")
def _(t):
    return t("documents").select("doc_id", F.round(X.term_frequency("text", "The"), 9).alias("tf"))


# ---- B12
def _presence(c, marks):
    return "(" + " + ".join(f"contains({c}, ' {m} ')::INT" for m in marks) + ")"


_FR_STOP, _EN_STOP = W.FRENCH_PRESENCE, W.ENGLISH_PRESENCE
@query("detect_language_B12", rf"""
WITH p AS (SELECT doc_id, lang AS labelled, ' ' || lower(text) || ' ' AS pad,
   list_distinct(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS w, {S.words('text')} AS b FROM documents)
SELECT doc_id, labelled,
  CASE WHEN len(list_intersect(w, {S.lst(W.FRENCH_MARKERS)})) >= 2 THEN 'fr'
       WHEN len(list_intersect(w, {S.lst(W.SPANISH_MARKERS)})) >= 2 THEN 'es' ELSE 'en' END AS by_markers,
  CASE WHEN {_presence('pad', W.FRENCH_PRESENCE)} > {_presence('pad', W.ENGLISH_PRESENCE)} THEN 'fr' ELSE 'en' END AS by_presence,
  CASE WHEN len(list_filter(b, lambda t: list_contains({S.lst(_FR_STOP)}, t))) > len(list_filter(b, lambda t: list_contains({S.lst(_EN_STOP)}, t)))
       THEN 'fr' ELSE 'en' END AS by_frequency FROM p""")
def _(t):
    return t("documents").select(
        "doc_id", F.col("lang").alias("labelled"), X.language_by_markers("text").alias("by_markers"),
        X.language_by_presence("text").alias("by_presence"),
        X.language_by_frequency("text", (("fr", _FR_STOP), ("en", _EN_STOP))).alias("by_frequency"))


# ---- B13, B14
def _terms_sql(c, limit, filter_caps=True):
    f = S.fold(c)
    caps = f"regexp_extract_all({f}, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)\\b', 1)"
    if filter_caps:
        caps = f"list_filter({caps}, lambda t: NOT list_contains({S.QUERY_STOP}, lower(t)))"
    wd = f"list_filter(regexp_extract_all(lower({f}), '\\b([a-z]{{4,}})\\b', 1), lambda t: NOT list_contains({S.QUERY_STOP}, t))"
    return f"list_concat(list_concat(regexp_extract_all({f}, '\"([^\"]+)\"', 1), {caps}), {wd})"


@query("search_terms_B13", rf"""
WITH f AS (SELECT conv_id, turn, {_terms_sql('text', 5)} AS a, {_terms_sql('text', 8, False)} AS b FROM conversations),
l AS (SELECT *, list_transform(a, lambda t: lower(t)) AS la, list_transform(b, lambda t: lower(t)) AS lb FROM f)
SELECT conv_id, turn, array_to_string(list_filter(a, lambda t, i: list_position(la, lower(t)) = i)[:5], '|') AS terms,
  array_to_string(list_filter(b, lambda t, i: list_position(lb, lower(t)) = i)[:8], '|') AS terms_long FROM l""")
def _(t):
    return t("conversations").select(
        "conv_id", "turn", F.array_join(X.search_terms("text"), "|").alias("terms"),
        F.array_join(X.search_terms("text", 8, filter_capitals=False), "|").alias("terms_long"))


@query("query_keywords_B14", rf"""
WITH w AS (SELECT conv_id, turn, {S.qwords('text')} AS q FROM conversations),
k AS (SELECT *, list_filter(q, lambda t: NOT list_contains({S.KEYWORD_STOP}, t)) AS kept FROM w)
SELECT conv_id, turn, array_to_string(CASE WHEN len(kept) > 0 THEN kept[:5] ELSE q[:3] END, ' ') AS keywords FROM k""")
def _(t):
    return t("conversations").select("conv_id", "turn", F.array_join(X.query_keywords("text"), " ").alias("keywords"))


# ---- B15
_ENT = """list_sum(list_transform(list_distinct(string_split(text, '')), lambda c:
  -((length(text) - length(replace(text, c, '')))::DOUBLE / length(text)) * log2((length(text) - length(replace(text, c, '')))::DOUBLE / length(text))))"""
@query("text_entropy_B15", f"""
WITH e AS (SELECT doc_id, text, CASE WHEN text = '' THEN 0 ELSE {_ENT} END AS h, len(list_distinct(string_split(text, ''))) AS d FROM documents)
SELECT doc_id, round(h, 6) AS entropy, h > 7.5 AS is_anomalous,
 round(CASE WHEN text = '' THEN 0 ELSE (0.7 * h / CASE WHEN d > 1 THEN log2(d) ELSE 1 END + 0.3 * d / length(text)) * 100 END, 4) AS uniqueness FROM e""")
def _(t):
    h = X.char_entropy("text")
    return t.text("documents", "doc_id").select("doc_id", F.round(h, 6).alias("entropy"), (h > 7.5).alias("is_anomalous"),
                                 F.round(X.uniqueness_score("text"), 4).alias("uniqueness"))


@query("byte_entropy_B15")
def _(t):
    from ..operators.attachments import byte_entropy
    return t("pages").select("page_id", F.round(byte_entropy(F.encode("html", "UTF-8")), 6).alias("entropy"))


# ---- B16
def _title_sql():
    cut = " ".join(f"WHEN starts_with(lower(m), {S.lst([s])[1:-1]}) THEN substring(m, {len(s) + 1})" for s in W.TITLE_STARTERS)
    return f"""
WITH f AS (SELECT conv_id, trim(text) AS m FROM conversations WHERE turn = 0), c AS (SELECT conv_id, CASE {cut} ELSE m END AS m FROM f),
u AS (SELECT conv_id, CASE WHEN left(m, 1) = 'ß' THEN 'SS' ELSE upper(left(m, 1)) END || substring(m, 2) AS m FROM c)
SELECT conv_id, CASE WHEN m = '' THEN 'New Chat' WHEN length(m) > 50 THEN left(m, 47) || '...' ELSE m END AS title FROM u"""
@query("conversation_title_B16", _title_sql())
def _(t):
    return t("conversations").where("turn = 0").select("conv_id", X.conversation_title("text").alias("title"))


# ---- B17
@query("snippets_B17", rf"""
SELECT doc_id, left(text, 150) AS head, CASE WHEN length(c) > 200 THEN left(c, 197) || '...' ELSE c END AS excerpt FROM (
 SELECT doc_id, text, trim(regexp_replace(replace(text, '**', ''), '\s+', ' ', 'g')) AS c FROM documents)""")
def _(t):
    return t("documents").select("doc_id", X.snippet("text", 150).alias("head"), X.clean_excerpt("text", 200).alias("excerpt"))


@query("hit_window_B17")
def _(t):
    from ..operators.terms import query_windows
    return query_windows(t.text("documents", "doc_id"), t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


# ---- B18, B19
def _fuzzy_sql(c):
    month = " ".join(f"WHEN contains(lower({c}), '{m}') THEN '{n}'" for m, n in W.MONTHS)
    day = f"try_cast(regexp_extract({c}, '\\b([0-3]?[0-9])\\b', 1) AS INTEGER)"
    return f"""CASE WHEN regexp_extract({c}, '(20[0-2][0-9]|19[0-9][0-9])', 1) <> '' THEN regexp_extract({c}, '(20[0-2][0-9]|19[0-9][0-9])', 1)
      || '-' || CASE {month} ELSE '06' END || '-' || CASE WHEN {day} BETWEEN 1 AND 31 THEN lpad(CAST({day} AS VARCHAR), 2, '0') ELSE '15' END END"""


@query("fuzzy_date_B18", f"""
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderpriority || ' seen ' || strftime(o_orderdate, '%-d %B %Y')
  WHEN 'O' THEN 'filed ' || strftime(o_orderdate, '%B %Y') ELSE 'in ' || strftime(o_orderdate, '%Y') END AS s FROM orders)
SELECT o_orderkey, {_fuzzy_sql('s')} AS guessed FROM x""")
def _(t):
    s = (F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit(" seen "), F.date_format("o_orderdate", "d MMMM yyyy")))
         .when(F.col("o_orderstatus") == "O", F.concat(F.lit("filed "), F.date_format("o_orderdate", "MMMM yyyy")))
         .otherwise(F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"))))
    return t("orders").select("o_orderkey", X.fuzzy_date(s).alias("guessed"))


@query("mixed_precision_date_B19", """
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y') WHEN 'P' THEN strftime(o_orderdate, '%Y-%m')
   ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderkey, CASE length(s) WHEN 4 THEN 'year' WHEN 7 THEN 'month' ELSE 'day' END AS "precision",
  try_cast(CASE length(s) WHEN 4 THEN s || '-01-01' WHEN 7 THEN s || '-01' ELSE s END AS DATE) AS sort_date FROM x""")
def _(t):
    s = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy"))
         .when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return t("orders").select("o_orderkey", X.mixed_date(s).alias("m")).select(
        "o_orderkey", F.col("m.precision").alias("precision"), F.col("m.date").alias("sort_date"))


# ---- B20
@query("email_domains_B20", rf"""
WITH {S.MESSAGES} SELECT lower(split_part(sender, '@', 2)) AS domain, count(*) AS n, count(DISTINCT lower(split_part(sender, '@', 1))) AS locals
FROM messages WHERE NOT list_contains({S.lst(W.GENERIC_MAIL_DOMAINS)}, lower(split_part(sender, '@', 2))) GROUP BY 1""")
def _(t):
    from .inputs import messages
    m = messages(t).where(~X.is_generic_domain("sender"))
    pairs = m.groupBy(X.email_domain("sender").alias("domain"), X.email_local("sender").alias("local")).agg(F.count("*").alias("c"))
    return pairs.groupBy("domain").agg(F.sum("c").alias("n"), F.count("*").alias("locals"))


# ---- B21
_has = lambda *s: "(" + " OR ".join(f"contains(l, '{x}')" for x in s) + ")"
@query("query_intent_B21", rf"""
WITH q AS (SELECT conv_id, turn, lower(text) AS l, trim(lower(text)) AS p FROM conversations),
w AS (SELECT *, list_filter(string_split_regex(l, '\s+'), lambda t: length(t) > 2 AND NOT list_contains({S.lst(W.SUBJECT_SKIP)}, t)) AS ws FROM q)
SELECT conv_id, turn, {' OR '.join(f"p = '{g}' OR starts_with(p, '{g} ')" for g in W.GREETINGS)} AS is_greeting,
  {_has('who', 'qui')} AS is_who, {_has('what', 'quoi', 'quel')} AS is_what, {_has('connection', 'associate', 'lien')} AS is_connection,
  CASE WHEN {_has(*W.HIGH_PRIORITY)} THEN 'high' ELSE 'normal' END AS priority,
  CASE WHEN {_has(*W.HIGH_PRIORITY)} THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
  CASE WHEN len(ws) = 0 THEN 'this topic' ELSE array_to_string(list_transform(ws[:3], lambda t: CASE WHEN left(t, 1) = 'ß' THEN 'ß' ELSE upper(left(t, 1)) END || substring(t, 2)), ' ') END AS subject FROM w""")
def _(t):
    return t("conversations").select("conv_id", "turn", X.query_intent("text").alias("i")).select("conv_id", "turn", "i.*")


# ---- B23
@query("json_scalars_B23", """
SELECT event_id, props ->> '$.k' AS k, try_cast(props ->> '$.k' AS BIGINT) > 50 AS high FROM events""")
def _(t):
    k = X.json_text("props", "k")
    return t("events").select("event_id", k.alias("k"), (k.try_cast("bigint") > 50).alias("high"))


@query("json_merge_B23", """
SELECT event_id, props ->> '$.k' AS k, event_type AS kind, CAST(user_id AS VARCHAR) AS usr FROM events""")
def _(t):
    old = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("usr"), F.col("user_id").cast("string"))
    e = t("events").select("event_id", old.alias("o"), new.alias("n"))
    m = e.select("event_id", X.map_merge("o", "n").alias("m"))
    return m.select("event_id", *[F.col("m")[k].alias(k) for k in ("k", "kind", "usr")])


@query("role_accounts_B20", rf"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Info@' WHEN 1 THEN 'bob@' ELSE source || '@' END || lang || '.example' AS sender FROM documents)
SELECT doc_id, (list_contains({S.lst(W.ROLE_LOCALS)}, lower(split_part(sender, '@', 1))) OR length(split_part(sender, '@', 1)) < 4) AS is_role FROM p""")
def _(t):
    k = F.col("doc_id") % 4
    sender = F.concat(F.when(k == 0, "Info@").when(k == 1, "bob@").otherwise(F.concat("source", F.lit("@"))), "lang", F.lit(".example"))
    return t("documents").select("doc_id", X.is_role_account(sender).alias("is_role"))
