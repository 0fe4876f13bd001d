"""Extraction over whole tables (survey rows D1-D15, B22, C8)."""

from pyspark.sql import functions as F

from ..functions import patterns as P, table_functions
from ..operators import extract as D
from . import sqltext as S
from .registry import query


def q(s):
    return s.replace("'", "''")


def _values(pats, src="documents", id_="doc_id", text="text"):
    """SQL: one row per (id, pattern, ordinal, value) for a list of patterns."""
    rows = " UNION ALL ".join(
        f"SELECT {id_}, '{p.name}' AS pattern, '{p.category}' AS category, {str(p.sensitive).lower()} AS sensitive, "
        f"CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS ordinal, unnest(m) AS value FROM "
        f"(SELECT {id_}, regexp_extract_all(f, '{q(p.regex)}') AS m FROM folded)" for p in pats)
    return f"folded AS (SELECT {id_}, {S.fold(text)} AS f FROM {src}), v AS ({rows})"


def _spans(pats, src="documents", id_="doc_id", text="text"):
    """SQL: matches with offsets from the lengths of the pieces between them."""
    rows = " UNION ALL ".join(
        f"""SELECT {id_}, f, '{p.name}' AS pattern, unnest(list_transform(m, lambda x, i: {{'v': x,
         's': list_sum(list_transform(g[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0)}})) AS z
        FROM (SELECT {id_}, f, regexp_extract_all(f, '{q(p.regex)}') AS m, string_split_regex(f, '{q(p.regex)}') AS g FROM folded)"""
        for p in pats)
    return (f"folded AS (SELECT {id_}, {S.fold(text)} AS f FROM {src}), sp AS (SELECT {id_}, f, pattern, z.v AS value, "
            f"CAST(z.s AS INTEGER) AS start, CAST(z.s + length(z.v) AS INTEGER) AS \"end\" FROM ({rows}))")


_ORDER_TEXT = """(SELECT o_orderkey, 'Paid $' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' on ' || strftime(o_orderdate, '%Y-%m-%d')
  || ' to Acme ' || o_orderpriority || ' Ltd, about 5 million dollars by John Smith at j.smith@example.com' AS text FROM orders)"""


def order_text(t):
    return t("orders").select("o_orderkey", F.concat(
        F.lit("Paid $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" to Acme "), "o_orderpriority", F.lit(" Ltd, about 5 million dollars by John Smith at j.smith@example.com")).alias("text"))


@query("pattern_values_D1", f"WITH {_values(P.REGISTRY)} SELECT doc_id, pattern, category, sensitive, ordinal, value FROM v")
def _(t):
    return D.extract_values(t.text("documents", "doc_id"))


_SPAN_PATS = P.REGISTRY
@query("extract_spans_D2", f"""WITH {_spans(_SPAN_PATS)} SELECT doc_id, pattern, value, start, "end",
  substring(f, greatest(start - 50, 0) + 1, "end" - greatest(start - 50, 0) + 50) AS context FROM sp""")
def _(t):
    folded = t.text("documents", "doc_id").select("doc_id", P.ascii_fold("text").alias("text"))
    return D.extract_spans(folded, _SPAN_PATS).select("doc_id", "pattern", "value", "start", "end", "context")


@query("extract_spans_sql_D2", f"""WITH {_spans(_SPAN_PATS)} SELECT doc_id, pattern, value, start, "end",
  substring(f, greatest(start - 50, 0) + 1, "end" - greatest(start - 50, 0) + 50) AS context FROM sp""")
def _(t):
    table_functions.register(t.spark)
    folded = t.text("documents", "doc_id").select("doc_id", P.ascii_fold("text").alias("text"))
    return t.spark.sql("SELECT doc_id, s.pattern, s.value, s.start, s.end, s.context FROM {folded}, LATERAL extract_spans(text) AS s", folded=folded)


_SENS = P.select_patterns(sensitive=True)
@query("redact_sensitive_D3", f"""WITH {_values(_SENS)} SELECT d.doc_id, true AS same_length,
  d.doc_id IN (SELECT doc_id FROM v) AS changed FROM documents d""")
def _(t):
    r = D.redact(t.text("documents", "doc_id"))
    return r.select("doc_id", (F.length("redacted") == F.length("text")).alias("same_length"),
                    (F.col("redacted") != F.col("text")).alias("changed"))


@query("pattern_report_D4", f"""WITH {_values(P.REGISTRY)}, d AS (SELECT pattern, value, count(*) AS n FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY value) AS rn FROM d)
SELECT pattern, CAST(sum(n) AS BIGINT) AS matches, count(*) AS distinct_values, string_agg(value, '|' ORDER BY value) FILTER (rn <= 20) AS sample FROM r GROUP BY 1""")
def _(t):
    return D.pattern_report(D.extract_values(t.text("documents", "doc_id")))


@query("sensitive_report_D4", f"""WITH {_values(_SENS)}, d AS (SELECT pattern, value, count(*) AS n FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY value) AS rn FROM d)
SELECT pattern, CAST(sum(n) AS BIGINT) AS matches, count(*) AS distinct_values, string_agg(value, '|' ORDER BY value) FILTER (rn <= 20) AS sample FROM r GROUP BY 1""")
def _(t):
    return D.pattern_report(D.extract_values(t.text("documents", "doc_id"), _SENS))


def _typed_sql(src, id_, types=None):
    ps = D.kind_patterns(types)
    sel = " UNION ALL ".join(
        f"SELECT {id_}, '{k}' AS kind, {i} AS ord, CAST(generate_subscripts(m, 1) AS INTEGER) AS pos, unnest(m) AS value FROM "
        f"(SELECT {id_}, regexp_extract_all(f, '{q(p.regex)}') AS m FROM folded)" for k, i, p in ps)
    stop = " OR ".join(f"contains(lower(value), '{w}')" for w in D.PERSON_STOP)
    return f"""WITH folded AS (SELECT {id_}, {S.fold('text')} AS f FROM {src}), v AS ({sel}),
ok AS (SELECT * FROM v WHERE NOT (kind = 'person' AND ({stop})) AND (kind <> 'organization' OR length(value) > 3 OR list_contains({S.lst(D.KNOWN_ACRONYMS)}, value)))
SELECT {id_}, kind, arg_min(value, ord * 1000000 + pos) AS value FROM ok
GROUP BY {id_}, kind, CASE WHEN list_contains({S.lst(D.DEDUPED_KINDS)}, kind) THEN lower(value) ELSE pos || ':' || value END"""


@query("typed_entities_D5_D7", _typed_sql("documents", "doc_id"))
def _(t):
    folded = t.text("documents", "doc_id").select("doc_id", P.ascii_fold("text").alias("text"))
    return D.typed_entities(folded).select("doc_id", "kind", "value")


@query("typed_entities_orders_D5", _typed_sql(_ORDER_TEXT, "o_orderkey"))
def _(t):
    return D.typed_entities(order_text(t), id_col="o_orderkey").select("o_orderkey", "kind", "value")


@query("amount_values_D6", r"""
WITH a AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 'O' THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || ' thousand dollars' ELSE '$' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || 'M' END AS s FROM orders),
c AS (SELECT o_orderkey, translate(s, ',$€£', '') AS c FROM a)
SELECT o_orderkey, round(CAST(regexp_extract(c, '(\d+(?:\.\d+)?)', 1) AS DOUBLE) * CASE regexp_extract(lower(c), '\d\s*(million|billion|thousand|m\b|b\b|k\b)', 1)
   WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 ELSE 1 END, 2) AS exact_value,
 round(CASE WHEN contains(c, 'M') THEN 1e6 ELSE 1 END * coalesce(try_cast(split_part(trim(c), ' ', 1) AS DOUBLE), 0), 2) AS plain_value FROM c""")
def _(t):
    dec = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    # the SQL twin rounds half to even on the cast, Spark truncates: round first
    whole = F.bround("o_totalprice", 0).cast("bigint").cast("string")
    s = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), dec))
         .when(F.col("o_orderstatus") == "O", F.concat(whole, F.lit(" thousand dollars")))
         .otherwise(F.concat(F.lit("$"), whole, F.lit("M"))))
    a = t("orders").select("o_orderkey", s.alias("s"))
    return a.select("o_orderkey", F.round(D.amount_value("s"), 2).alias("exact_value"),
                    F.round(D.amount_value("s", "plain"), 2).alias("plain_value"))


_COMPACT_SQL = f"""{_values(D.COMPACT)}, kept AS (SELECT doc_id, pattern, ordinal, CASE WHEN pattern = 'email' THEN lower(value) ELSE value END AS value FROM v
 WHERE NOT (pattern = 'person' AND list_contains({S.lst(D.NOT_PERSONS)}, lower(value))) AND NOT (pattern = 'amount' AND length(value) <= 3)),
ce AS (SELECT doc_id, pattern AS kind, arg_min(value, ordinal) AS value FROM kept
  GROUP BY doc_id, pattern, CASE pattern WHEN 'person' THEN lower(value) WHEN 'date' THEN CAST(ordinal AS VARCHAR) ELSE value END)"""


@query("compact_entities_D8_D9", f"WITH {_COMPACT_SQL} SELECT doc_id, kind, value FROM ce")
def _(t):
    return D.compact_entities(t.text("documents", "doc_id"))


@query("merge_entities_D10", f"""WITH {_COMPACT_SQL}, one AS (SELECT doc_id, kind, lower(value) AS k, min(value) AS value FROM ce WHERE length(value) >= 3 GROUP BY ALL)
SELECT doc_id, kind, value, 0.75::DOUBLE AS confidence FROM one""")
def _(t):
    c = D.compact_entities(t.text("documents", "doc_id"))
    return D.merge_entities(c.where("kind <> 'person'"), c)


@query("mention_counts_D11", f"""WITH {_COMPACT_SQL} SELECT lower(value) AS name, kind, min(value) AS shown, count(*) AS mentions
 FROM ce WHERE length(value) >= 3 GROUP BY 1, 2""")
def _(t):
    return D.mention_counts(D.compact_entities(t.text("documents", "doc_id")))


@query("kind_counts_D12", f"""SELECT doc_id, {', '.join(f"len(regexp_extract_all({S.fold('text')}, '{q(p.regex)}')) AS n_{p.name}" for p in D.COMPACT)} FROM documents""")
def _(t):
    return D.kind_counts(t.text("documents", "doc_id"))


_NEAR = [P.Pattern("email", D.COMPACT[4].regex, "c", 1.0), P.Pattern("person", D.COMPACT[0].regex, "c", 1.0),
         P.Pattern("ip", P.select_patterns(["ip_address"])[0].regex, "c", 1.0), P.Pattern("hex", r"\b[0-9a-fA-F]{16,}\b", "c", 1.0)]
_REL = " ".join(f"WHEN regexp_matches(lower(c), '{q(r)}') THEN '{n}'" for n, r in D.RELATIONS)


@query("proximity_relations_D13", rf"""WITH {_spans(_NEAR)}, s AS (SELECT DISTINCT doc_id, f, pattern, value, start, "end" FROM sp),
p AS (SELECT a.doc_id, a.pattern AS from_type, a.value AS from_value, a.start AS from_start, b.pattern AS to_type, b.value AS to_value, b.start AS to_start,
  b.start - a."end" AS distance, regexp_replace(substring(a.f, a."end" + 1, b.start - a."end"), '^\s+|\s+$', '', 'g') AS c
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.start - a."end" BETWEEN 1 AND 200)
SELECT doc_id, from_type, from_value, from_start, to_type, to_value, to_start, distance,
  CASE {_REL} ELSE 'associated_with' END AS relationship, left(c, 50) AS context FROM p
WHERE CASE {_REL} WHEN length(c) < 50 THEN 'associated_with' END IS NOT NULL""")
def _(t):
    return D.proximity_relations(t.text("documents", "doc_id"), _NEAR)


@query("encoded_tokens_D14", f"""WITH {_values([P.Pattern(n, r, 'e', 1.0) for n, r, _ in D.ENCODED])},
c AS (SELECT doc_id, pattern, value, count(*) AS n FROM v GROUP BY doc_id, pattern, value)
SELECT doc_id, pattern, value, n FROM c WHERE pattern IN ('base64', 'hex') OR (pattern = 'alphanumeric_code' AND n > 2)
 OR (pattern = 'recurring_amount' AND n > 3)""")
def _(t):
    return D.encoded_tokens(t.text("documents", "doc_id"))


@query("amount_anomalies_D15", """
WITH c AS (SELECT l_suppkey AS grp, l_quantity * 20 AS amount, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT grp, amount, lead(amount, 1) OVER w - amount AS d1, lead(amount, 2) OVER w - lead(amount, 1) OVER w AS d2 FROM c WINDOW w AS (PARTITION BY grp ORDER BY amount))
SELECT grp, 'recurring' AS kind, amount, n::DOUBLE AS detail FROM c WHERE n > 2
UNION ALL SELECT grp, 'round', amount, CASE WHEN amount % 1000 = 0 THEN 1000 WHEN amount % 500 = 0 THEN 500 ELSE 100 END::DOUBLE FROM c WHERE amount >= 100 AND amount % 100 = 0
UNION ALL SELECT grp, 'sequence', amount, round(d1, 6) FROM s WHERE abs(d1 - d2) < 0.01 AND d1 > 0""")
def _(t):
    li = t("lineitem").select("l_suppkey", (F.col("l_quantity") * 20).alias("amount"))
    return D.amount_anomalies(li, "l_suppkey", "amount")


@query("code_words_C8", rf"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all({S.fold('text')}, '\b[A-Z][A-Za-z]+\b')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT doc_id, word, n AS frequency, CASE WHEN upper(word) IN ('THE', 'LES', 'DIE') THEN 40 ELSE 0 END + CASE WHEN n > 5 THEN least(n * 2, 30) ELSE 0 END AS suspicion FROM c)
SELECT doc_id, word, frequency, suspicion FROM s WHERE suspicion > 30""")
def _(t):
    return D.code_words(t.text("documents", "doc_id"), ["the", "les", "die"], with_position=False)


@query("code_words_positions_C8")
def _(t):
    return D.code_words(t.text("documents", "doc_id"), ["the", "les", "die"])


@query("highlight_entities_B22")
def _(t):
    return t.text("documents", "doc_id").select("doc_id", P.highlight_spans("text", P.all_spans("text", D.COMPACT, 0)).alias("html"))


@query("entity_totals_D10", f"""WITH {_COMPACT_SQL}, one AS (SELECT doc_id, kind, lower(value) AS k FROM ce WHERE length(value) >= 3 GROUP BY ALL), n AS (SELECT doc_id, kind, count(*) AS n FROM one GROUP BY 1, 2)
SELECT doc_id, kind, n, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM n""")
def _(t):
    return D.entity_totals(D.merge_entities(D.compact_entities(t.text("documents", "doc_id"))))
