"""Rollups, cases, sessions and joins over whole tables (survey rows F4-F11, G1-G20, H11, W3, S1, S2)."""

from pyspark.sql import functions as F

from ..operators import extract as D, reports as R, search as E
from . import sqltext as S
from .extract_plans import _COMPACT_SQL
from .graph_plans import GRAPH, edges, nodes
from .inputs import messages, passages, scores
from .registry import query
from .search_plans import base, corpus, topk


# ---- joins
@query("messages_of_node_F4", f"""WITH {S.MESSAGES}, k AS (SELECT lower(sender) AS w FROM messages WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION SELECT 'src3@src3.example')
SELECT doc_id FROM messages WHERE lower(sender) IN (FROM k)""")
def _(t):
    m = messages(t)
    names = t.spark.createDataFrame([(1, "SRC3@src3.example")], "node_id long, name string")
    alias = m.join(t("labels").where("toxic = 1"), "doc_id", "left_semi").select(F.lit(1).cast("long").alias("canonical_id"), F.col("sender").alias("alias")).distinct()
    return R.messages_of_node(m, names, alias).select("doc_id")


@query("mention_join_F5", f"""WITH {S.MESSAGES}, {_COMPACT_SQL} SELECT m.doc_id, date_sent, kind, value FROM messages m JOIN ce ON ce.doc_id = m.doc_id WHERE value ILIKE '%e%'""")
def _(t):
    n = D.compact_entities(t.text("documents", "doc_id")).select(F.col("doc_id").alias("source_id"), "kind", F.col("value").alias("name"))
    return R.mentions(messages(t), n, "%e%").select("doc_id", "date_sent", "kind", F.col("name").alias("value"))


@query("events_in_range_F6", """WITH b AS (SELECT c_custkey AS query_id, min(o_orderdate) AS lo, min(o_orderdate) + INTERVAL 60 DAY AS hi, any_value(c_name) AS subject FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
e AS (SELECT o_orderkey AS event_id, o_orderdate AS event_at, c_name FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT query_id, event_id, event_at FROM b JOIN e ON event_at BETWEEN lo AND hi UNION SELECT query_id, event_id, event_at FROM b JOIN e ON subject = c_name)
SELECT query_id, event_id, event_at, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY event_at, event_id) AS INTEGER) AS rank FROM m) WHERE rank <= 10""")
def _(t):
    oc = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    lo = F.min("o_orderdate")
    b = oc.groupBy(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("subject")).agg(lo.alias("lo")).withColumn("hi", F.expr("lo + INTERVAL 60 DAYS"))
    e = oc.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("at"), F.array("c_name").alias("people"))
    return R.events_in_range(b, e).withColumnRenamed("at", "event_at")


@query("array_overlap_F10", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS tags FROM lineitem GROUP BY 1 HAVING list_has_any(list(DISTINCT l_returnflag || l_linestatus), ['RF', 'NO'])")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("tags"))
    return R.overlapping(g, "tags", ["RF", "NO"]).select("l_orderkey", F.array_join("tags", ",").alias("tags"))


@query("entity_links_F11", "SELECT o_orderkey AS doi, upper(c_name) AS author, c_custkey * 2 AS node_id, 'same_person' AS link, 0.9::DOUBLE AS confidence FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    p = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("doi"), F.upper("c_name").alias("author"))
    return R.entity_links(p, nodes(t).where("type = 'person'"))


# ---- statistics
@query("corpus_counts_G1", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in ("documents", "orders", "lineitem", "conversations", "events")))
def _(t):
    return R.corpus_counts({n: t(n) for n in ("documents", "orders", "lineitem", "conversations", "events")})


@query("type_counts_G1", "SELECT event_type, count(*) AS n, CAST(grouping(event_type) AS INTEGER) AS is_total FROM events GROUP BY ROLLUP (event_type)")
def _(t):
    return R.type_counts(t("events"), "event_type", total=True)


@query("rule_scores_G4", f"""WITH {S.MESSAGES}, x AS (SELECT doc_id, lower(sender) AS s, lower(subject || ' ' || body) AS t, CASE WHEN strftime(date_sent, '%Y-%m-%d') LIKE '2024-01-0%' THEN 20 WHEN strftime(date_sent, '%Y-%m-%d') LIKE '2024-02%' THEN 10 ELSE 0 END AS a,
  contains(lower(sender), 'src7') AS dom FROM messages), y AS (SELECT *, contains(t, 'token')::INT + contains(t, 'license')::INT + contains(t, 'the ')::INT AS k, contains(t, 'und ')::INT + contains(t, 'les ')::INT AS n FROM x)
SELECT doc_id, CAST(least(8 * k + 12 * n, 100) AS INTEGER) AS suspicion, CAST(least(50 + 15 * dom::INT + 10 * (a > 0)::INT + 5 * n, 100) AS INTEGER) AS pertinence, 70 AS confidence, CAST(a AS INTEGER) AS anomaly FROM y""")
def _(t):
    return R.rule_scores(messages(t), ["src7"], {"2024-01-0": 20, "2024-02": 10}, ["token", "license", "the "], ["und ", "les "])


@query("node_rule_scores_G4", f"""WITH {GRAPH} SELECT id, CAST(least(CASE WHEN contains(lower(name), '7') THEN 35 ELSE 0 END + CASE WHEN contains(lower(name), 'nation') THEN 20 ELSE 0 END, 100) AS BIGINT) AS suspicion,
 CAST(least(50 + CASE WHEN contains(lower(name), '7') THEN 20 ELSE 0 END + CASE WHEN contains(lower(name), 'nation') THEN 10 ELSE 0 END + CASE WHEN contains(lower(name), '#') THEN 15 ELSE 0 END, 100) AS BIGINT) AS pertinence,
 CASE WHEN type = 'person' THEN CASE WHEN contains(name, ' ') AND length(name) > 5 THEN 80 ELSE 50 END WHEN type = 'company' THEN 70 WHEN type = 'location' THEN 60 ELSE 45 END AS confidence FROM nd""")
def _(t):
    tiers = t.spark.createDataFrame([("high", "7", 35, 20), ("high", "77", 35, 20), ("medium", "nation", 20, 10)], "tier string, term string, suspicion int, pertinence int")
    return R.node_rule_scores(nodes(t), tiers, ["#"])


@query("score_summary_G6", f"WITH {S.SCORES} SELECT target_type, count(*) AS n, count(*) FILTER (suspicion >= 30) AS over_30, count(*) FILTER (suspicion >= 60) AS over_60, round(avg(suspicion), 6) AS avg_suspicion, round(avg(pertinence), 6) AS avg_pertinence FROM scores GROUP BY 1")
def _(t):
    return R.score_summary(scores(t))


@query("top_scored_G6_W3", f"WITH {S.SCORES} SELECT doc_id, suspicion, pertinence FROM documents LEFT JOIN scores ON target_id = doc_id ORDER BY suspicion DESC NULLS LAST, pertinence DESC NULLS LAST, doc_id LIMIT 30")
def _(t):
    j = t("documents").select("doc_id").join(scores(t).select(F.col("target_id").alias("doc_id"), "suspicion", "pertinence"), "doc_id", "left")
    return j.orderBy(F.desc_nulls_last("suspicion"), F.desc_nulls_last("pertinence"), "doc_id").limit(30)


@query("conversation_summary_G7", """SELECT c.conv_id, coalesce(k.messages, 0) AS messages, k.last_turn, k.last_message FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN
 (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_max(text, turn) AS last_message FROM conversations WHERE role <> 'system' GROUP BY 1) k ON k.conv_id = c.conv_id""")
def _(t):
    c = t("conversations")
    return R.conversation_summary(c.select("conv_id").distinct(), c.where("role <> 'system'"))


@query("grouped_concat_G8", f"WITH {_COMPACT_SQL} SELECT doc_id, string_agg(value, ', ' ORDER BY value) AS entities FROM (SELECT DISTINCT doc_id, value FROM ce) GROUP BY 1")
def _(t):
    return R.grouped_concat(D.compact_entities(t.text("documents", "doc_id")))


def _log(t):
    return t("events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("term"), "ts", "value")


@query("session_terms_G9", "SELECT user_id AS session_id, event_type AS term, count(*) AS uses FROM events GROUP BY 1, 2")
def _(t):
    return R.session_terms(_log(t))


@query("session_loops_G9", """WITH u AS (SELECT user_id, event_type, count(*) AS uses FROM events GROUP BY 1, 2), i AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 20)
SELECT user_id AS session_id, bool_and(coalesce(uses, 0) >= 9) AS looping, count(*) AS initial_terms FROM i LEFT JOIN u USING (user_id, event_type) GROUP BY 1""")
def _(t):
    log = _log(t)
    return R.loops(R.session_terms(log), log.where("value > 20").select("session_id", "term").distinct(), 9)


@query("unused_alternatives_G9", """WITH a AS (SELECT min(n_nationkey) AS pos, CASE WHEN n_nationkey % 5 = 0 THEN 'click' ELSE n_name END AS term FROM nation GROUP BY 2), s AS (SELECT DISTINCT user_id FROM events)
SELECT user_id AS session_id, term, rank FROM (SELECT user_id, term, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS INTEGER) AS rank FROM s, a WHERE (user_id, term) NOT IN (SELECT (user_id, event_type) FROM events)) WHERE rank <= 4""")
def _(t):
    alt = t("nation").select(F.col("n_nationkey").alias("pos"), F.when(F.pmod("n_nationkey", F.lit(5)) == 0, "click").otherwise(F.col("n_name")).alias("term"))
    log = _log(t)
    return R.unused_alternatives(log, alt, R.session_terms(log))


@query("daily_quota_G10", """SELECT CAST(ts AS DATE) AS day, count(*) AS calls, CAST((sum(CAST(floor(value * 1000) AS BIGINT) * 25 + CAST(floor(value * 100) AS BIGINT) * 125) + 50) // 100 AS DOUBLE) / 1e6 AS cost_usd, count(*) >= 330 AS exhausted FROM events GROUP BY 1""")
def _(t):
    calls = t("events").select("ts", F.floor(F.col("value") * 1000).alias("tokens_in"), F.floor(F.col("value") * 100).alias("tokens_out"))
    return R.daily_quota(calls, 330, 1e6).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("merge_counters_G11", "SELECT source, min(doc_id) AS first_seen, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    d, lab = t("documents"), t("labels").select("doc_id")
    old = d.join(lab, "doc_id", "left_semi").groupBy("source").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("n"))
    return R.merge_counters(old, d.join(lab, "doc_id", "left_anti").select("source", F.col("doc_id").alias("seen_at")), "source")


@query("synthesis_statistics_G12", "SELECT count(*) AS claims, count(DISTINCT lang) AS fields, count(DISTINCT source) AS sources FROM documents")
def _(t):
    return t("documents").agg(F.count("*").alias("claims"), F.countDistinct("lang").alias("fields"), F.countDistinct("source").alias("sources"))


# ---- cases: customers as subjects, orders as evidence, suppliers of urgent orders as witnesses
_CASE = """sub AS (SELECT c_custkey AS subject_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'charged' WHEN 'MACHINERY' THEN 'not_charged' WHEN 'FURNITURE' THEN 'settled' WHEN 'HOUSEHOLD' THEN 'convicted' ELSE '' END AS status_code,
   CAST(c_nationkey - 6 AS INTEGER) AS stage, CAST(c_custkey % 101 AS INTEGER) AS confidence FROM customer),
ev AS (SELECT o_custkey AS subject_id, o_orderkey AS ord, CAST(o_orderkey % 101 AS INTEGER) AS confidence FROM orders WHERE o_orderstatus <> 'F'),
wi AS (SELECT DISTINCT o_custkey AS subject_id, l_suppkey AS witness FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'),
da AS (SELECT o_custkey AS subject_id, o_orderdate FROM orders WHERE o_orderstatus = 'O')"""
_RUBRIC = f"""{_CASE}, c AS (SELECT s.subject_id, status_code, (SELECT count(*) FROM ev WHERE ev.subject_id = s.subject_id) AS evidence, (SELECT count(*) FROM ev WHERE ev.subject_id = s.subject_id AND confidence >= 80) AS strong,
 (SELECT count(*) FROM wi WHERE wi.subject_id = s.subject_id) AS witnesses, (SELECT count(*) FROM da WHERE da.subject_id = s.subject_id) AS dated FROM sub s),
sc2 AS (SELECT *, CASE status_code WHEN 'convicted' THEN 15 WHEN 'charged' THEN 10 WHEN 'settled' THEN 5 ELSE 0 END AS st, CASE WHEN evidence >= 3 THEN 20 ELSE 0 END + CASE WHEN strong >= 2 THEN 20 ELSE 0 END
 + CASE WHEN witnesses >= 2 THEN 30 WHEN witnesses = 1 THEN 15 ELSE 0 END + CASE WHEN dated >= 2 THEN 15 ELSE 0 END + CASE status_code WHEN 'convicted' THEN 15 WHEN 'charged' THEN 10 WHEN 'settled' THEN 5 ELSE 0 END AS score FROM c),
rub AS (SELECT subject_id, evidence, strong, witnesses, dated, CAST(score AS INTEGER) AS score, score >= 70 AS ready, CASE WHEN score >= 70 THEN 'ready' WHEN score >= 40 THEN 'needs_more' ELSE 'insufficient' END AS tier,
 array_to_string(list_filter([CASE WHEN evidence < 3 THEN 'evidence' END, CASE WHEN strong < 2 THEN 'corroboration' END, CASE WHEN witnesses < 2 THEN 'witnesses' END, CASE WHEN dated < 2 THEN 'timeline' END, CASE WHEN st = 0 THEN 'status' END], lambda x: x IS NOT NULL), ',') AS missing FROM sc2)"""


def _subjects(t):
    seg = F.col("c_mktsegment")
    return t("customer").select(F.col("c_custkey").alias("subject_id"), F.when(seg == "BUILDING", "charged").when(seg == "MACHINERY", "not_charged")
                                .when(seg == "FURNITURE", "settled").when(seg == "HOUSEHOLD", "convicted").otherwise("").alias("status_code"),
                                (F.col("c_nationkey") - 6).alias("stage"), F.pmod("c_custkey", F.lit(101)).cast("int").alias("confidence"))


def _evidence(t):
    return t("orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("ord"), F.pmod("o_orderkey", F.lit(101)).cast("int").alias("confidence"))


def _rubric(t):
    o = t("orders")
    wi = o.where("o_orderpriority like '1%'").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("subject_id"), "l_suppkey").distinct()
    return R.case_rubric(_subjects(t), _evidence(t), wi, o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("subject_id")))


@query("case_rubric_G13", f"WITH {_RUBRIC} SELECT * FROM rub")
def _(t):
    return _rubric(t)


@query("rubric_summary_G13", f"WITH {_RUBRIC} SELECT tier, count(*) AS n, max(score) AS best FROM rub GROUP BY 1")
def _(t):
    return R.rubric_summary(_rubric(t))


@query("evidence_chain_G14", f"WITH {_CASE} SELECT subject_id, ord, confidence, row_number() OVER (PARTITION BY subject_id ORDER BY ord) AS position, CASE WHEN confidence >= 80 THEN 'Strong' WHEN confidence >= 50 THEN 'Moderate' ELSE 'Weak' END AS strength FROM ev")
def _(t):
    return R.evidence_chain(_evidence(t))


@query("staged_confidence_G14", f"""WITH {_CASE}, x AS (SELECT subject_id, greatest(-2, least(12, stage)) AS stage, CAST(floor(least(100.0, confidence + greatest(-2, least(12, stage)) / 12 * 20)) AS INTEGER) AS cf, confidence + greatest(-2, least(12, stage)) / 12 * 20 AS raw FROM sub)
SELECT subject_id, stage, CAST(trunc(least(100.0::DOUBLE, raw)) AS INTEGER) AS confidence, CASE WHEN stage <= 0 THEN 'low' WHEN stage <= 6 THEN 'middle' ELSE 'top' END AS label FROM x""")
def _(t):
    bands = t.spark.createDataFrame([(-2, 0, "low"), (1, 6, "middle"), (7, 99, "top")], "lo int, hi int, label string")
    return R.staged_confidence(_subjects(t), bands)


@query("case_timeline_G14", "SELECT o_orderkey AS event_id, o_orderdate AS at, o_orderpriority AS category FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey = 7")
def _(t):
    e = t("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("category"), F.array(F.col("o_custkey").cast("string")).alias("people"))
    return R.case_timeline(e, "5-LOW", "7").orderBy("at", "event_id").select("event_id", "at", "category")


@query("case_dossier_G15", f"""WITH {_RUBRIC}, ch AS (SELECT subject_id, position, '{{"position":' || position || ',"confidence":' || confidence || ',"strength":"' || CASE WHEN confidence >= 80 THEN 'Strong' WHEN confidence >= 50 THEN 'Moderate' ELSE 'Weak' END || '"}}' AS j
  FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ord) AS position FROM ev)), l AS (SELECT subject_id, '"chain":[' || string_agg(j, ',' ORDER BY position) || '],' AS c FROM ch GROUP BY 1)
SELECT rub.subject_id, '{{"score":' || score || ',"tier":"' || tier || '",' || coalesce(c, '') || '"disclaimer":"{R.DISCLAIMER}"}}' AS dossier FROM rub LEFT JOIN l ON l.subject_id = rub.subject_id""")
def _(t):
    return R.case_dossier(_rubric(t), R.evidence_chain(_evidence(t)))


# ---- hypotheses: orders per customer as hypotheses
_HYP = """hy AS (SELECT o_orderkey AS id, o_custkey AS case_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'unusual spike ' ELSE 'pattern in ' END || o_orderpriority AS statement, CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'pending' ELSE 'refuted' END AS status,
 (o_orderkey % 100) / 100 AS confidence, (o_custkey % 10) / 10 AS relevance, CAST(o_orderkey % 7 AS INTEGER) AS evidence_count FROM orders)"""


def _hyp(t):
    pr = F.col("o_orderpriority")
    st = F.col("o_orderstatus")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("case_id"), F.concat(F.when(pr == "1-URGENT", "unusual spike ").otherwise("pattern in "), pr).alias("statement"),
                              F.when(st == "F", "supported").when(st == "O", "pending").otherwise("refuted").alias("status"), (F.pmod("o_orderkey", F.lit(100)) / 100).alias("confidence"),
                              (F.pmod("o_custkey", F.lit(10)) / 10).alias("relevance"), F.pmod("o_orderkey", F.lit(7)).cast("int").alias("evidence_count"))


@query("hypothesis_metrics_G16", f"""WITH {_HYP} SELECT case_id, count(*) AS total, count(*) FILTER (status IN ('supported', 'refuted', 'inconclusive')) AS tested, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'supported') AS supported,
 CAST((20 * sum(CAST(round(confidence * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000 AS average_confidence, count(*) FILTER (evidence_count < 2 AND status = 'pending') AS low_evidence, count(*) FILTER (status = 'supported' AND confidence > 0.8) AS high_confidence FROM hy GROUP BY 1""")
def _(t):
    return R.hypothesis_metrics(_hyp(t))


@query("top_hypotheses_G16", f"WITH {_HYP}, p AS (SELECT *, round(confidence * relevance, 6) AS priority FROM hy) {topk('p', 5, 'priority DESC, id', 'case_id', 'case_id, id, priority')}")
def _(t):
    return R.top_hypotheses(_hyp(t))


@query("offline_scores_G17", f"""WITH {_HYP} SELECT id, round(0.3 + least(0.4, evidence_count * 0.1), 6)::DOUBLE AS confidence, round(0.5 + least(0.3, 0.1 * ({' + '.join(f"contains(lower(statement), '{w}')::INT" for w in R.HYPOTHESIS_WORDS)})), 6)::DOUBLE AS relevance FROM hy""")
def _(t):
    return R.offline_scores(_hyp(t))


@query("fold_evidence_G17", """WITH RECURSIVE s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_returnflag AS f FROM lineitem),
r AS (SELECT o_orderkey AS id, 0::BIGINT AS n, (o_orderkey % 100) / 100 AS x FROM orders UNION ALL SELECT r.id, s.n, CASE f WHEN 'R' THEN greatest(0.0::DOUBLE, x - 0.3::DOUBLE) WHEN 'A' THEN least(1.0::DOUBLE, x + 0.2::DOUBLE) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, x + 0.1::DOUBLE)) END FROM r JOIN s ON s.id = r.id AND s.n = r.n + 1)
SELECT id, round(arg_max(x, n), 6) AS confidence FROM r GROUP BY 1""")
def _(t):
    li = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("z"))
    e = li.select("id", F.posexplode("z").alias("seq", "s")).select("id", "seq", F.when(F.col("s.l_returnflag") == "R", "refuted").when(F.col("s.l_returnflag") == "A", "supported").otherwise("evidence").alias("kind"), F.lit("Found it").alias("text"))
    return R.fold_evidence(_hyp(t).select("id", "confidence"), e)


@query("entity_hypotheses_G18", """WITH f AS (SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'R' THEN 'date' WHEN 'A' THEN 'person' ELSE 'org' END AS type, min(l_linenumber * 1000000 + l_suppkey) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY k, type) AS t, 'S' || (k % 1000000) AS value FROM f)
SELECT a.case_id, 'connection' AS kind, a.value || ' (' || a.type || ') may be connected to ' || b.value || ' (' || b.type || ')' AS statement, 0.4::DOUBLE AS confidence, 0.6::DOUBLE AS relevance FROM t a JOIN t b ON a.case_id = b.case_id AND a.t < b.t AND b.t <= 3
UNION ALL SELECT case_id, 'temporal', 'Multiple date references suggest a timeline of significant events', 0.5, 0.7 FROM f WHERE type = 'date' AND n > 1""")
def _(t):
    f = F.col("l_returnflag")
    e = t("lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("pos"),
                             F.when(f == "R", "date").when(f == "A", "person").otherwise("org").alias("type"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("value"))
    return R.entity_hypotheses(e)


@query("latency_profile_G19", """WITH r AS (SELECT event_type AS grp, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT grp, any_value(n) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, max(v) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(v) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(v) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM r GROUP BY 1""")
def _(t):
    return R.latency_profile(t("events"), "event_type", "value")


@query("status_summary_G20", "SELECT o_orderstatus AS status, count(*) AS n, max(o_orderdate) AS last_at, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS last FROM orders GROUP BY 1")
def _(t):
    return R.status_summary(t("orders"), "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("merged_timeline_H11", """WITH x AS (SELECT o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders UNION ALL SELECT 'shipped ' || strftime(l_shipdate, '%-d %B %Y'), strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)
SELECT title, date, CASE WHEN contains(lower(title), 'urgent') OR contains(lower(title), 'high') THEN 'hot' WHEN contains(lower(title), 'shipped') THEN 'transport' ELSE 'other' END AS category FROM x""")
def _(t):
    cur = t("orders").select(F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    ev = t("lineitem").select(F.concat(F.lit("shipped "), F.date_format("l_shipdate", "d MMMM yyyy")).alias("name"))
    return R.merged_timeline(cur, ev, {"hot": ["urgent", "high"], "transport": ["shipped"]})


# ---- sets, first-hit order
@query("edge_directions_S1", f"WITH {GRAPH} SELECT id, count(*) AS n FROM un GROUP BY 1")
def _(t):
    from ..operators.graph import undirected
    return undirected(edges(t)).groupBy("id").agg(F.count("*").alias("n"))


@query("set_operations_S2", "SELECT p_brand, p_type FROM part WHERE p_size > 20 INTERSECT SELECT p_brand, p_type FROM part WHERE p_retailprice < 1500 EXCEPT SELECT p_brand, p_type FROM part WHERE p_size = 45")
def _(t):
    p = t("part")
    bt = lambda c: p.where(c).select("p_brand", "p_type")
    return bt("p_size > 20").intersect(bt("p_retailprice < 1500")).subtract(bt("p_size = 45"))


@query("claim_listing_G12", """SELECT o_orderkey AS claim_id, o_orderpriority AS field, o_orderdate AS created_at FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND CAST(o_orderkey AS VARCHAR) ILIKE '%7%' ORDER BY o_orderdate DESC, o_orderkey""")
def _(t):
    c = t("orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("field"), F.col("o_orderkey").cast("string").alias("claim"),
                           (F.col("o_orderstatus") == "F").alias("relevant"), F.col("o_orderdate").alias("created_at"))
    return R.list_claims(c, "1-URGENT", "7", True).select("claim_id", "field", "created_at")


@query("pattern_listing_G12", "SELECT p_partkey AS pattern_id, p_retailprice AS confidence FROM part WHERE p_brand = 'Brand#1' OR p_type = 'ECONOMY' OR p_brand = 'Brand#10' ORDER BY p_retailprice DESC, p_partkey")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("pattern_id"), F.array("p_brand", "p_type").alias("domains"), F.col("p_retailprice").alias("confidence"))
    return R.list_patterns(p, ["Brand#1", "ECONOMY", "Brand#10"]).select("pattern_id", "confidence")


@query("open_gaps_G12", "SELECT o_orderkey AS gap_id, o_totalprice AS priority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW' ORDER BY o_totalprice DESC, o_orderkey")
def _(t):
    g = t("orders").select(F.col("o_orderkey").alias("gap_id"), F.col("o_orderpriority").alias("field"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
                           F.col("o_totalprice").alias("priority"))
    return R.list_gaps(g, "5-LOW").select("gap_id", "priority")


@query("timeline_between_H11", """SELECT title, date, category FROM (SELECT o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'hot' ELSE 'other' END AS category FROM orders)
WHERE contains(lower(title), 'urgent') AND date BETWEEN '1995-03-01' AND '1996-02-29'""")
def _(t):
    cur = t("orders").select(F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    events = cur.limit(0).select(F.col("title").alias("name"))
    return R.timeline_between(R.merged_timeline(cur, events, {"hot": ["urgent"]}), "Urgent", "1995-03-01", "1996-02-29")
