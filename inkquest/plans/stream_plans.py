"""Streaming over the events and documents tables with batch twins (survey rows T1-T9)."""

from pyspark.sql import functions as F

from ..operators import activity as A, reports as R
from ..session import shared_dir
from ..streaming import jobs as J, known
from ..sources import readers as SR
from .registry import query
from .source_plans import responses


def _stream(t, watermark=None):
    return J.event_stream(t.spark, t.path("events").replace("events.parquet", "events*.parquet"), t("events").schema, watermark)


@query("inbox_ingestion_T1", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN length(trim(h)) < 50 THEN 'too_short' WHEN row_number() OVER (PARTITION BY h ORDER BY conv_id) > 1 THEN 'duplicate' ELSE 'inserted' END AS status
 FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) || chr(10) AS h FROM conversations GROUP BY 1)) GROUP BY 1""")
def _(t):
    # every conversation becomes one file of the inbox
    c = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("value"))
    inbox = shared_dir(t.spark, "inbox")
    c.write.partitionBy("conv_id").text(inbox)
    out = J.ingest_inbox(t.spark, inbox, shared_dir(t.spark, "ingested"), shared_dir(t.spark, "inbox-ckpt"))
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("log_tail_T2", "SELECT role AS title, count(*) AS n FROM conversations GROUP BY 1")
def _(t):
    head = F.concat(F.lit("## 2024-01-01 00:"), F.lpad(F.pmod("turn", F.lit(60)).cast("string"), 2, "0"), F.lit(" | "), "role", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    logs = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", head.alias("b")))), lambda s: s["b"]), "\n---\n").alias("value"))
    folder = shared_dir(t.spark, "logs")
    logs.write.partitionBy("conv_id").text(folder)
    e = J.tail_log(t.spark, folder, shared_dir(t.spark, "tail"), shared_dir(t.spark, "tail-ckpt"))
    return e.groupBy("title").agg(F.count("*").alias("n"))


@query("sliding_limit_T3")
def _(t):
    return J.drain(J.decide(_stream(t), "user_id", J.SlidingLimit(2, 3600)), "limit").select("client", "event_id", "accepted")


@query("sliding_window_counts_T3", """SELECT user_id, w AS window_start, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE for i in range(0, 6)]) AS w FROM events) GROUP BY 1, 2""")
def _(t):
    return A.window_counts(t("events"), "user_id", "60 minutes", "10 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("token_bucket_T4")
def _(t):
    return J.drain(J.decide(_stream(t), "user_id", J.TokenBucket(1 / 3600, 2)), "bucket").select("client", "event_id", "accepted")


# what is stored: the first event of a key, then the first one beyond its time-to-live
_STORED = """RECURSIVE k AS (SELECT user_id, event_type, epoch_us(ts) AS t, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3),
st AS (SELECT user_id, event_type, min(t) AS t FROM k GROUP BY 1, 2
  UNION ALL SELECT user_id, event_type, min(k.t) FROM st JOIN k USING (user_id, event_type) WHERE k.t > st.t + 300000000 GROUP BY 1, 2),
r AS (SELECT event_id, event_id NOT IN (SELECT event_id FROM st JOIN k USING (user_id, event_type, t)) AS is_repeat FROM events)"""


@query("ttl_repeats_T5", f"WITH {_STORED} SELECT event_id, is_repeat FROM r")
def _(t):
    return A.repeats(t("events"), ["user_id", "event_type"], "event_id").select("event_id", "is_repeat")


@query("ttl_hit_rate_T5", f"WITH {_STORED} SELECT count(*) AS n, count(*) FILTER (is_repeat) AS hits, round(count(*) FILTER (is_repeat)::DOUBLE / count(*), 9) AS hit_rate FROM r")
def _(t):
    return A.hit_rate(A.repeats(t("events"), ["user_id", "event_type"], "event_id"))


@query("ttl_dedupe_stream_T5", f"WITH {_STORED} SELECT event_id FROM r WHERE NOT is_repeat")
def _(t):
    e = _stream(t).withColumn("k", F.xxhash64("user_id", "event_type"))
    return J.drain(J.decide(e, "k", J.TtlCache(300)), "ttl").where("accepted").select("event_id")


_GAPS = """g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query("activity_sessions_T6", f"WITH {_GAPS} SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2")
def _(t):
    return A.sessions(t("events"), "user_id", "event_id", 12 * 3600)


@query("session_stream_T6", f"""WITH {_GAPS} SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS expires, count(*) AS n FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT to_timestamp(floor(epoch_ms(max(ts)) / 1000.0))::TIMESTAMP FROM events) - INTERVAL 1 HOUR""")
def _(t):
    s = J.drain(J.session_stream(_stream(t, "1 hour"), "user_id", "12 hours"), "sessions")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "expires")})


@query("tumbling_counts_T7", """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    s = J.drain(J.tumbling_stream(_stream(t, "10 minutes"), "event_type", "1 hour"), "tumbling")
    return s.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("incremental_counts_T8_G11", "SELECT user_id, min(ts) AS first_seen, count(*) AS n FROM events GROUP BY 1")
def _(t):
    m = J.merge_counts(_stream(t), "user_id", shared_dir(t.spark, "counts"), shared_dir(t.spark, "counts-ckpt"))
    return m.withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz"))


@query("quality_drop_T9", """WITH h AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS run_id, round(avg(value), 6) AS score FROM events GROUP BY 1)
SELECT a.run_id, a.score, round(a.score - b.score, 6) AS delta, coalesce(b.score - a.score > 5, false) AS alert FROM h a LEFT JOIN h b ON b.run_id = a.run_id - 1""")
def _(t):
    day = F.datediff("ts", F.lit("2024-01-01")).cast("bigint")
    return R.quality_drop(t("events").groupBy(day.alias("run_id")).agg(F.round(F.avg("value"), 6).alias("score")), 5)


def _graph_batches(t):
    """The nodes of all model responses with nested metadata: the last source, and the last one of each residue by three."""
    nodes = SR.response_part(SR.parse_responses(responses(t)), "nodes").select("type", "name", "source_id").distinct()
    residue = F.concat(F.lit("d"), F.pmod("source_id", F.lit(3)).cast("string"))
    return nodes.select("*", F.col("source_id").alias("seq"), F.to_json(F.struct(F.col("source_id").alias("last"), F.create_map(residue, "source_id").alias("seen"))).alias("metadata"))


@query("graph_store_T8_H1", r"""WITH x AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
n AS (SELECT DISTINCT 'person' AS type, 'Customer ' || o_custkey AS name, o_orderkey AS seq FROM x UNION ALL SELECT DISTINCT 'company', 'Supplier ' || l_suppkey, o_orderkey FROM x),
k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9\s]', '', 'g')) AS name_normalized FROM n),
s AS (SELECT type, name_normalized, string_agg('"d' || d || '":' || m, ',' ORDER BY d) AS seen FROM (SELECT type, name_normalized, seq % 3 AS d, max(seq) AS m FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT k.type, k.name_normalized, arg_min(name, seq) AS name, min(seq) AS source_id, count(*) AS mentions, '{"last":' || max(seq) || ',"seen":{' || any_value(seen) || '}}' AS metadata
FROM k JOIN s ON s.type = k.type AND s.name_normalized = k.name_normalized GROUP BY 1, 2""")
def _(t):
    folder = shared_dir(t.spark, "graph-in")
    per_batch = _write_batches(_graph_batches(t), folder, "source_id", 5)
    return J.graph_stream(t.spark, folder, shared_dir(t.spark, "graph"), shared_dir(t.spark, "graph-ckpt"), per_batch).nodes()


def _write_batches(df, folder: str, key: str, n: int) -> int:
    """A table as files dealt by a hash of a key, computed once and written by all tasks; how many of them make an ``n``-th."""
    files = max(4 * n, df.sparkSession.sparkContext.defaultParallelism)
    df.repartition(files, key).write.parquet(folder)
    return -(-files // n)


@query("inbox_known_T1", """SELECT status, count(*) AS n, CAST(sum(length(h)) AS BIGINT) AS chars FROM (SELECT h, CASE WHEN length(trim(h)) < 50 THEN 'too_short' WHEN row_number() OVER (PARTITION BY h ORDER BY conv_id) > 1 THEN 'duplicate' ELSE 'inserted' END AS status
 FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) || chr(10) AS h FROM conversations GROUP BY 1)) GROUP BY 1""")
def _(t):
    # every conversation becomes one file of the inbox; they are taken in four batches that know each other by filters
    c = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("value"))
    folder = shared_dir(t.spark, "inbox")
    c.write.partitionBy("conv_id").text(folder)
    inbox = known.Inbox(t.spark, shared_dir(t.spark, "ingested"), groups=8, bits=1 << 16)
    files = t("conversations").select("conv_id").distinct().count()
    inbox.follow(folder, shared_dir(t.spark, "inbox-ckpt"), -(-files // 4))
    return inbox.progress().select("status", "n", "chars")
