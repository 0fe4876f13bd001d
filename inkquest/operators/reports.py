"""Reports and rollups: corpus statistics, scores, cases, hypotheses, sessions, quotas."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_checked
from .ingest import numbered, slices_for
from .search import top_per


# ---------------------------------------------------------------- statistics

def corpus_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def type_counts(df: DataFrame, column: str, top: int | None = None, total: bool = False) -> DataFrame:
    """Rows per value, most first; ``total`` adds one row over all values."""
    if total:
        return df.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).cast("int").alias("is_total"))
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column).limit(top) if top else out


def score_summary(scores: DataFrame) -> DataFrame:
    s = F.col("suspicion")
    return scores.groupBy("target_type").agg(
        F.count("*").alias("n"), F.count_if(s >= 30).alias("over_30"), F.count_if(s >= 60).alias("over_60"),
        F.round(F.avg(s), 6).alias("avg_suspicion"), F.round(F.avg("pertinence"), 6).alias("avg_pertinence"))


def grouped_concat(entities: DataFrame, id_col: str = "doc_id", sep: str = ", ") -> DataFrame:
    """Distinct entity values of each document joined in order."""
    once = entities.select(id_col, "value").distinct()
    return once.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list("value")), sep).alias("entities"))


def status_summary(jobs: DataFrame, status: str = "status", ts: str = "ts", label: str = "label") -> DataFrame:
    """Jobs per status with the latest one of each."""
    return jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"), F.max(ts).alias("last_at"), F.max_by(label, F.struct(ts, label)).alias("last"))


# ---------------------------------------------------------------- rule scores

def rule_scores(messages: DataFrame, domains=(), key_dates: dict[str, int] | None = None, keywords=(), names=()) -> DataFrame:
    """Message scores from caller lists, over the whole body.

    Domain of interest +15 pertinence; first matching date prefix adds its anomaly and
    +10 pertinence; +8 suspicion per keyword; +12/+5 per name; each score at most 100.
    """
    text = F.lower(F.concat_ws(" ", "subject", "body"))
    day = F.date_format("date_sent", "yyyy-MM-dd")

    def count(c, words):
        return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))

    anomaly = F.lit(0)
    for prefix, pts in reversed(list((key_dates or {}).items())):
        anomaly = F.when(F.startswith(day, F.lit(prefix)), pts).otherwise(anomaly)
    k, n = count(text, keywords), count(text, names)
    dom = (count(F.lower("sender"), domains) > 0).cast("int")
    return messages.select("doc_id", F.least(8 * k + 12 * n, F.lit(100)).alias("suspicion"),
                           F.least(50 + 15 * dom + 10 * (anomaly > 0).cast("int") + 5 * n, F.lit(100)).alias("pertinence"),
                           F.lit(70).alias("confidence"), F.least(anomaly, F.lit(100)).alias("anomaly"))


def node_rule_scores(nodes: DataFrame, tiers: DataFrame, domains=()) -> DataFrame:
    """Node scores: each tier (tier, term, suspicion, pertinence) counts once, type gives the confidence."""
    from .search import substring_join

    hit = substring_join(nodes, tiers, "name", "term", "id").groupBy("id", "tier").agg(
        F.max("suspicion").alias("s"), F.max("pertinence").alias("p")).groupBy("id").agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
    low, kind = F.lower("name"), F.col("type")
    confidence = (F.when((kind == "person") & F.contains(low, F.lit(" ")) & (F.length("name") > 5), 80).when(kind == "person", 50)
                  .when((kind == "email_address") & F.contains(low, F.lit("@")) & F.contains(low, F.lit(".")), 90).when(kind == "email_address", 40)
                  .when(kind.isin("company", "organization"), 70).when(kind.isin("date", "amount"), 85).when(kind == "location", 60).otherwise(45))
    dom = F.lit(False)
    for d in domains:
        dom = dom | F.contains(low, F.lit(d))
    return nodes.join(hit, "id", "left").select(
        "id", F.least(F.coalesce("s", F.lit(0)), F.lit(100)).cast("bigint").alias("suspicion"),
        F.least(50 + F.coalesce("p", F.lit(0)) + 15 * dom.cast("int"), F.lit(100)).cast("bigint").alias("pertinence"), confidence.alias("confidence"))


# ---------------------------------------------------------------- conversations, sessions, quota

def conversation_summary(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    t = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max_by("text", "turn").alias("last_message"), F.max("turn").alias("last_turn"))
    return conversations.join(t, "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"), "last_turn", "last_message")


def session_terms(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id", "term").agg(F.count("*").alias("uses"))


def loops(terms: DataFrame, initial: DataFrame, min_uses: int = 2) -> DataFrame:
    """Sessions whose initial terms were all used at least ``min_uses`` times."""
    j = initial.join(terms, ["session_id", "term"], "left")
    return j.groupBy("session_id").agg(F.bool_and(F.coalesce("uses", F.lit(0)) >= min_uses).alias("looping"), F.count("*").alias("initial_terms"))


def unused_alternatives(sessions: DataFrame, alternatives: DataFrame, terms: DataFrame, k: int = 4) -> DataFrame:
    """First ``k`` alternatives (pos, term) that a session has not used.

    A session that used u of them finds its first k among the first k + u, so it meets
    that many alternatives and no more, however long the list is.
    """
    offered = numbered(alternatives.groupBy("term").agg(F.min("pos").alias("pos")), "pos")
    used = terms.select("session_id", "term").distinct().join(offered.select("term", "rn"), "term").select("session_id", "rn")
    many = used.groupBy("session_id").agg(F.count("*").alias("u"))
    s = sessions.select("session_id").distinct().join(many, "session_id", "left").select(
        "session_id", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("u", F.lit(0)) + k)).alias("rn"))
    free = s.join(used, ["session_id", "rn"], "left_anti").join(offered.select("rn", "term"), "rn")
    return top_per(free, "session_id", k, "rn").select("session_id", "rank", "term")


def daily_quota(calls: DataFrame, call_limit: int, cost_limit: float, rate_in: str = "0.25", rate_out: str = "1.25") -> DataFrame:
    """Calls and cost per UTC day against limits; cost is tokens x rate per million."""
    cost = (F.col("tokens_in") * F.lit(rate_in).cast("decimal(10,6)") + F.col("tokens_out") * F.lit(rate_out).cast("decimal(10,6)")) / F.lit(1_000_000)
    d = calls.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 6).cast("decimal(10,6)").alias("cost_usd"))
    return d.select("day", "calls", "cost_usd", ((F.col("calls") >= call_limit) | (F.col("cost_usd") >= cost_limit)).alias("exhausted"))


def merge_counters(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First-seen time and count per key with a batch folded in."""
    rows = old.select(key, "first_seen", "n").unionByName(new.groupBy(key).agg(F.min("seen_at").alias("first_seen"), F.count("*").alias("n")))
    return rows.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.sum("n").alias("n"))


# ---------------------------------------------------------------- cases

# Rubric points.
STATUS_POINTS = {"convicted": 15, "charged": 10, "settled": 5}


def case_rubric(subjects: DataFrame, evidence: DataFrame, witnesses: DataFrame, events: DataFrame) -> DataFrame:
    """Readiness points of each subject from counts of the caller's tables; labels name only what is counted."""
    e = evidence.groupBy("subject_id").agg(F.count("*").alias("evidence"), F.count_if(F.col("confidence") >= 80).alias("strong"))
    w = witnesses.groupBy("subject_id").agg(F.count("*").alias("witnesses"))
    d = events.groupBy("subject_id").agg(F.count("*").alias("dated"))
    j = subjects.join(e, "subject_id", "left").join(w, "subject_id", "left").join(d, "subject_id", "left").na.fill(0, ["evidence", "strong", "witnesses", "dated"])
    status = F.lit(0)
    for code, pts in STATUS_POINTS.items():
        status = F.when(F.col("status_code") == code, pts).otherwise(status)
    ev, st, wi, da = F.col("evidence"), F.col("strong"), F.col("witnesses"), F.col("dated")
    score = (F.when(ev >= 3, 20).otherwise(0) + F.when(st >= 2, 20).otherwise(0) + F.when(wi >= 2, 30).when(wi == 1, 15).otherwise(0)
             + F.when(da >= 2, 15).otherwise(0) + status)
    missing = F.array_join(F.array_compact(F.array(F.when(ev < 3, "evidence"), F.when(st < 2, "corroboration"), F.when(wi < 2, "witnesses"),
                                                   F.when(da < 2, "timeline"), F.when(status == 0, "status"))), ",")
    return j.select("subject_id", "evidence", "strong", "witnesses", "dated", score.alias("score"), (score >= 70).alias("ready"),
                    F.when(score >= 70, "ready").when(score >= 40, "needs_more").otherwise("insufficient").alias("tier"), missing.alias("missing"))


def rubric_summary(rubric: DataFrame) -> DataFrame:
    return rubric.groupBy("tier").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def evidence_chain(evidence: DataFrame) -> DataFrame:
    """Ordinal and strength of each piece of evidence of a subject."""
    c = F.col("confidence")
    from .ingest import numbered_within

    return numbered_within(evidence, "subject_id", "ord", "position").select("subject_id", "ord", "confidence", "position",
                           F.when(c >= 80, "Strong").when(c >= 50, "Moderate").otherwise("Weak").alias("strength"))


def staged_confidence(subjects: DataFrame, bands: DataFrame) -> DataFrame:
    """Stage clamped to -2..12, confidence raised by up to 20 parts, and the caller's band label."""
    stage = F.greatest(F.lit(-2), F.least(F.lit(12), F.col("stage")))
    s = subjects.select("subject_id", stage.alias("stage"), F.least(F.lit(100.0), F.col("confidence") + stage / 12 * 20).cast("int").alias("confidence"))
    # bands are a handful of rows of whole numbers: one row per stage makes the join an equi-join
    per_stage = bands.select("label", F.explode(F.sequence(F.greatest("lo", F.lit(-2)), F.least("hi", F.lit(12)))).alias("stage"))
    return s.join(broadcast_checked(per_stage, 100), "stage", "left").select("subject_id", "stage", "confidence", "label")


def case_timeline(events: DataFrame, category: str | None = None, subject: str | None = None) -> DataFrame:
    out = events
    if category is not None:
        out = out.where(F.col("category") == category)
    if subject is not None:
        out = out.where(F.array_contains("people", subject))
    return out


DISCLAIMER = "Counts of supplied records; no finding about any person."


def case_dossier(rubric: DataFrame, chain: DataFrame, top: int | None = None) -> DataFrame:
    """Nested JSON per subject: rubric and its evidence (the first ``top`` pieces if given), with a disclaimer."""
    first = (chain if top is None else chain.where(F.col("position") <= top)).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("position", "confidence", "strength"))).alias("chain"))
    j = rubric.join(first, "subject_id", "left")
    return j.select("subject_id", F.to_json(F.struct("score", "tier", "chain", F.lit(DISCLAIMER).alias("disclaimer"))).alias("dossier"))


# ---------------------------------------------------------------- hypotheses

def hypothesis_metrics(h: DataFrame) -> DataFrame:
    """Per case: counts by status, mean confidence, and what the recommendations count."""
    st, c = F.col("status"), F.col("confidence")
    return h.groupBy("case_id").agg(
        F.count("*").alias("total"), F.count_if(st.isin("supported", "refuted", "inconclusive")).alias("tested"), F.count_if(st == "pending").alias("pending"),
        F.count_if(st == "supported").alias("supported"), F.round(F.round(F.avg(c), 9), 3).alias("average_confidence"),
        F.count_if((F.col("evidence_count") < 2) & (st == "pending")).alias("low_evidence"), F.count_if((st == "supported") & (c > 0.8)).alias("high_confidence"))


def top_hypotheses(h: DataFrame, k: int = 5) -> DataFrame:
    p = h.withColumn("priority", F.round(F.col("confidence") * F.col("relevance"), 6))
    return top_per(p, "case_id", k, F.desc("priority"), "id").select("case_id", "id", "priority", "rank")


HYPOTHESIS_WORDS = ["unusual", "pattern", "connection", "anomaly", "spike"]


def offline_scores(h: DataFrame, words=HYPOTHESIS_WORDS) -> DataFrame:
    hits = sum((F.contains(F.lower("statement"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return h.select("id", F.round(0.3 + F.least(F.lit(0.4), F.col("evidence_count") * 0.1), 6).alias("confidence"),
                    F.round(0.5 + F.least(F.lit(0.3), hits * 0.1), 6).alias("relevance"))


def fold_evidence(h: DataFrame, events: DataFrame) -> DataFrame:
    """Confidence after the ordered events (id, seq, kind, text) of each hypothesis.

    Evidence moves it by +0.1 or -0.05, a supported test by +0.2, a refuted one by
    -0.3, each step clamped to 0..1.  A clamped step is the map x -> min(hi, max(lo, x + d));
    such maps compose into one of the same form, so runs of events are reduced in
    parallel blocks first and only the blocks are folded in order.
    """
    low = F.lower("text")
    d = (F.when(F.col("kind") == "evidence", F.when(F.contains(low, F.lit("confirm")) | F.contains(low, F.lit("found")), 0.1).otherwise(-0.05))
         .when(F.col("kind") == "supported", 0.2).when(F.col("kind") == "refuted", -0.3).otherwise(0.0))
    lo = F.when(F.col("kind") == "supported", -1e9).otherwise(0.0)
    hi = F.when(F.col("kind") == "refuted", 1e9).otherwise(1.0)
    block = F.floor(F.col("seq") / 256)
    steps = events.select("id", block.alias("b"), F.struct("seq", d.alias("d"), lo.alias("lo"), hi.alias("hi")).alias("s"))
    ident = F.struct(F.lit(0.0).alias("d"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))

    def then(a, s):
        # clamp of s after clamp of a
        return F.struct((a["d"] + s["d"]).alias("d"), F.least(s["hi"], F.greatest(s["lo"], a["lo"] + s["d"])).alias("lo"),
                        F.least(s["hi"], F.greatest(s["lo"], a["hi"] + s["d"])).alias("hi"))

    blocks = steps.groupBy("id", "b").agg(F.aggregate(F.array_sort(F.collect_list("s")), ident, then).alias("m"))
    whole = blocks.groupBy("id").agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda z: z["m"]), ident, then).alias("m"))
    x = F.col("confidence")
    return h.join(whole, "id", "left").select("id", F.round(F.when(F.col("m").isNull(), x).otherwise(
        F.least(F.col("m.hi"), F.greatest(F.col("m.lo"), x + F.col("m.d")))), 6).alias("confidence"))


def entity_hypotheses(entities: DataFrame) -> DataFrame:
    """Connection hypotheses between the first entities of the first three types of each case, and a timeline one.

    ``entities`` is (case_id, pos, type, value).  First entities are found by a
    partial ``min_by``, so a large case is reduced before it is gathered.
    """
    first = entities.groupBy("case_id", F.lower("type").alias("type")).agg(F.min(F.struct("pos", "value")).alias("m"), F.count("*").alias("n"))
    types = top_per(first, "case_id", 3, "m.pos", "type", rank="t").select("case_id", "t", "type", F.col("m.value").alias("value"))
    a = types.select("case_id", F.col("t").alias("ta"), F.col("type").alias("type_a"), F.col("value").alias("a"))
    b = types.select("case_id", F.col("t").alias("tb"), F.col("type").alias("type_b"), F.col("value").alias("b"))
    pair = a.join(b, "case_id").where("ta < tb").select("case_id", F.lit("connection").alias("kind"), F.concat(
        "a", F.lit(" ("), "type_a", F.lit(") may be connected to "), "b", F.lit(" ("), "type_b", F.lit(")")).alias("statement"),
        F.lit(0.4).alias("confidence"), F.lit(0.6).alias("relevance"))
    dates = first.where("type = 'date' and n > 1").select("case_id", F.lit("temporal").alias("kind"),
        F.lit("Multiple date references suggest a timeline of significant events").alias("statement"), F.lit(0.5).alias("confidence"), F.lit(0.7).alias("relevance"))
    return pair.unionByName(dates)


# ---------------------------------------------------------------- percentiles

def latency_profile(df: DataFrame, group: str, value: str, slices: int = 512) -> DataFrame:
    """Mean, min, max and the values at index int(n*0.5), int(n*0.95), int(n*0.99) of each group, exactly.

    Values are first reduced to counts.  Approximate quantiles only cut the value range
    into slices; exact ranks come from slice totals plus a running count inside the few
    slices that hold a wanted rank, so no task orders a whole group.
    """
    counts = df.groupBy(F.col(group).alias("grp"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = df.groupBy(F.col(group).alias("grp")).agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], 10_000).alias("cuts"))
    sliced = counts.join(broadcast_checked(cuts), "grp").select("grp", "v", "c", F.size(F.filter("cuts", lambda q: q < F.col("v"))).alias("s"))
    size = sliced.groupBy("grp", "s").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = size.withColumn("before", F.sum("n").over(Window.partitionBy("grp").orderBy("s")) - F.col("n"))
    stats = size.groupBy("grp").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    wanted = stats.select("grp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("n") * p).alias("idx")) for k, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])).alias("w")).select("grp", "w.*")
    where = wanted.join(before, "grp").where((F.col("idx") >= F.col("before")) & (F.col("idx") < F.col("before") + F.col("n"))).select("grp", "k", "idx", "s", "before")
    inner = sliced.join(where, ["grp", "s"])
    run = F.sum("c").over(Window.partitionBy("grp", "k").orderBy("v")) + F.col("before")
    hit = inner.withColumn("upto", run).where(F.col("upto") > F.col("idx")).groupBy("grp").pivot("k", ["p50", "p95", "p99"]).agg(F.min("v"))
    return stats.join(hit, "grp")


# ---------------------------------------------------------------- joins

def messages_of_node(messages: DataFrame, node_names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Messages sent under the node's name or any alias: (node_id, ...) by semi-join on the union."""
    keys = node_names.select("node_id", F.lower("name").alias("who")).unionByName(aliases.select(F.col("canonical_id").alias("node_id"), F.lower("alias").alias("who"))).distinct()
    return messages.join(keys.select("who").distinct(), F.lower("sender") == F.col("who"), "left_semi")


def mentions(docs: DataFrame, nodes: DataFrame, like: str) -> DataFrame:
    """Documents with the nodes extracted from them whose name is like the pattern, by date."""
    return docs.join(nodes.where(F.col("name").ilike(like)), F.col("doc_id") == F.col("source_id"))


def events_in_range(bounds: DataFrame, events: DataFrame, k: int = 10, slices: int | None = None) -> DataFrame:
    """First ``k`` events between ``lo`` and ``hi`` of each query, or naming its subject.

    ``bounds`` is (query_id, lo, hi, subject), ``events`` (event_id, at, people).  All
    events are numbered in time order; a query's range begins right after the events
    before ``lo``, so its first ``k`` events are ``k`` consecutive numbers and are
    fetched by equality.  The work is linear in events plus ``k`` per query, however
    many events a range covers.
    """
    slices = slices or slices_for(events)

    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    e = events.select(F.lit(1).alias("is_event"), F.col("event_id").alias("id"), F.col("at").alias("when"), micros("at").alias("t"))
    q = bounds.select(F.lit(0).alias("is_event"), F.col("query_id").alias("id"), F.col("lo").alias("when"), micros("lo").alias("t"))
    # approximate quantiles only cut the time line into slices of about equal size
    cuts = e.select(F.col("t").cast("double").alias("t")).approxQuantile("t", [i / slices for i in range(1, slices)], 0.5 / slices)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    both = e.unionByName(q).withColumn("_k", F.col("t").cast("double"))
    sliced = Bucketizer(splits=splits, inputCol="_k", outputCol="_b").transform(both).drop("_k")
    sizes = sliced.groupBy("_b").agg(F.sum("is_event").alias("_n"))
    shift = sizes.withColumn("_off", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).drop("_n")
    # a query sorts before the events of its own instant, so its count is of earlier events only
    upto = F.sum("is_event").over(Window.partitionBy("_b").orderBy("t", "is_event", "id").rowsBetween(Window.unboundedPreceding, 0))
    placed = sliced.withColumn("_r", upto).join(F.broadcast(shift), "_b").withColumn("pos", F.col("_r") + F.col("_off"))
    numbered = placed.where("is_event = 1").select("pos", F.col("id").alias("event_id"), F.col("when").alias("at"))
    wanted = (placed.where("is_event = 0").select(F.col("id").alias("query_id"), F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(k)), lambda i: F.col("pos") + i)).alias("pos")))
    ranged = wanted.join(numbered, "pos").join(bounds.select("query_id", "hi"), "query_id").where("at <= hi").select("query_id", "event_id", "at")
    # the first k events of a subject answer every query for it
    named = top_per(events.select("event_id", "at", F.explode("people").alias("subject")), "subject", k, "at", "event_id").drop("rank").join(
        bounds.select("query_id", "subject").where("subject is not null"), "subject").select("query_id", "event_id", "at")
    cut = ranged.unionByName(top_per(named, "query_id", k, "at", "event_id").drop("rank")).distinct()
    return top_per(cut, "query_id", k, "at", "event_id")


def overlapping(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    return df.where(F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted])))


def list_claims(claims: DataFrame, field: str | None = None, search: str | None = None, relevant: bool = False, limit: int | None = None) -> DataFrame:
    """Claims (claim_id, field, claim, relevant, created_at), newest first; only the filters given apply."""
    from .rules import listing

    rows = claims.where("relevant") if relevant else claims
    return listing(rows, {"field": field}, {"claim": search}, order=["created_at"], id_col="claim_id", limit=limit)


def list_patterns(patterns: DataFrame, domains: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Patterns (pattern_id, domains, confidence) that touch any of the domains, surest first."""
    from .rules import listing

    rows = overlapping(patterns, "domains", domains) if domains else patterns
    return listing(rows, order=["confidence"], id_col="pattern_id", limit=limit)


def list_gaps(gaps: DataFrame, field: str | None = None, limit: int | None = None) -> DataFrame:
    """Open gaps (gap_id, field, status, priority), most pressing first."""
    from .rules import listing

    return listing(gaps, {"field": field, "status": "open"}, order=["priority"], id_col="gap_id", limit=limit)


def timeline_between(timeline: DataFrame, subject: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Entries (title, date, category) that mention a subject, from one day to another, in order of date; only the bounds given apply."""
    rows = timeline if subject is None else timeline.where(F.contains(F.lower("title"), F.lit(subject.lower())))
    rows = rows if first is None else rows.where(F.col("date") >= first)
    rows = rows if last is None else rows.where(F.col("date") <= last)
    return rows.orderBy("date", "title")


def entity_links(papers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Authors linked to graph nodes of the same normalised name."""
    from ..functions.text import normalize_name

    a = papers.select("doi", "author", normalize_name("author").alias("k"))
    n = nodes.select(F.col("id").alias("node_id"), normalize_name("name").alias("k"))
    return a.join(n, "k").select("doi", "author", "node_id", F.lit("same_person").alias("link"), F.lit(0.9).alias("confidence"))


def merged_timeline(curated: DataFrame, nodes: DataFrame, categories: dict[str, list[str]], default: str = "other") -> DataFrame:
    """Curated events and event nodes dated from their names, with a category by keyword."""
    from ..functions.text import fuzzy_date

    low = F.lower("title")
    cat = F.lit(default)
    for name, words in reversed(list(categories.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        cat = F.when(hit, name).otherwise(cat)
    dated = nodes.select(F.col("name").alias("title"), fuzzy_date("name").alias("date")).where("date is not null")
    return curated.select("title", "date").unionByName(dated).withColumn("category", cat)


def quality_drop(history: DataFrame, drop: float) -> DataFrame:
    """Runs whose score fell by more than ``drop`` against the run before (run_id consecutive)."""
    prev = history.select((F.col("run_id") + 1).alias("run_id"), F.col("score").alias("before"))
    j = history.join(prev, "run_id", "left")
    return j.select("run_id", "score", F.round(F.col("score") - F.col("before"), 6).alias("delta"), F.coalesce(F.col("before") - F.col("score") > drop, F.lit(False)).alias("alert"))
