"""Entity, sensitive-value and relation extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P
from ..functions.text import ascii_fold, col
from ..session import staged
from .ingest import group_slices


# ---------------------------------------------------------------- spans

def extract_spans(docs: DataFrame, patterns=None, category=None, sensitive=None, context: int = 50,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long table of matches of the chosen registry patterns with offsets and context."""
    chosen = patterns if patterns and isinstance(patterns[0], P.Pattern) else P.select_patterns(patterns, category, sensitive)
    return docs.select(id_col, F.inline(P.all_spans(text_col, chosen, context)))


def extract_values(docs: DataFrame, patterns=P.REGISTRY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long table of (id, pattern, category, sensitive, ordinal, value): one regex pass each, no offsets."""
    found = F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.lit(p.category).alias("category"),
                               F.lit(p.sensitive).alias("sensitive"), P.values_of("_t", p).alias("v"))
                      for p in patterns])
    return docs.select(id_col, ascii_fold(text_col).alias("_t")).select(id_col, F.inline(found)).select(
        id_col, "pattern", "category", "sensitive", F.posexplode("v").alias("ordinal", "value"))


def redact(docs: DataFrame, patterns=None, text_col: str = "text", out: str = "redacted") -> DataFrame:
    """Every sensitive match replaced by as many asterisks."""
    chosen = patterns or P.select_patterns(sensitive=True)
    return docs.withColumn(out, P.mask_spans(text_col, P.all_spans(text_col, chosen, 0)))


def pattern_report(values: DataFrame, top: int = 20) -> DataFrame:
    """Per pattern: matches, distinct values and the first ``top`` distinct values in order.

    Distinct values are pre-counted and cut to ``top`` per pattern before anything
    is gathered, so a frequent pattern never forms one large group.  They are staged, so that
    the texts are searched once for the totals and the sample.
    """
    distinct = staged(values.groupBy("pattern", "value").agg(F.count("*").alias("n")), "values")
    totals = distinct.groupBy("pattern").agg(F.sum("n").alias("matches"), F.count("*").alias("distinct_values"))
    w = Window.partitionBy("pattern").orderBy("value")
    first = (distinct.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
             .groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("sample")))
    return totals.join(first, "pattern")


# ---------------------------------------------------------------- typed entities

_MONTH = (r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?"
          r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")
# Regular expressions of an entity kind in the order they are tried, and its confidence.
KINDS = {
    "date": ([r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}[-.]\d{1,2}[-.]\d{2,4}\b",
              r"\b" + _MONTH + r"\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}\b", r"\b" + _MONTH + r"\s+\d{4}\b"], 0.85),
    "person": ([r"\b[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+(?:\s+(?:Jr|Sr|III|IV|II)\.?)?\b",
                r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Hon|Sir|Dame)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
                r"\b[A-Z][a-z]+,\s+[A-Z][a-z]+(?:\s+[A-Z]\.)?\b"], 0.75),
    "organization": ([r"\b[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:Inc|Corp|LLC|Ltd|LLP|Co|Company|Corporation|Group|Holdings|Partners|Associates|Foundation|Institute|University|Bank|Trust|Fund|Capital|Ventures|International|Worldwide|Global)\.?\b",
                      r"\bThe\s+[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:Organization|Foundation|Institute|Association|Society|Council|Committee|Commission|Agency|Bureau|Department|Ministry)\b",
                      r"\b[A-Z]{2,6}\b"], 0.80),
    "amount": ([r"(?:\$|USD|EUR|€|£|GBP|¥|JPY)\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?",
                r"\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s*(?:USD|EUR|GBP|JPY|dollars?|euros?|pounds?)",
                r"(?:\$|USD|EUR|€|£)\s*\d+(?:\.\d+)?\s*(?:million|billion|thousand|M|B|K)",
                r"\d+(?:\.\d+)?\s*(?:million|billion|thousand)\s*(?:dollars?|USD|euros?|EUR|pounds?|GBP)"], 0.90),
    "location": ([r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*(?:[A-Z]{2}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
                  r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl)\.?\b"], 0.70),
    "email": ([r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"], 0.95),
    "phone": ([r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"], 0.80),
    "url": ([r"https?://[A-Za-z0-9][-A-Za-z0-9+&@#/%?=~_|!:,.;]*[-A-Za-z0-9+&@#/%=~_|]"], 0.95),
}
_CAP, _LOW = r"[A-Z][A-Za-z]*+", r"[A-Z][a-z]++"


def _suffixes(regex: str) -> str:
    """The closing word list of a pattern of KINDS."""
    return regex[regex.rindex("(?:") + 3:regex.rindex(")")]


# Loop forms (see Pattern.loop_form) of the kinds with open-ended word runs, by (kind, order).
_LOOP = {
    ("person", 1): r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Hon|Sir|Dame)\.?\s+[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++",
    ("organization", 0): r"\b" + P.up_to_last(_CAP, _suffixes(KINDS["organization"][0][0])) + r"(?:\.\b)?",
    ("organization", 1): r"\bThe\s+" + P.up_to_last(_CAP, _suffixes(KINDS["organization"][0][1])),
    ("location", 0): rf"\b{_LOW}(?:\s++{_LOW})*+,\s*(?:[A-Z]{{2}}\b|{_LOW}\b(?:\s++{_LOW}\b)*+)",
    ("location", 1): r"\b\d+\s+" + P.up_to_last(_LOW, _suffixes(KINDS["location"][0][1])) + r"(?:\.\b)?",
}
_DEAD = {
    ("organization", 0): rf"\b{_CAP}(?:\s++{_CAP})*+",
    ("location", 0): rf"\b{_LOW}(?:\s++{_LOW})*+",
}
_GUARD = {"date": "[0-9]", "amount": "[0-9]", "email": "@", "phone": "[0-9]{3}", "url": "://", ("location", 0): ",", ("location", 1): "[0-9]",
          ("person", 2): ",", ("organization", 1): "The"}
# Kinds kept once per document (without case), the others keep every match.
DEDUPED_KINDS = ["date", "person", "organization", "amount", "location"]
# A person containing one of these is dropped.
PERSON_STOP = """the this that with from have will been january february march april may june july
august september october november december monday tuesday wednesday thursday friday saturday
sunday""".split()
# Acronyms of at most three letters that are kept.
KNOWN_ACRONYMS = "FBI CIA NSA SEC DOJ IRS EPA FDA FTC NYSE LLC CEO CFO".split()


def kind_patterns(types=None, places=()) -> list[tuple[str, int, P.Pattern]]:
    """(kind, order, pattern) of the wanted kinds; ``places`` adds a caller's gazetteer."""
    out = []
    for kind, (regexes, conf) in KINDS.items():
        if types is not None and kind not in types:
            continue
        out += [(kind, i, P.Pattern(f"{kind}{i}", r, kind, conf, loop_form=_LOOP.get((kind, i)), dead_run=_DEAD.get((kind, i)),
                                 guard=_GUARD.get((kind, i), _GUARD.get(kind)))) for i, r in enumerate(regexes)]
        if kind == "location" and places:
            out.append((kind, len(regexes), P.Pattern(f"{kind}{len(regexes)}", place_regex(places), kind, conf)))
    return out


def typed_entities(docs: DataFrame, types=None, places=(), context: int = 50,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entities of each kind with offsets, context and confidence.

    Repeats inside a document collapse in the partial aggregate on (document, kind,
    value without case), keeping the earliest by (pattern order, start).
    """
    chosen = kind_patterns(types, places)
    spans = docs.select(id_col, F.inline(P.all_spans(text_col, [p for _, _, p in chosen], context)))
    kind = F.col("category")
    ok = (~(kind == "person") | ~_contains_any(F.lower("value"), PERSON_STOP)) & (
        ~(kind == "organization") | (F.length("value") > 3) | F.col("value").isin(KNOWN_ACRONYMS))
    order = F.regexp_extract("pattern", r"(\d+)$", 1).cast("int")
    rows = spans.where(ok).select(id_col, kind.alias("kind"), order.alias("ord"), "start", "end", "value", "confidence", "context")
    once = F.col("kind").isin(DEDUPED_KINDS)
    key = F.when(once, F.lower("value")).otherwise(F.concat_ws(":", "start", "value"))
    best = F.min(F.struct("ord", "start", "end", "value", "confidence", "context")).alias("m")
    return rows.groupBy(id_col, "kind", key.alias("k")).agg(best).select(
        id_col, "kind", "m.value", "m.start", "m.end", "m.confidence", "m.context")


def _contains_any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def amount_value(x, variant: str = "exact") -> Column:
    """Numeric value of an amount text.

    ``exact`` understands "$5M", "USD 5" and thousands; ``plain`` only scales a
    number that stands first and is set off by a blank, and gives 0 otherwise.
    """
    c = F.translate(col(x), ",$€£", "")
    low = F.lower(c)
    if variant == "plain":
        number = F.coalesce(F.split_part(F.trim(c), F.lit(" "), F.lit(1)).try_cast("double"), F.lit(0.0))
        return (F.when(F.contains(low, F.lit("million")) | F.contains(c, F.lit("M")), number * 1e6)
                .when(F.contains(low, F.lit("billion")) | F.contains(c, F.lit("B")), number * 1e9).otherwise(number))
    number = F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(low, r"\d\s*(million|billion|thousand|m\b|b\b|k\b)", 1)
    factor = (F.when(unit.isin("million", "m"), 1e6).when(unit.isin("billion", "b"), 1e9)
              .when(unit.isin("thousand", "k"), 1e3).otherwise(1.0))
    return number * factor


def place_regex(places, ignore_case: bool = False) -> str:
    """One alternation of a caller's place names (longest first, so the longest name wins)."""
    names = sorted(places, key=lambda n: (-len(n), n))
    return ("(?i)" if ignore_case else "") + r"\b(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")\b"


# Patterns of the compact extractor (kind, pattern, confidence).
COMPACT = [
    P.Pattern("person", r"\b[A-Z][a-z]{2,15} [A-Z][a-z]{2,15}\b", "person", 0.75),
    P.Pattern("org", r"\b[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)* (?:Inc|LLC|Corp|Ltd|Foundation|Group|Partners|Company|Co|Association)\b", "org", 0.75),
    P.Pattern("date", r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4})\b", "date", 0.75),
    P.Pattern("amount", r"\$[\d,]+(?:\.\d{2})?(?:[MBK])?", "amount", 0.75),
    P.Pattern("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email", 0.75),
]
COMPACT[1] = COMPACT[1]._replace(loop_form=r"\b" + P.up_to_last(r"[A-Z][a-zA-Z]++", _suffixes(COMPACT[1].regex), " "),
                                dead_run=r"\b[A-Z][a-zA-Z]++(?: [A-Z][a-zA-Z]++)*+")
# Capitalised pairs that are no persons.
NOT_PERSONS = ["the new", "new york", "los angeles", "san francisco", "las vegas"]


def compact_entities(docs: DataFrame, places=(), max_dates: int | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The short entity set: distinct persons, organisations, places, dates (the first ``max_dates`` if given), amounts, e-mails."""
    pats = list(COMPACT)
    if places:
        pats.append(P.Pattern("location", place_regex(places, True), "location", 0.75))
    v = extract_values(docs, pats, id_col, text_col)
    kind, val = F.col("pattern"), F.col("value")
    v = v.where(~((kind == "person") & F.lower(val).isin(NOT_PERSONS)) & ~((kind == "amount") & (F.length(val) <= 3)))
    if max_dates is not None:
        v = v.where(~((kind == "date") & (F.col("ordinal") >= max_dates)))
    shown = F.when(kind == "email", F.lower(val)).when(kind == "location", F.initcap(val)).otherwise(val)
    key = F.when(kind == "person", F.lower(val)).when(kind == "date", F.col("ordinal").cast("string")).otherwise(shown)
    return (v.groupBy(id_col, kind.alias("kind"), key.alias("k")).agg(F.min_by(shown, F.col("ordinal")).alias("value"))
            .drop("k"))


# ---------------------------------------------------------------- merging and counting

def merge_entities(*tables: DataFrame, keep_min_len: int = 3, per_kind: int | None = None, confidence: float = 0.75,
                   id_col: str = "doc_id") -> DataFrame:
    """Entities of several extractors: one per (document, kind, value without case), the first ``per_kind`` if given."""
    rows = tables[0].select(id_col, "kind", "value")
    for t in tables[1:]:
        rows = rows.unionByName(t.select(id_col, "kind", "value"))
    one = (rows.where(F.length("value") >= keep_min_len)
           .groupBy(id_col, "kind", F.lower("value").alias("k")).agg(F.min("value").alias("value")))
    if per_kind is not None:
        w = Window.partitionBy(id_col, "kind").orderBy("k")
        one = one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_kind)
    return one.select(id_col, "kind", "value", F.lit(confidence).alias("confidence"))


def entity_totals(merged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, n, total): entities of each kind of a document, and of all kinds."""
    n = merged.groupBy(id_col, "kind").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy(id_col)))


def mention_counts(entities: DataFrame, min_len: int = 3) -> DataFrame:
    """Mentions and documents of each (name without case, kind)."""
    return (entities.where(F.length("value") >= min_len).groupBy(F.lower("value").alias("name"), "kind")
            .agg(F.min("value").alias("shown"), F.count("*").alias("mentions")))


def kind_counts(docs: DataFrame, patterns=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of matches of each pattern per document, without materialising them."""
    pats = patterns or [p for p in COMPACT]
    return docs.select(id_col, ascii_fold(text_col).alias("_t")).select(id_col, *[P.count_of("_t", p).cast("bigint").alias(f"n_{p.name}") for p in pats])


# ---------------------------------------------------------------- relations

# Relation types in the order they are tried, with their context pattern.
RELATIONS = [
    ("works_at", r"\b(?:works?\s+(?:at|for)|employed\s+(?:at|by)|(?:is|was)\s+(?:at|with))\b"),
    ("located_in", r"\b(?:(?:is|are|was|were)\s+(?:in|at|from)|based\s+in|located\s+in)\b"),
    ("contacted", r"\b(?:contact(?:ed)?|reach(?:ed)?|call(?:ed)?|email(?:ed)?)\b"),
    ("sent_to", r"\b(?:sent?\s+to|forward(?:ed)?\s+to|cc[:\s]|bcc[:\s])\b"),
    ("received_from", r"\b(?:from|received\s+from|got\s+from)\b"),
    ("mentions", r"\b(?:mention(?:ed|s)?|refer(?:red|s)?\s+to|about)\b"),
    ("owns", r"\b(?:owns?|has|possesses?|belongs?\s+to)\b"),
    ("created_by", r"\b(?:created?\s+by|made\s+by|authored?\s+by|written\s+by)\b"),
]


def relation_type(context: Column, short: int = 50) -> Column:
    low = F.lower(context)
    out = None
    for name, regex in RELATIONS:
        hit = F.regexp_like(low, F.lit(regex))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(F.length(context) < short, "associated_with")


def proximity_relations(docs: DataFrame, patterns, reach: int = 200,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of spans whose gap is 1..``reach`` characters, with a relation read from the gap.

    A range join on character position: spans meet on (document, position bucket),
    so the work per key is bounded by the spans that fit into two buckets however
    long the document is.  The gap text travels with the left span.
    """
    folded = docs.select(id_col, ascii_fold(text_col).alias("_t"))
    found = F.transform(P.all_spans("_t", patterns, 0), lambda s: F.struct(
        s["pattern"].alias("type"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"),
        F.substring("_t", s["end"] + 1, F.lit(reach)).alias("tail")))
    spans = folded.select(id_col, F.inline(found)).distinct()
    left = spans.select(id_col, F.col("type").alias("from_type"), F.col("value").alias("from_value"),
                        F.col("start").alias("from_start"), F.col("end").alias("_e"), "tail",
                        F.explode(F.array(F.floor(F.col("end") / reach), F.floor(F.col("end") / reach) + 1)).alias("_b"))
    right = spans.select(id_col, F.col("type").alias("to_type"), F.col("value").alias("to_value"),
                         F.col("start").alias("to_start"), F.floor(F.col("start") / reach).alias("_b"))
    gap = F.col("to_start") - F.col("_e")
    pairs = left.join(right, [id_col, "_b"]).where((gap > 0) & (gap <= reach))
    context = F.regexp_replace(F.substring("tail", F.lit(1), gap), r"^\s+|\s+$", "")
    return (pairs.select(id_col, "from_type", "from_value", "from_start", "to_type", "to_value", "to_start",
                         gap.alias("distance"), relation_type(context).alias("relationship"), F.left(context, F.lit(50)).alias("context"))
            .where("relationship is not null"))


# ---------------------------------------------------------------- encoded tokens, amounts, code words

# Encoded-token patterns, and the count a value must exceed.
ENCODED = [("base64", r"\b[A-Za-z0-9+/]{20,}={0,2}\b", 0), ("hex", r"\b[0-9a-fA-F]{16,}\b", 0),
           ("alphanumeric_code", r"\b[A-Z]{1,2}\d{1,2}[A-Z]{1,2}\d{1,2}[A-Z\d]*\b", 2),
           ("recurring_amount", r"\$[\d,]+\.?\d*", 3)]


def encoded_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_pattern: int | None = None) -> DataFrame:
    """Base64, hex, letter-digit codes and repeated amounts of each document with counts.

    ``per_pattern`` keeps the most frequent codes and amounts of a document.
    """
    pats = [P.Pattern(n, r, "encoded", 1.0) for n, r, _ in ENCODED]
    counts = extract_values(docs, pats, id_col, text_col).groupBy(id_col, "pattern", "value").agg(F.count("*").alias("n"))
    rule = F.lit(False)
    for name, _, over in ENCODED:
        rule = rule | (F.col("pattern") == name) & (F.col("n") > over)
    counts = counts.where(rule)
    if per_pattern is None:
        return counts
    w = Window.partitionBy(id_col, "pattern").orderBy(F.desc("n"), "value")
    counted = F.col("pattern").isin([name for name, _, over in ENCODED if over])
    return counts.withColumn("rn", F.row_number().over(w)).where(~counted | (F.col("rn") <= per_pattern)).drop("rn")


def amount_anomalies(amounts: DataFrame, group: str, amount: str, span: int | None = None) -> DataFrame:
    """Recurring, round and evenly stepped amounts of each group.

    Amounts are first reduced to distinct (group, amount) counts.  Steps compare each
    distinct amount with the next two; the ordered scan of a group is cut at quantiles
    of its amounts into slices that also carry the two amounts following, so a large
    group is many tasks.  ``span`` cuts at its multiples instead.
    """
    counts = amounts.groupBy(F.col(group).alias("grp"), F.col(amount).alias("amount")).agg(F.count("*").alias("n"))
    recurring = counts.where("n > 2").select("grp", F.lit("recurring").alias("kind"), "amount", F.col("n").cast("double").alias("detail"))
    a = F.col("amount")
    divisor = F.when(a % 1000 == 0, 1000.0).when(a % 500 == 0, 500.0).when(a % 100 == 0, 100.0)
    rounds = counts.where(a >= 100).select("grp", F.lit("round").alias("kind"), "amount", divisor.alias("detail")).where("detail is not null")
    # slices: each holds its own amounts and borrows the two smallest of the slices after it
    sliced = counts.select("grp", "amount")
    sliced = group_slices(sliced, "grp", "amount", "slice") if span is None else sliced.withColumn("slice", F.floor(a / span))
    firsts = (sliced.withColumn("rn", F.row_number().over(Window.partitionBy("grp", "slice").orderBy("amount")))
              .where("rn <= 2").groupBy("grp", "slice").agg(F.array_sort(F.collect_list("amount")).alias("lead_in")))
    nxt = Window.partitionBy("grp").orderBy("slice")
    following = firsts.select("grp", "slice", F.slice(F.concat(
        F.coalesce(F.lead("lead_in", 1).over(nxt), F.array().cast("array<double>")),
        F.coalesce(F.lead("lead_in", 2).over(nxt), F.array().cast("array<double>"))), 1, 2).alias("after"))
    borrowed = following.select("grp", "slice", F.explode("after").alias("amount"), F.lit(False).alias("own"))
    rows = sliced.select("grp", "slice", "amount", F.lit(True).alias("own")).unionByName(borrowed)
    w = Window.partitionBy("grp", "slice").orderBy("amount")
    steps = rows.select("grp", "amount", "own", (F.lead("amount", 1).over(w) - a).alias("d1"),
                        (F.lead("amount", 2).over(w) - F.lead("amount", 1).over(w)).alias("d2"))
    seqs = steps.where("own and abs(d1 - d2) < 0.01 and d1 > 0").select(
        "grp", F.lit("sequence").alias("kind"), "amount", F.round("d1", 6).alias("detail"))
    return recurring.unionByName(rounds).unionByName(seqs)


def code_words(docs: DataFrame, known=(), id_col: str = "doc_id", text_col: str = "text", with_position: bool = True,
               frequent: int | None = None, top: int | None = None) -> DataFrame:
    """Capitalised words that look like code words, with a suspicion score above 30.

    ``frequent`` looks at the most frequent words of a document only, ``top`` keeps its first code words.

    +40 for a known code, up to 30 by frequency above five, +20 when the word follows
    a lower-case sentence start somewhere in the text.
    """
    folded = docs.select(id_col, ascii_fold(text_col).alias("_t"))
    # the text after each ". lower-case" start up to the line end, where the third rule looks
    late = F.array_join(F.regexp_extract_all("_t", F.lit(r"\. [a-z]+.*"), F.lit(0)), "\n")
    late_words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(late, r"(?m)^\. [a-z]+", ""), F.lit(r"\b[A-Z][A-Za-z]+\b"), F.lit(0)))
    found = folded.select(id_col, late_words.alias("_late"), F.regexp_extract_all("_t", F.lit(r"\b[A-Z][A-Za-z]+\b"), F.lit(0)).alias("w"))
    rows = found.select(id_col, F.explode("w").alias("word"))
    counts = rows.groupBy(id_col, "word").agg(F.count("*").alias("frequency"))
    if with_position:
        late_rows = found.select(id_col, F.explode("_late").alias("word"), F.lit(20).alias("late"))
        counts = counts.join(late_rows, [id_col, "word"], "left").na.fill({"late": 0})
    else:
        counts = counts.withColumn("late", F.lit(0))
    n = F.col("frequency")
    score = (F.when(F.upper("word").isin([k.upper() for k in known]), 40).otherwise(0)
             + F.when(n > 5, F.least(n * 2, F.lit(30))).otherwise(0) + F.col("late"))
    w = Window.partitionBy(id_col).orderBy(F.desc("frequency"), "word")
    if frequent is not None:
        counts = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= frequent)
    found = counts.withColumn("suspicion", score).where("suspicion > 30")
    if top is not None:
        found = found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top)
    return found.select(id_col, "word", "frequency", F.col("suspicion").cast("bigint").alias("suspicion"))
