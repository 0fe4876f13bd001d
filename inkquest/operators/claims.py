"""Claims of papers: mining, fields, contradictions, shared concepts, gaps, connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X, wordlists as W
from ..functions.text import col

# Fields and their keywords; the first field wins ties.
FIELDS = {
    "mathematics": ["theorem", "proof", "lemma", "conjecture", "topology", "algebra", "calculus"],
    "neuroscience": ["neuron", "brain", "cortex", "synaptic", "neural", "cognitive"],
    "biology": ["cell", "gene", "protein", "organism", "evolution", "species"],
    "psychology": ["behavior", "cognitive", "mental", "emotion", "perception", "memory"],
    "medicine": ["patient", "treatment", "clinical", "disease", "diagnosis", "therapy"],
    "physics": ["quantum", "particle", "energy", "force", "field", "relativity"],
    "art": ["aesthetic", "visual", "artistic", "creativity", "perception", "beauty"],
}
# Claim sentences (pattern, number of groups).
CLAIM_PATTERNS = [
    (r"(?i)we (?:show|demonstrate|find|prove|establish|conclude) that (.+?)(?:\.|$)", 1),
    (r"(?i)our (?:results|findings|data) (?:show|indicate|suggest|demonstrate) that (.+?)(?:\.|$)", 1),
    (r"(?i)this (?:study|research|work|paper) (?:shows|demonstrates|establishes) that (.+?)(?:\.|$)", 1),
    (r"(?i)(?:it is|we found that) (.+?) (?:is|are) (.+?)(?:\.|$)", 2),
    (r"(?i)(?:these|our) (?:results|findings) (?:provide evidence|support the hypothesis) that (.+?)(?:\.|$)", 1),
]
# Opposite wordings.
NEGATIONS = [("is", "is not"), ("are", "are not"), ("does", "does not"), ("can", "cannot"), ("increase", "decrease"),
             ("positive", "negative"), ("support", "contradict"), ("confirm", "reject")]
# Hedging that marks a knowledge gap.
GAP_PATTERNS = [
    r"(?i)(?:remains|is|are) (?:unclear|unknown|poorly understood)",
    r"(?i)(?:further|more) (?:research|study|investigation) (?:is|are) needed",
    r"(?i)(?:the mechanism|how|why) .{10,100} (?:is|remains) (?:unclear|unknown)",
    r"(?i)little is known about",
    r"(?i)(?:no|few) studies have (?:examined|investigated|explored)",
]


def classify_field(x, fields=FIELDS, default: str = "interdisciplinary") -> Column:
    """Field with most distinct keywords in the text; the first one wins ties."""
    low = F.lower(col(x))
    best, top = F.lit(default), F.lit(0)
    for name, words in fields.items():
        n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        best = F.when(n > top, name).otherwise(best)
        top = F.greatest(top, n)
    return best


def category_fields(categories, fields=W.CATEGORY_FIELDS) -> Column:
    """Fields of an array of categories such as ``cs.CL`` by their prefix, each once, in order."""
    prefix = F.transform(col(categories), lambda c: F.split_part(c, F.lit("."), F.lit(1)))
    known = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(prefix, lambda p: F.try_element_at(known, p)))))


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def mine_claims(papers: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_paper: int | None = None) -> DataFrame:
    """Claims of 31 to 499 characters, in pattern and text order; ``per_paper`` keeps the first ones."""
    c = F.rtrim(col(text_col))
    found = []
    for regex, groups in CLAIM_PATTERNS:
        parts = [F.regexp_extract_all(c, F.lit(regex), F.lit(g)) for g in range(1, groups + 1)]
        found.append(parts[0] if groups == 1 else F.zip_with(parts[0], parts[1], lambda a, b: F.concat_ws(" ", a, b)))
    clean = F.transform(F.concat(*found), X.collapse_whitespace)
    kept = _first(F.filter(clean, lambda t: (F.length(t) > 30) & (F.length(t) < 500)), per_paper)
    return papers.select(id_col, classify_field(text_col).alias("field"), F.posexplode(kept).alias("ord", "claim"))


def contradiction_sides(claims: DataFrame, negations=NEGATIONS) -> DataFrame:
    """Opposed claims in factored form: (pos, neg, side, claim_id).

    Every claim on the ``pos`` side contradicts every claim on the ``neg`` side of the
    same wording pair; listing the two sides carries all pairs without writing them out.
    """
    low = F.lower("claim")
    tags = F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(w)), F.struct(F.lit(p).alias("pos"), F.lit(n).alias("neg"), F.lit(s).alias("side")))
        for p, n in negations for s, w in (("pos", p), ("neg", n))]))
    rows = claims.select("claim_id", F.inline(tags))
    both = rows.groupBy("pos", "neg").agg(F.countDistinct("side").alias("s")).where("s = 2").drop("s")
    return rows.join(F.broadcast(both), ["pos", "neg"])


def _token_overlap(claims: DataFrame, min_shared: int, stop=(), within: str | None = None) -> DataFrame:
    """Pairs of distinct claim texts (rep_a, rep_b, shared) with at least ``min_shared`` common words.

    Exact: words are ordered from rare to frequent and all but the ``min_shared - 1``
    most frequent words of a claim are join keys, so two claims above the limit must
    meet on one of them.  Copies of a claim meet once, as one representative; with
    ``within`` only claims of one value of that column meet.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower("claim"), r"\s+"), lambda t: (t != "") & ~F.array_contains(X.str_array(list(stop) or [""]), t)))
    group = F.col(within) if within else F.lit(0)
    t = claims.select("rep", group.alias("g"), tokens.alias("tok")).where(F.size("tok") >= min_shared)
    rows = t.select("rep", "g", F.size("tok").alias("m"), F.explode("tok").alias("w"))
    freq = rows.groupBy("w").agg(F.count("*").alias("c"))
    order = Window.partitionBy("rep").orderBy("c", "w")
    keys = rows.join(freq, "w").withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.col("m") - (min_shared - 1)).select("rep", "g", "w")
    cand = keys.select(F.col("rep").alias("rep_a"), "g", "w").join(keys.select(F.col("rep").alias("rep_b"), "g", "w"), ["g", "w"]).where("rep_a < rep_b").select("rep_a", "rep_b").distinct()
    a = t.select(F.col("rep").alias("rep_a"), F.col("tok").alias("ta"))
    b = t.select(F.col("rep").alias("rep_b"), F.col("tok").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return cand.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", shared.cast("bigint").alias("shared")).where(F.col("shared") >= min_shared)


def _representatives(claims: DataFrame, *by) -> DataFrame:
    return claims.groupBy(*by, "claim").agg(F.min("claim_id").alias("rep"), F.count("*").alias("copies"))


def era_contradictions(claims: DataFrame, years_apart: int = 5, min_shared: int = 4) -> DataFrame:
    """Claims of one field more than ``years_apart`` years apart with many common words.

    Rows are pairs of distinct (field, year, text) with the number of copies on each side.
    """
    reps = _representatives(claims, "field", "year")
    pairs = _token_overlap(reps, min_shared, within="field")
    side = reps.select("rep", "field", "year", "copies")
    a = side.select(F.col("rep").alias("rep_a"), F.col("field").alias("field_a"), F.col("year").alias("year_a"), F.col("copies").alias("copies_a"))
    b = side.select(F.col("rep").alias("rep_b"), F.col("field").alias("field_b"), F.col("year").alias("year_b"), F.col("copies").alias("copies_b"))
    return (pairs.join(a, "rep_a").join(b, "rep_b").where(
        (F.col("field_a") == F.col("field_b")) & (F.abs(F.col("year_a") - F.col("year_b")) > years_apart))
        .select(F.col("field_a").alias("field"), "rep_a", "rep_b", "year_a", "year_b", "shared", "copies_a", "copies_b"))


def cross_field_patterns(claims: DataFrame, min_shared: int = 3, limit: int | None = None, stop=W.CLAIM_STOP) -> DataFrame:
    """Claims of different fields that share words, most shared first."""
    reps = _representatives(claims, "field")
    pairs = _token_overlap(reps, min_shared, stop)
    side = reps.select("rep", "field")
    out = (pairs.join(side.select(F.col("rep").alias("rep_a"), F.col("field").alias("field_a")), "rep_a")
           .join(side.select(F.col("rep").alias("rep_b"), F.col("field").alias("field_b")), "rep_b")
           .where("field_a <> field_b").withColumn("confidence", F.least(F.col("shared") / 10, F.lit(1.0))))
    return out.orderBy(F.desc("shared"), "rep_a", "rep_b").limit(limit) if limit else out


def knowledge_gaps(claims: DataFrame, limit: int | None = None) -> DataFrame:
    hit = F.lit(False)
    for r in GAP_PATTERNS:
        hit = hit | F.regexp_like("claim", F.lit(r))
    out = claims.where(hit).select("claim_id", F.concat(F.lit("["), "field", F.lit("] "), "claim").alias("gap"))
    return out.orderBy("claim_id").limit(limit) if limit else out


def connections(papers: DataFrame, funder_terms=(), max_authors: int | None = None, max_funders: int | None = None,
                max_refs: int | None = None) -> DataFrame:
    """authored, funded (scored by the caller's terms) and cites rows of (doi, authors, funders, refs)."""
    none = F.lit(None).cast("string")
    score = F.lit(False)
    for t in funder_terms:
        score = score | F.contains(F.lower("x"), F.lit(t))
    def part(arr, n, kind, who, to, s):
        return papers.select("doi", F.explode(_first(F.col(arr), n)).alias("x")).select(
            F.col("doi").alias("from_doi"), who.alias("from_author"), to.alias("to_doi"), F.lit(kind).alias("type"), s.alias("score"))
    x = F.col("x")
    return (part("authors", max_authors, "authored", x, none, F.lit(0.0))
            .unionByName(part("funders", max_funders, "funded", x, none, score.cast("double")))
            .unionByName(part("refs", max_refs, "cites", F.lit(""), x, F.lit(0.0))))


# Section patterns of a paper.
SECTIONS = {
    "abstract": r"(?is)\babstract[:\s]+(.{100,}?)(?:\n\s*\n|\bintroduction\b|$)",
    "funding": r"(?i)((?:funded|supported) by [^.\n]+)",
    "grant": r"(?i)grant (?:no\.?|number)?\s*([A-Z0-9-]{4,})",
    "conclusion": r"(?i)((?:we conclude|in conclusion)[^.\n]+\.)",
    "doi": r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)",
}


def paper_sections(papers: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int | None = None,
                   first: dict[str, int] | None = None) -> DataFrame:
    """Abstract, funding and grant notes, conclusions and reference DOIs of a paper text.

    ``width`` cuts the abstract and ``first`` ({"funding": 20, ...}) keeps the first of a kind.
    """
    def every(k):
        return _first(F.array_distinct(F.regexp_extract_all(text_col, F.lit(SECTIONS[k]), F.lit(1))), (first or {}).get(k))
    abstract = X.collapse_whitespace(F.regexp_extract(text_col, SECTIONS["abstract"], 1))
    return papers.select(id_col, (F.left(abstract, F.lit(width)) if width else abstract).alias("abstract"),
                         every("funding").alias("funding"), every("grant").alias("grants"),
                         every("conclusion").alias("conclusions"), every("doi").alias("dois"))


# ---------------------------------------------------------------- co-travel

def party_counts(trips: DataFrame) -> DataFrame:
    """Trips per party over (trip_id, parties), unidentified parties left out."""
    p = trips.select("trip_id", F.explode(F.array_distinct("parties")).alias("party")).where(~F.contains(F.upper("party"), F.lit("UNIDENTIFIED")))
    return p.groupBy("party").agg(F.count("*").alias("trips"))


def party_dossiers(trips: DataFrame, min_trips: int = 3, top: int | None = None) -> DataFrame:
    """Parties with ``min_trips`` trips, the number of their companions and these by frequency, the first ``top`` if given."""
    clean = trips.select("trip_id", F.filter(F.array_distinct("parties"), lambda p: ~F.contains(F.upper(p), F.lit("UNIDENTIFIED"))).alias("p"))
    counts = party_counts(trips).where(F.col("trips") >= min_trips)
    pairs = clean.select(F.explode("p").alias("party"), "p").select("party", F.explode("p").alias("other")).where("party <> other")
    together = pairs.groupBy("party", "other").agg(F.count("*").alias("n"))
    total = together.groupBy("party").agg(F.count("*").alias("companions"))
    w = Window.partitionBy("party").orderBy(F.desc("n"), "other")
    best = together.withColumn("rn", F.row_number().over(w)).where(F.lit(True) if top is None else F.col("rn") <= top).groupBy("party").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "other", "n"))), lambda s: F.concat(s["other"], F.lit(":"), s["n"].cast("string"))), ",").alias("top_companions"))
    return counts.join(total, "party", "left").join(best, "party", "left").select(
        "party", "trips", F.coalesce("companions", F.lit(0)).cast("bigint").alias("companions"), "top_companions")
