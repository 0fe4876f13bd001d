"""Claims, papers and co-travel over whole tables (survey rows D16, D18-D24)."""

from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..operators import claims as C
from . import sqltext as S
from .registry import query

_PAPER = """pp AS (SELECT conv_id * 1000 + turn AS doc_id, 'We show that ' || replace(text, chr(10), ' ') || ' Our data suggest that ' || replace(reverse(text), chr(10), ' ') AS text FROM conversations)"""


def papers(t):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    back = F.replace(F.reverse("text"), F.lit("\n"), F.lit(" "))
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
                                     F.concat(F.lit("We show that "), flat, F.lit(" Our data suggest that "), back).alias("text"))


def _field_sql(c):
    n = {k: "(" + " + ".join(f"contains(lower({c}), '{w}')::INT" for w in ws) + ")" for k, ws in C.FIELDS.items()}
    whens = " ".join(f"WHEN {n[k]} > 0 AND {n[k]} >= greatest({', '.join(n.values())}) THEN '{k}'" for k in n)
    return f"CASE {whens} ELSE 'interdisciplinary' END"


@query("mine_claims_D18", rf"""WITH {_PAPER}, m AS (SELECT doc_id, text, list_filter(list_transform(list_concat(list_concat(list_concat(list_concat({', '.join(
 [f"regexp_extract_all(rtrim(text), '{r}', 1)" if g == 1 else f"list_transform(regexp_extract_all(rtrim(text), '{r}', 1), lambda x, i: x || ' ' || regexp_extract_all(rtrim(text), '{r}', 2)[i])" for r, g in C.CLAIM_PATTERNS][:2])}), {
 f"regexp_extract_all(rtrim(text), '{C.CLAIM_PATTERNS[2][0]}', 1)"}), {f"list_transform(regexp_extract_all(rtrim(text), '{C.CLAIM_PATTERNS[3][0]}', 1), lambda x, i: x || ' ' || regexp_extract_all(rtrim(text), '{C.CLAIM_PATTERNS[3][0]}', 2)[i])"}), {
 f"regexp_extract_all(rtrim(text), '{C.CLAIM_PATTERNS[4][0]}', 1)"}), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), lambda c: length(c) > 30 AND length(c) < 500) AS c FROM pp)
SELECT doc_id, {_field_sql('text')} AS field, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS ord, unnest(c) AS claim FROM m""")
def _(t):
    return C.mine_claims(papers(t))


@query("classify_field_D19", f"SELECT doc_id, {_field_sql('text')} AS field FROM documents")
def _(t):
    return t("documents").select("doc_id", C.classify_field("text").alias("field"))


_CL = """claims AS (SELECT item_id AS claim_id, text AS claim, 'field_' || length(text) % 4 AS field, CAST(1980 + length(text) % 40 AS INTEGER) AS year FROM benchmark)"""


def claim_table(t):
    n = F.length("text")
    return t("benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"),
                                 F.concat(F.lit("field_"), F.pmod(n, F.lit(4)).cast("string")).alias("field"), (1980 + F.pmod(n, F.lit(40))).alias("year"))


# wordings that occur in the corpus
OPPOSITES = [("und", "und der"), ("les", "les de"), ("license", "token")]


@query("contradiction_sides_D20", f"""WITH c AS (SELECT doc_id AS claim_id, lower(text) AS l FROM documents), s AS ({' UNION ALL '.join(
 f"SELECT '{p}' AS pos, '{n}' AS neg, '{s}' AS side, claim_id FROM c WHERE contains(l, '{w}')" for p, n in OPPOSITES for s, w in (('pos', p), ('neg', n)))})
SELECT * FROM s WHERE (pos, neg) IN (SELECT (pos, neg) FROM s GROUP BY pos, neg HAVING count(DISTINCT side) = 2)""")
def _(t):
    return C.contradiction_sides(t("documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim")), OPPOSITES).select("pos", "neg", "side", "claim_id")


_TOKP = r"list_distinct(list_filter(string_split_regex(lower(claim), '\s+'), lambda t: t <> ''))"


@query("era_contradictions_D20_F8", f"""WITH {_CL}, r AS (SELECT field, year, claim, min(claim_id) AS rep, count(*) AS copies, {_TOKP} AS tok FROM claims GROUP BY field, year, claim),
p AS (SELECT a.field, a.rep AS rep_a, b.rep AS rep_b, a.year AS year_a, b.year AS year_b, len(list_intersect(a.tok, b.tok)) AS shared, a.copies AS copies_a, b.copies AS copies_b
  FROM r a JOIN r b ON a.rep < b.rep AND a.field = b.field AND abs(a.year - b.year) > 5) SELECT * FROM p WHERE shared > 3""")
def _(t):
    return C.era_contradictions(claim_table(t))


@query("cross_field_patterns_D21", f"""WITH {_CL}, r AS (SELECT field, claim, min(claim_id) AS rep, list_filter({_TOKP}, lambda t: NOT list_contains({S.lst(W.CLAIM_STOP)}, t)) AS tok FROM claims GROUP BY field, claim),
p AS (SELECT a.rep AS rep_a, b.rep AS rep_b, len(list_intersect(a.tok, b.tok)) AS shared, a.field AS field_a, b.field AS field_b FROM r a JOIN r b ON a.rep < b.rep AND a.field <> b.field)
SELECT *, least(shared / 10.0, 1.0)::DOUBLE AS confidence FROM p WHERE shared >= 3""")
def _(t):
    return C.cross_field_patterns(claim_table(t))


@query("knowledge_gaps_D22", f"""WITH g AS (SELECT conv_id * 1000 + turn AS claim_id, 'how ' || text || ' is unclear' AS claim FROM conversations)
SELECT claim_id, '[' || 'all' || '] ' || claim AS gap FROM g WHERE {' OR '.join(f"regexp_matches(claim, '{r}')" for r in C.GAP_PATTERNS)}""")
def _(t):
    c = t("conversations")
    text = F.concat(F.lit("how "), "text", F.lit(" is unclear"))
    return C.knowledge_gaps(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.lit("all").alias("field"), text.alias("claim")), None)


@query("paper_connections_D23", """
WITH s AS (SELECT l_orderkey AS doi, 'S' || l_suppkey AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS i, 'P' || l_partkey AS p FROM lineitem)
SELECT CAST(doi AS VARCHAR) AS from_doi, x AS from_author, NULL::VARCHAR AS to_doi, 'authored' AS type, 0.0::DOUBLE AS score FROM s
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority, NULL, 'funded', CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 1.0 ELSE 0.0 END FROM orders WHERE o_orderkey IN (SELECT doi FROM s)
UNION ALL SELECT CAST(doi AS VARCHAR), '', p, 'cites', 0.0 FROM s""")
def _(t):
    li = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("z"))
    p = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("doi"), F.transform("z", lambda s: F.concat(F.lit("S"), s["l_suppkey"].cast("string"))).alias("authors"),
        F.array("o_orderpriority").alias("funders"), F.transform("z", lambda s: F.concat(F.lit("P"), s["l_partkey"].cast("string"))).alias("refs"))
    return C.connections(p, ["urgent"])


@query("paper_sections_D16", r"""WITH x AS (SELECT doc_id, 'Abstract: ' || replace(text, chr(10), ' ') || chr(10) || chr(10) || 'Funded by Source ' || source || '. Grant no. AB-' || doc_id || ' ' || chr(10) || 'In conclusion ' || lang || ' holds. See 10.1234/x' || doc_id || ' ' AS text FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_extract(text, '(?is)\babstract[:\s]+(.{100,}?)(?:\n\s*\n|\bintroduction\b|$)', 1), '\s+', ' ', 'g')) AS abstract,
 array_to_string(regexp_extract_all(text, '(?i)((?:funded|supported) by [^.\n]+)', 1), '|') AS funding, array_to_string(regexp_extract_all(text, '(?i)((?:we conclude|in conclusion)[^.\n]+\.)', 1), '|') AS conclusions, 'AB-' || doc_id AS grants, '10.1234/x' || doc_id AS dois FROM x""")
def _(t):
    x = t.text("documents", "doc_id").select("doc_id", F.concat(F.lit("Abstract: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n\nFunded by Source "), "source",
        F.lit(". Grant no. AB-"), F.col("doc_id").cast("string"), F.lit(" \nIn conclusion "), "lang", F.lit(" holds. See 10.1234/x"), F.col("doc_id").cast("string"), F.lit(" ")).alias("text"))
    p = C.paper_sections(x)
    return p.select("doc_id", "abstract", *[F.array_join(c, "|").alias(c) for c in ("funding", "grants", "conclusions", "dois")])


_TRIPS = "tr AS (SELECT DISTINCT l_orderkey AS trip_id, 'S' || l_suppkey AS party FROM lineitem WHERE l_suppkey <> 0)"


def trips(t):
    party = F.when(F.col("l_suppkey") == 0, "UNIDENTIFIED MALE").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.collect_list(party).alias("parties"))


@query("party_counts_D24", f"WITH {_TRIPS} SELECT party, count(*) AS trips FROM tr GROUP BY 1")
def _(t):
    return C.party_counts(trips(t))


@query("party_dossiers_D24", f"""WITH {_TRIPS}, c AS (SELECT party, count(*) AS trips FROM tr GROUP BY 1 HAVING count(*) >= 3),
p AS (SELECT a.party, b.party AS other, count(*) AS n FROM tr a JOIN tr b ON a.trip_id = b.trip_id AND a.party <> b.party GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n DESC, other) AS rn FROM p)
SELECT c.party, trips, coalesce(count(other), 0) AS companions, string_agg(other || ':' || n, ',' ORDER BY rn) AS top_companions FROM c LEFT JOIN r ON r.party = c.party GROUP BY 1, 2""")
def _(t):
    return C.party_dossiers(trips(t))


@query("category_fields_D19", f"""WITH c AS (SELECT p_partkey AS doc_id, [CASE p_size % 5 WHEN 0 THEN 'cs.CL' WHEN 1 THEN 'q-bio' WHEN 2 THEN 'hep.th' WHEN 3 THEN 'stat.ML' ELSE 'math' END, 'cs.' || p_brand, lower(p_type)] AS cats FROM part),
x AS (SELECT doc_id, split_part(unnest(cats), '.', 1) AS p FROM c), m AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in W.CATEGORY_FIELDS.items())}) AS v(p, field))
SELECT doc_id, string_agg(DISTINCT field, '|' ORDER BY field) AS fields FROM x JOIN m USING (p) GROUP BY 1""")
def _(t):
    k = F.col("p_size") % 5
    first = F.when(k == 0, "cs.CL").when(k == 1, "q-bio").when(k == 2, "hep.th").when(k == 3, "stat.ML").otherwise("math")
    cats = t("part").select(F.col("p_partkey").alias("doc_id"), F.array(first, F.concat(F.lit("cs."), "p_brand"), F.lower("p_type")).alias("cats"))
    return cats.select("doc_id", F.array_join(C.category_fields("cats"), "|").alias("fields"))
