"""Graph operators over the commerce graph of the given tables (survey rows F2, F7, G2, G3, G5, H1-H13)."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from . import sqltext as S
from .registry import query
from .source_plans import responses
from ..sources import readers as R

# Node ids: customers even, suppliers odd, nations and regions negative.
GRAPH = """ed AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, 'bought_from' AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT c_custkey * 2, CAST(-(c_nationkey + 10) AS BIGINT), 'located_in' FROM customer UNION ALL SELECT s_suppkey * 2 + 1, CAST(-(s_nationkey + 10) AS BIGINT), 'located_in' FROM supplier
 UNION ALL SELECT CAST(-(n_nationkey + 10) AS BIGINT), CAST(-(n_regionkey + 1) AS BIGINT), 'part_of' FROM nation),
nd AS (SELECT c_custkey * 2 AS id, 'person' AS type, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 2 + 1, 'company', s_name FROM supplier
 UNION ALL SELECT CAST(-(n_nationkey + 10) AS BIGINT), 'location', n_name FROM nation UNION ALL SELECT CAST(-(r_regionkey + 1) AS BIGINT), 'location', r_name FROM region),
un AS (SELECT src AS id, dst AS other FROM ed UNION SELECT dst, src FROM ed)"""
SC = """sco AS (SELECT id, CAST(length(name) * 7 % 60 AS INTEGER) AS suspicion, 50 AS pertinence FROM nd)"""


def edges(t):
    big = lambda c: c.cast("bigint")
    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.lit("bought_from").alias("type")).distinct()
    c = t("customer").select((F.col("c_custkey") * 2).alias("src"), big(-(F.col("c_nationkey") + 10)).alias("dst"), F.lit("located_in").alias("type"))
    s = t("supplier").select((F.col("s_suppkey") * 2 + 1).alias("src"), big(-(F.col("s_nationkey") + 10)).alias("dst"), F.lit("located_in").alias("type"))
    n = t("nation").select(big(-(F.col("n_nationkey") + 10)).alias("src"), big(-(F.col("n_regionkey") + 1)).alias("dst"), F.lit("part_of").alias("type"))
    return e.unionByName(c).unionByName(s).unionByName(n)


def nodes(t):
    def part(table, key, kind, name):
        return t(table).select(key.cast("bigint").alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
    return (part("customer", F.col("c_custkey") * 2, "person", "c_name").unionByName(part("supplier", F.col("s_suppkey") * 2 + 1, "company", "s_name"))
            .unionByName(part("nation", -(F.col("n_nationkey") + 10), "location", "n_name")).unionByName(part("region", -(F.col("r_regionkey") + 1), "location", "r_name")))


def node_scores(t):
    return nodes(t).select("id", F.pmod(F.length("name") * 7 + F.lit(0), F.lit(60)).alias("suspicion"), F.lit(50).alias("pertinence"))


@query("resolve_edges_F2", f"WITH {GRAPH} SELECT e.src, e.dst, e.type, a.name AS from_name, b.name AS to_name FROM ed e JOIN nd a ON a.id = e.src JOIN nd b ON b.id = e.dst")
def _(t):
    return G.resolve_edges(edges(t), nodes(t)).select("src", "dst", "type", "from_name", "to_name")


_NM = "nm AS (SELECT min(p_partkey) AS id, 'part' AS type, p_name AS name FROM part GROUP BY p_name UNION ALL SELECT CAST(100000 + n_nationkey AS BIGINT), 'nation', n_name FROM nation UNION ALL SELECT 200000 + s_suppkey, 'supplier', s_name FROM supplier)"


def names(t):
    p = t("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", F.lit("part").alias("type"), "name")
    n = t("nation").select((F.lit(100000) + F.col("n_nationkey")).cast("bigint").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("name"))
    s = t("supplier").select((F.lit(200000) + F.col("s_suppkey")).alias("id"), F.lit("supplier").alias("type"), F.col("s_name").alias("name"))
    return p.unionByName(n).unionByName(s)


@query("similar_names_F7", f"""WITH {_NM} SELECT a.id AS id_a, b.id AS id_b, round(1 - levenshtein(lower(a.name), lower(b.name))::DOUBLE / greatest(length(a.name), length(b.name)), 6) AS similarity
FROM nm a JOIN nm b ON a.type = b.type AND a.id < b.id WHERE 1 - levenshtein(lower(a.name), lower(b.name))::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.85""")
def _(t):
    return G.similar_names(names(t))


@query("similar_names_ratio_F7")
def _(t):
    return G.similar_names(names(t), method="ratio")


@query("edge_histogram_G2", f"WITH {GRAPH} SELECT type, count(*) AS n FROM ed WHERE type <> '' GROUP BY 1")
def _(t):
    return edges(t).where("type is not null and type <> ''").groupBy("type").agg(F.count("*").alias("n"))


@query("degree_centrality_G3", f"WITH {GRAPH}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1) SELECT nd.id, coalesce(n, 0) AS degree, least(coalesce(n, 0) * 5, 100) AS centrality FROM nd LEFT JOIN d ON d.id = nd.id")
def _(t):
    return G.degrees(edges(t), nodes(t)).select("id", "degree", "centrality")


@query("most_connected_G3", f"WITH {GRAPH}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1) SELECT name, coalesce(n, 0) AS degree FROM nd LEFT JOIN d ON d.id = nd.id ORDER BY coalesce(n, 0) DESC, nd.id LIMIT 20")
def _(t):
    return G.degrees(edges(t), nodes(t)).orderBy(F.desc("degree"), "id").limit(20).select("name", "degree")


_NC = f"""{GRAPH}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1), m AS (SELECT o_custkey * 2 AS id, count(DISTINCT o_orderkey) AS docs FROM orders GROUP BY 1),
x AS (SELECT nd.id, type, coalesce(n, 0) AS n, (SELECT max(n) FROM d) AS top, coalesce(docs, 0) AS docs FROM nd LEFT JOIN d ON d.id = nd.id LEFT JOIN m ON m.id = nd.id),
nc AS (SELECT id, type, n AS total_connections, round(n / top, 9) AS centrality, round(1 - 1 / (1 + docs), 9) AS corroboration, round(0.5 * n / top + 0.5 * (1 - 1 / (1 + docs)), 9)::DOUBLE AS relevance FROM x)"""


def _confidence(t):
    m = t("orders").select((F.col("o_custkey") * 2).alias("id"), F.col("o_orderkey").alias("source_id"))
    return G.node_confidence(nodes(t), edges(t), m)


@query("node_confidence_G5", f"WITH {_NC} SELECT id, total_connections, centrality, corroboration, relevance FROM nc")
def _(t):
    return _confidence(t)


@query("relevant_subjects_G5", f"WITH {_NC} SELECT id, round(nc.relevance, 3) AS relevance FROM nc WHERE type = 'person' AND nc.relevance > 0.3 ORDER BY nc.relevance DESC, id LIMIT 50")
def _(t):
    c = _confidence(t).join(nodes(t).where("type = 'person'").select("id"), "id", "left_semi")
    return c.where("relevance > 0.3").orderBy(F.desc("relevance"), "id").limit(50).select("id", F.round("relevance", 3).alias("relevance"))


@query("upsert_nodes_H1", """WITH x AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
n AS (SELECT DISTINCT 'person' AS type, 'Customer ' || o_custkey AS name, o_orderkey AS seq FROM x UNION ALL SELECT 'company', 'Supplier ' || l_suppkey, o_orderkey FROM x
  UNION ALL SELECT 'company', upper('Supplier ' || s_suppkey), -1 FROM supplier)
SELECT type, arg_min(name, seq) AS name, trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')) AS name_normalized, min(seq) AS source_id, count(*) AS mentions FROM n GROUP BY 1, 3""")
def _(t):
    new = R.response_part(R.parse_responses(responses(t)), "nodes").select("type", "name", "source_id", F.col("source_id").alias("seq"))
    old = t("supplier").select(F.lit("company").alias("type"), F.upper(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"))).alias("name"),
                               F.lit(-1).cast("bigint").alias("source_id"), F.lit(-1).cast("bigint").alias("seq"))
    return G.upsert_nodes(old, new).select("type", "name", "name_normalized", "source_id", "mentions")


@query("missing_endpoints_H1", "SELECT 'unknown' AS type, 'Supplier ' || l_suppkey AS name, 'supplier ' || l_suppkey AS name_normalized FROM (SELECT DISTINCT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')")
def _(t):
    parsed = R.parse_responses(responses(t))
    have = R.response_part(parsed, "nodes").where("type = 'person'").select(X.normalize_name("name").alias("name_normalized"))
    return G.missing_endpoints(R.response_part(parsed, "edges"), have)


@query("upsert_edges_H2", "SELECT o_custkey AS src, l_suppkey AS dst, l_returnflag AS type, CAST(arg_min(l_orderkey, l_orderkey) AS VARCHAR) AS excerpt, count(*) AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey GROUP BY 1, 2, 3")
def _(t):
    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_orderkey").cast("string").alias("excerpt"), F.col("l_orderkey").alias("seq"))
    return G.upsert_edges(e)


@query("pivot_properties_H3", "SELECT o_custkey AS node_id, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS o, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1")
def _(t):
    p = t("orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return G.pivot_properties(p).select("node_id", F.col("properties")["O"].alias("o"), F.col("properties")["F"].alias("f"))


@query("merge_nodes_H4", f"""WITH RECURSIVE {_NM}, pr AS (SELECT a.id AS x, b.id AS y FROM nm a JOIN nm b ON a.type = b.type AND a.id <> b.id WHERE 1 - levenshtein(lower(a.name), lower(b.name))::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.85),
reach AS (SELECT x, y FROM pr UNION SELECT r.x, p.y FROM reach r JOIN pr p ON p.x = r.y), comp AS (SELECT x AS id, least(min(y), x) AS c FROM reach GROUP BY x),
k AS (SELECT c, arg_min(comp.id, (length(name), comp.id)) AS canonical_id FROM comp JOIN nm ON nm.id = comp.id GROUP BY 1)
SELECT comp.id, canonical_id, name AS alias FROM comp JOIN k USING (c) JOIN nm ON nm.id = comp.id WHERE comp.id <> canonical_id""")
def _(t):
    n = names(t)
    return G.merge_nodes(n, G.name_links(n))


@query("rewire_edges_H4", f"""WITH {GRAPH}, mg AS (SELECT s_suppkey * 2 + 1 AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) * 2 + 1 AS c FROM supplier)
SELECT DISTINCT coalesce(a.c, src) AS src, coalesce(b.c, dst) AS dst, type FROM ed LEFT JOIN mg a ON a.id = src LEFT JOIN mg b ON b.id = dst WHERE coalesce(a.c, src) <> coalesce(b.c, dst)""")
def _(t):
    s = t("supplier")
    first = s.groupBy("s_nationkey").agg((F.min("s_suppkey") * 2 + 1).alias("canonical_id"))
    merged = s.join(first, "s_nationkey").select((F.col("s_suppkey") * 2 + 1).alias("id"), "canonical_id")
    return G.rewire(edges(t), merged)


@query("map_types_H5", f"WITH {GRAPH} SELECT id, CASE type WHEN 'company' THEN 'organization' WHEN 'person' THEN 'person' ELSE 'unknown' END AS type FROM nd")
def _(t):
    return G.map_types(nodes(t), {"company": "organization", "person": "person"}).select("id", "type")


@query("neighbours_H6", f"""WITH {GRAPH} SELECT id, other, name, rank FROM (SELECT un.id, other, name, CAST(row_number() OVER (PARTITION BY un.id ORDER BY other) AS INTEGER) AS rank FROM un JOIN nd ON nd.id = other
 WHERE un.id IN (SELECT id FROM nd WHERE type = 'company'))""")
def _(t):
    return G.neighbours(nodes(t).where("type = 'company'"), edges(t), nodes(t)).select("id", "other", "name", "rank")


_HUB = "hub AS (SELECT arg_min(id, (-n, id)) AS id FROM (SELECT id, count(*) AS n FROM un WHERE id % 2 = 1 GROUP BY 1))"


def hub(t):
    """The supplier with most neighbours."""
    n = G.undirected(edges(t)).where("id % 2 = 1").groupBy("id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "id").limit(1).select("id")


@query("ego_network_H7", f"""WITH {GRAPH}, {_HUB}, a AS (SELECT id FROM hub UNION SELECT other FROM un JOIN hub USING (id)) SELECT src, dst, type FROM ed WHERE src IN (FROM a) AND dst IN (FROM a)""")
def _(t):
    return G.ego_network(edges(t), hub(t), depth=1)


@query("bounded_paths_H8", f"""WITH {GRAPH}, g AS (SELECT id FROM nd WHERE name = 'NATION_3'), e AS (SELECT DISTINCT src, dst FROM ed)
SELECT a.src || ' -> ' || a.dst AS path FROM e a WHERE a.dst IN (FROM g) UNION SELECT a.src || ' -> ' || a.dst || ' -> ' || b.dst FROM e a JOIN e b ON b.src = a.dst WHERE b.dst IN (FROM g)""")
def _(t):
    n = nodes(t)
    return G.bounded_paths(edges(t), n.select("id"), n.where("name = 'NATION_3'").select("id"))


@query("hop_distances_H9", f"""WITH RECURSIVE {GRAPH}, {_HUB}, b AS (SELECT id, 0 AS distance FROM hub UNION SELECT other, distance + 1 FROM b JOIN un USING (id) WHERE distance < 4)
SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM b GROUP BY 1""")
def _(t):
    return G.hop_distances(edges(t), hub(t), 4)


@query("shortest_paths_H9", f"""WITH RECURSIVE {GRAPH}, {_HUB}, b AS (SELECT id, 0 AS distance FROM hub UNION SELECT other, distance + 1 FROM b JOIN un USING (id) WHERE distance < 4)
SELECT b.id, CAST(min(distance) AS INTEGER) AS distance FROM b JOIN nd ON nd.id = b.id WHERE nd.type = 'location' GROUP BY 1""")
def _(t):
    return G.shortest_paths(edges(t), hub(t), nodes(t).where("type = 'location'"), 4).select("id", "distance")


@query("propagate_scores_H10", f"""WITH {GRAPH}, {SC}, n AS (SELECT other AS id, count(*) AS k FROM un JOIN sco USING (id) WHERE suspicion >= 30 GROUP BY 1)
SELECT sco.id, CAST(least(suspicion + CASE WHEN suspicion >= 30 THEN 0 ELSE 15 * coalesce(k, 0) END, 100) AS BIGINT) AS suspicion, CAST(least(pertinence + CASE WHEN suspicion >= 30 THEN 0 ELSE 10 * coalesce(k, 0) END, 100) AS BIGINT) AS pertinence,
 CASE WHEN suspicion >= 30 THEN 0 ELSE coalesce(k, 0) END AS high_neighbours FROM sco LEFT JOIN n USING (id)""")
def _(t):
    return G.propagate_scores(node_scores(t), edges(t))


@query("page_rank_H12")
def _(t):
    return G.page_rank(edges(t), 3)


@query("communities_H12")
def _(t):
    return G.communities(edges(t), 3)


@query("components_H12", f"WITH {GRAPH} SELECT min(id) AS component, count(*) AS n FROM nd")
def _(t):
    c = G.components(edges(t).select(F.col("src").alias("id_a"), F.col("dst").alias("id_b")))
    return c.groupBy("component").agg(F.count("*").alias("n"))


@query("viewer_nodes_H13", f"""WITH {_NC} SELECT nd.id, CASE WHEN length(name) > 25 THEN left(name, 25) || '...' ELSE name END AS label, round(10 + least(40.0, 50 * centrality), 4)::DOUBLE AS size,
 CASE nd.type WHEN 'person' THEN '#e74c3c' WHEN 'company' THEN '#3498db' ELSE '#2ecc71' END AS colour FROM nc JOIN nd USING (id)""")
def _(t):
    return G.viewer_nodes(nodes(t).join(_confidence(t).select("id", "centrality"), "id"))


@query("harmonic_centrality_H12")
def _(t):
    return G.harmonic_centrality(edges(t))


@query("explore_names_H6", f"""WITH {GRAPH}, q AS (SELECT n_nationkey AS query_id, lower(n_name) AS q FROM nation), n2 AS (SELECT id, lower(name) AS x FROM nd UNION SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')) FROM nd),
h AS (SELECT DISTINCT query_id, id FROM q JOIN n2 ON contains(x, q)), b AS (SELECT src AS id, 'out' AS direction, type, dst AS other FROM ed UNION ALL SELECT dst, 'in', type, src FROM ed)
SELECT CAST(query_id AS BIGINT) AS query_id, b.id, direction, b.type, other, name AS other_name FROM h JOIN b ON b.id = h.id JOIN nd ON nd.id = other""")
def _(t):
    asked = t("nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.col("n_name").alias("name"))
    return G.explore_names(asked, edges(t), nodes(t))


# asked by an exact name, by a part of one, and by none
@query("network_centres_H7", f"""WITH {GRAPH}, d AS (SELECT id, count(*)::DOUBLE AS c FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1), n AS (SELECT nd.id, type, lower(name) AS name, coalesce(c, 0) AS c FROM nd LEFT JOIN d ON d.id = nd.id),
q AS (SELECT id AS query_id, CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN left(name, length(name) - 1) ELSE '' END AS q FROM n WHERE type = 'location' AND name <> ''),
e AS (SELECT query_id, id, c FROM q JOIN n ON name = q WHERE q <> ''), p AS (SELECT query_id, id, c FROM q JOIN n ON contains(name, q) WHERE q <> '' AND query_id NOT IN (SELECT query_id FROM e)),
u AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS r FROM (FROM e UNION ALL FROM p)), f AS (SELECT id FROM n WHERE type = 'person' ORDER BY c DESC, id LIMIT 5)
SELECT query_id, id FROM u WHERE r = 1 UNION ALL SELECT query_id, f.id FROM q, f WHERE q = ''""")
def _(t):
    n, e = nodes(t), edges(t)
    k = F.col("id") % 3
    name = F.when(k == 0, F.lower("name")).when(k == 1, F.expr("left(lower(name), length(name) - 1)")).otherwise("")
    asked = n.where("type = 'location'").select(F.col("id").alias("query_id"), name.alias("name"))
    degree = G.degrees(e, n).select("id", F.col("degree").cast("double").alias("centrality"))
    return G.centres(asked, n, degree)
