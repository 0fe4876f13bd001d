"""Sources and sinks over files that Spark writes from the given tables (survey rows A1-A19)."""

from pyspark.sql import functions as F

from ..operators import ingest as I, graph as G
from ..session import broadcast_checked, shared_dir
from ..sources import export as X, readers as R
from . import sqltext as S
from .registry import query


def _written(t, fmt, df, suffix="", **opts):
    path = shared_dir(t.spark, f"files-{fmt}") + suffix
    df.write.format(fmt).options(**opts).save(path)
    return path


@query("read_text_files_A1_A6", "SELECT count(DISTINCT source) AS sources, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT source, sha256(text) AS h FROM documents)")
def _(t):
    # one folder per source, one line per document: line breaks are kept as a mark
    d = t("documents").select("source", F.replace("text", F.lit("\n"), F.lit("\x1e")).alias("value"))
    path = shared_dir(t.spark, "files-text")
    d.write.partitionBy("source").option("lineSep", "\x1d").text(path)
    files = R.read_text_dir(t.spark, path)
    m = R.text_as_message(files).withColumn("src", F.regexp_extract("source", "source=([^/]+)", 1))
    texts = m.select("src", F.explode(F.split("body", "\x1d")).alias("x")).where("x <> ''").select(
        "src", F.sha2(F.replace("x", F.lit("\x1e"), F.lit("\n")), 256).alias("h"))
    counts = texts.groupBy("src", "h").agg(F.count("*").alias("n"))
    w = F.array_sort(F.collect_list(F.struct("p", "s")))
    # fold hashes in prefix groups, then the groups in order
    leaves = counts.groupBy(F.left("h", F.lit(2)).alias("p")).agg(F.array_join(F.array_sort(F.flatten(
        F.collect_list(F.array_repeat("h", F.col("n").cast("int"))))), "").alias("s"))
    digest = leaves.agg(F.sha2(F.array_join(F.transform(w, lambda z: z["s"]), ""), 256).alias("digest"))
    return digest.join(counts.agg(F.countDistinct("src").alias("sources")), F.lit(True))


@query("read_json_docs_A2", "SELECT doc_id, lang, n_chars FROM documents")
def _(t):
    # every written line is an object wrapping the documents of one source batch
    d = t("documents").select("source", F.floor(F.col("doc_id") / 50).alias("b"), F.struct("doc_id", "lang", "n_chars").alias("d"))
    wrapped = d.groupBy("source", "b").agg(F.collect_list("d").alias("documents")).select("documents")
    path = _written(t, "json", wrapped)
    return R.unwrap_json(t.spark.read.json(path)).select("doc_id", "lang", "n_chars")


@query("read_csv_smart_A3_A4", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand || ' | ' || p_type AS content, CAST(p_size AS VARCHAR) AS size FROM part")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("Name"), F.col("p_brand").alias("description"),
                         F.col("p_type").alias("notes"), F.col("p_size").alias("size"))
    path = _written(t, "csv", p, suffix=".csv", header="true")
    return R.read_any(t.spark, path).select("id", "title", "content", F.col("metadata")["size"].alias("size"))


@query("parse_eml_A5", f"WITH {S.MESSAGES} SELECT doc_id, 'Sender <' || sender || '>' AS sender, 'No. ' || doc_id AS subject, sha256(replace(body, chr(10), ' ')) AS body_hash FROM messages")
def _(t):
    from .inputs import messages
    m = messages(t)
    raw = F.concat(F.lit("From: Sender <"), "sender", F.lit(">\nTo: list@example.com\nSubject: No. "), F.col("doc_id").cast("string"),
                   F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.replace("body", F.lit("\n"), F.lit(" ")))
    p = m.select("doc_id", R.parse_eml(F.encode(raw, "UTF-8")).alias("e"))
    return p.select("doc_id", "e.sender", "e.subject", F.sha2("e.body", 256).alias("body_hash"))


@query("page_sections_A7", r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
g AS (SELECT doc_id, CAST(ceil(len(l) / 100.0) AS INTEGER) AS total, l, unnest(range(0, CAST(ceil(len(l) / 100.0) AS BIGINT))) AS i FROM p)
SELECT doc_id, total, CAST(i AS INTEGER) AS section, array_to_string(l[i * 100 + 1:i * 100 + 100], chr(10)) AS content FROM g
WHERE length(trim(array_to_string(l[i * 100 + 1:i * 100 + 100], chr(10)))) >= 100""")
def _(t):
    return R.page_sections(t("documents"))


@query("batch_rows_A8", """
WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, '## ' || source || chr(10) || text AS b FROM documents),
g AS (SELECT (rn - 1) // 100 AS batch, count(*) AS n_rows, string_agg(b, chr(10) || chr(10) ORDER BY rn) AS content FROM n GROUP BY 1)
SELECT batch, n_rows, sha256(content) AS digest FROM g WHERE length(content) > 500""")
def _(t):
    b = R.batch_rows(t("documents"), "doc_id", "source", "text")
    return b.select(F.col("batch").cast("bigint").alias("batch"), "n_rows", F.sha2("content", 256).alias("digest"))


# each order as a manifest line: nations are the known codes, its line suppliers the parties
_MAN = """SELECT l_orderkey, strftime(o_orderdate, '%-d-%b') AS d, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def _manifest_lines(t):
    li = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("s"))
    names = F.array_join(F.transform("s", lambda x: F.concat(F.lit("S"), x["l_suppkey"].cast("string"))), ", ")
    return li.select(F.lit("book").alias("file"), F.col("l_orderkey").alias("line_no"), F.concat(
        F.date_format("o_orderdate", "d-MMM"), F.lit(" G-IV N123AB AAA BBB "), F.col("l_orderkey").cast("string"), F.lit(" "), names, F.lit(", 2 FEMALES, CARGO")).alias("raw"))


@query("parse_manifest_A9", f"""WITH m AS ({_MAN}) SELECT l_orderkey AS line_no, d AS date_raw, 'G-IV' AS vehicle, 'N123AB' AS registration, 'Alpha' AS from_place, 'Beta' AS to_place,
 array_to_string(list_transform(s, lambda x: CASE WHEN x = 7 THEN 'Seven' ELSE 'S' || x END), ';') || ';UNIDENTIFIED FEMALE;UNIDENTIFIED FEMALE' AS parties FROM m""")
def _(t):
    codes = t.spark.createDataFrame([("AAA", "Alpha"), ("BBB", "Beta")], "code string, place string")
    short = t.spark.createDataFrame([("S7", "Seven")], "short string, name string")
    m = R.parse_manifest(_manifest_lines(t), codes, short)
    return m.select("line_no", "date_raw", "vehicle", "registration", "from_place", "to_place", F.array_join("parties", ";").alias("parties"))


@query("manifest_years_A10", """
WITH x AS (SELECT doc_id AS line_no, source AS file, CASE WHEN n_chars < 200 THEN CAST(1900 + n_chars // 2 AS VARCHAR) ELSE text END AS raw, n_chars < 200 AS head, 1900 + n_chars // 2 AS y FROM documents)
SELECT file, line_no, CAST(year AS INTEGER) AS year FROM (SELECT file, line_no, head, last_value(CASE WHEN head THEN y END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS year FROM x) WHERE NOT head""")
def _(t):
    head = F.col("n_chars") < 200
    raw = F.when(head, (F.lit(1900) + F.floor(F.col("n_chars") / 2)).cast("string")).otherwise(F.concat(F.lit("x"), "text"))
    lines = t("documents").select(F.col("source").alias("file"), F.col("doc_id").alias("line_no"), raw.alias("raw"))
    return R.manifest_years(lines).select("file", "line_no", "year")


@query("parse_works_A11", """SELECT '10.1/' || p_partkey AS doi, p_name AS title, CAST(1990 + p_size AS INTEGER) AS year, p_brand AS first_author, p_type AS institutions, p_name || '|' || p_type AS topics FROM part""")
def _(t):
    js = F.to_json(F.struct(F.concat(F.lit("https://doi.org/10.1/"), "p_partkey").alias("doi"), F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size")).alias("publication_year"),
        F.array(F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("author"), F.array(F.struct(F.col("p_type").alias("display_name"))).alias("institutions"))).alias("authorships"),
        F.array(F.struct(F.col("p_name").alias("display_name"), F.lit(0).alias("level")), F.struct(F.col("p_type").alias("display_name"), F.lit(1).alias("level"))).alias("concepts")))
    w = R.parse_works(t("part").select(js.alias("json")))
    return w.select("doi", "title", "year", F.get("authors", F.lit(0))["name"].alias("first_author"), F.array_join("institutions", "|").alias("institutions"), F.array_join("topics", "|").alias("topics"))


@query("read_atom_A12", """SELECT CAST(p_partkey AS VARCHAR) AS paper_id, p_name AS title, p_brand AS authors, 'http://x.example/pdf/' || p_partkey AS pdf_url FROM part""")
def _(t):
    p = t("part").select(F.concat(F.lit("http://x.example/abs/"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("author"),
                         F.struct(F.concat(F.lit("http://x.example/pdf/"), "p_partkey").alias("_href"), F.lit("pdf").alias("_title")).alias("link"))
    path = shared_dir(t.spark, "files-atom")
    p.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    return R.read_atom(t.spark, path).select("paper_id", "title", F.array_join("authors", "|").alias("authors"), "pdf_url")


@query("parse_papers_A13", "SELECT '10.2/' || p_partkey AS doi, p_name AS title, CAST(1990 + p_size AS INTEGER) AS year, p_brand AS first_author, p_type AS fields FROM part")
def _(t):
    js = F.to_json(F.struct(F.struct(F.concat(F.lit("10.2/"), "p_partkey").alias("DOI")).alias("externalIds"), F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size")).alias("year"),
                            F.array(F.struct(F.col("p_brand").alias("name"))).alias("authors"), F.array("p_type").alias("fieldsOfStudy")))
    w = R.parse_papers(t("part").select(js.alias("json")))
    return w.select("doi", "title", "year", F.get("authors", F.lit(0))["name"].alias("first_author"), F.array_join("fields", "|").alias("fields"))


def responses(t):
    """Each order as a fenced model response about its customer and suppliers; status P orders are cut short."""
    # both tables are dealt by the order once
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartition("o_orderkey").distinct()
    li = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")
    cust = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    def sup(x):
        return F.concat(F.lit("Supplier "), x.cast("string"))
    nodes = F.concat(F.array(F.struct(F.lit("person").alias("type"), cust.alias("name"))), F.transform("s", lambda x: F.struct(F.lit("company").alias("type"), sup(x).alias("name"))))
    edges = F.transform("s", lambda x: F.struct(cust.alias("from"), sup(x).alias("to"), F.lit("bought_from").alias("type"), F.lit("order").alias("excerpt")))
    js = F.to_json(F.struct(F.array(F.struct(F.col("o_orderkey").alias("doc_id"), nodes.alias("nodes"), edges.alias("edges"),
                                             F.array(F.struct(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("description"))).alias("signals"),
                                             F.array(F.struct(cust.alias("entity"), F.element_at("s", 1).alias("doc_id")),
                                                     F.struct(F.lit("Nobody").alias("entity"), F.lit(0).cast("bigint").alias("doc_id"))).alias("cross_references")),
                                    F.struct((-F.col("o_orderkey") - 1).alias("doc_id"), F.slice(nodes, 1, 1).alias("nodes"), F.slice(edges, 1, 1).alias("edges"),
                                             F.array().cast("array<struct<type:string,description:string>>").alias("signals"),
                                             F.array().cast("array<struct<entity:string,doc_id:bigint>>").alias("cross_references"))).alias("extractions")))
    text = F.concat(F.lit("Here it is:\n```json\n"), F.when(F.col("o_orderstatus") == "P", F.left(js, F.length(js) - 20)).otherwise(js), F.lit("\n```\nDone."))
    return li.select(F.col("o_orderkey").alias("batch_id"), F.array("o_orderkey").alias("doc_ids"), text.alias("response_text"))


@query("parse_responses_A14", """WITH x AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey AS batch_id, NULL::VARCHAR AS error, o_orderkey AS source_id, 'Customer ' || o_custkey AS "from", 'Supplier ' || l_suppkey AS "to" FROM x WHERE o_orderstatus <> 'P'
UNION ALL SELECT DISTINCT o_orderkey, 'unparsable response', NULL, NULL, NULL FROM x WHERE o_orderstatus = 'P'""")
def _(t):
    p = R.parse_responses(responses(t))
    # edges and errors from one reading of the responses
    edges = p.select("batch_id", "error", F.col("doc_id").alias("source_id"), F.explode_outer("edges").alias("x")).where("error is not null or x is not null")
    return edges.select("batch_id", "error", "source_id", "x.from", "x.to")


_READ = "x AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')"


@query("mention_edges_H2", f"""WITH {_READ}, n AS (SELECT DISTINCT 'Customer ' || o_custkey AS name, 'person' AS node_type, o_orderkey AS dst FROM x
UNION ALL SELECT 'Supplier ' || l_suppkey, 'company', o_orderkey FROM x) SELECT name, node_type, dst, 'mentioned_in' AS type, count(*) AS seen FROM n GROUP BY ALL""")
def _(t):
    p = R.parse_responses(responses(t))
    return G.mention_edges(R.response_part(p, "nodes")).select("name", "node_type", "dst", "type", "seen")


@query("cross_reference_edges_H2", f"""WITH {_READ} SELECT 'Customer ' || o_custkey AS name, min(l_suppkey) AS dst, 'cross_reference' AS type, o_orderkey AS source_id,
 '#' || min(l_suppkey) || ': mentioned_in' AS excerpt FROM x GROUP BY o_orderkey, o_custkey""")
def _(t):
    p = R.parse_responses(responses(t))
    return G.cross_reference_edges(R.response_part(p, "cross_references"), R.response_part(p, "nodes")).select("name", "dst", "type", "source_id", "excerpt")


@query("signal_flags_H3", f"""WITH {_READ} SELECT DISTINCT 'document' AS target_type, o_orderkey AS target_id, o_orderpriority AS flag_type, o_orderstatus AS description, 0 AS severity FROM x""")
def _(t):
    return G.signal_flags(R.response_part(R.parse_responses(responses(t)), "signals"))


@query("dated_log_A15", "SELECT conv_id, TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE AS at, role AS title, count(*) OVER (PARTITION BY conv_id) AS entries FROM conversations")
def _(t):
    c = t("conversations")
    block = F.concat(F.lit("## "), F.date_format(F.expr("timestampadd(MINUTE, turn, TIMESTAMP_NTZ'2024-01-01 00:00:00')"), "yyyy-MM-dd HH:mm"), F.lit(" | "), "role", F.lit("\n"),
                     F.replace("text", F.lit("\n"), F.lit(" ")))
    logs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda s: s["b"]), "\n---\n").alias("text"))
    e = R.dated_log(logs, "conv_id")
    n = e.groupBy("conv_id").agg(F.count("*").alias("entries"))
    return e.join(n, "conv_id").select("conv_id", F.col("at").cast("timestamp_ntz").alias("at"), "title", "entries")


@query("copy_and_reconcile_A16", "SELECT 'orders' AS \"table\", count(*) AS n_src, count(*) AS n_dst, true AS same FROM orders UNION ALL SELECT 'nation', count(*), count(*), true FROM nation")
def _(t):
    a = X.copy_table(t("orders"), shared_dir(t.spark, "copy-orders"), "parquet", "orders")
    b = X.copy_table(t("nation"), shared_dir(t.spark, "copy-nation"), "json", "nation")
    return a.unionByName(b)


@query("evidence_package_A17")
def _(t):
    m = X.evidence_package(t.spark, {"documents": t("documents"), "labels": t("labels")}, shared_dir(t.spark, "package"))
    return X.package_hash(m)


@query("convert_pending_A18", "SELECT CAST(page_id AS VARCHAR) AS path, lower(html) AS text, NULL::VARCHAR AS error FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    files = t("pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    done = t("labels").select(F.col("doc_id").cast("string").alias("path"))

    def lower(batches):
        for b in batches:
            yield b.assign(text=[bytes(c).decode().lower() for c in b["content"]], error=None)[["path", "text", "error"]]

    return X.convert_pending(files, done, lower)
