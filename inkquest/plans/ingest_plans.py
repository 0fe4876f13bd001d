"""Ingestion over whole tables (survey rows I1-I13)."""

from pyspark.sql import functions as F

from ..operators import ingest as I
from . import sqltext as S
from .inputs import messages
from .registry import query

_GATE = """g AS (SELECT doc_id, text, CASE WHEN length(trim(text)) < 50 THEN 'too_short'
  WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 THEN 'duplicate'
  WHEN text IN (SELECT text FROM benchmark) THEN 'duplicate' ELSE 'inserted' END AS status FROM documents)"""


def _known(t):
    return t("benchmark").select(I.text_hash("text").alias("hash"))


@query("quality_gate_I1", f"WITH {_GATE} SELECT doc_id, status FROM g")
def _(t):
    return I.quality_gate(t("documents"), _known(t))


@query("quality_gate_counts_I1", f"WITH {_GATE} SELECT status, count(*) AS n FROM g GROUP BY 1")
def _(t):
    return I.quality_gate(t("documents"), _known(t)).groupBy("status").agg(F.count("*").alias("n"))


@query("exact_dedup_I2", """SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents
 WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text""")
def _(t):
    return I.drop_exact_duplicates(t("documents"), t("benchmark")).select("doc_id", I.text_hash("text").alias("hash"))


@query("skip_known_I3", f"""WITH {S.MESSAGES} SELECT doc_id FROM messages WHERE sha256(body) NOT IN (SELECT sha256(text) FROM benchmark)
 AND subject NOT IN (SELECT split_part(text, chr(10), 1) FROM conversations UNION ALL SELECT split_part(text, chr(10), 1) FROM benchmark)""")
def _(t):
    first = F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject")
    known = (t("benchmark").select(F.col("text").alias("body"), first)
             .unionByName(t("conversations").select(F.lit(None).cast("string").alias("body"), first)))
    return I.skip_known(messages(t), known).select("doc_id")


_CH = """ch AS (SELECT doc_id, i AS chunk_index, substring(text, CAST(i * (size - lap) + 1 AS BIGINT), size) AS content FROM (
  SELECT doc_id, text, size, lap, CAST(unnest(range(0, CAST(ceil(length(text)::DOUBLE / (size - lap)) AS BIGINT))) AS INTEGER) AS i FROM (
   SELECT doc_id, text, CASE WHEN length(text) > 50000 THEN 10000 ELSE 2000 END AS size,
     CASE WHEN length(text) > 50000 THEN 500 ELSE 200 END AS lap FROM documents)))"""


@query("chunk_documents_I4", f"WITH {_CH} SELECT doc_id, chunk_index, content FROM ch")
def _(t):
    return I.chunk_documents(t("documents"))


@query("join_chunks_I5", f"""WITH {_CH} SELECT doc_id, sha256(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM ch GROUP BY 1""")
def _(t):
    return I.join_chunks(I.chunk_documents(t("documents"))).select("doc_id", F.sha2("content", 256).alias("digest"))


def _type_sql(rules, default):
    whens = []
    for label, alts in rules:
        cond = " OR ".join("(" + " AND ".join(f"contains({'c' if f == 'content' else 'n'}, '{m}')" for f, m in a) + ")" for a in alts)
        whens.append(f"WHEN {cond} THEN '{label}'")
    return f"CASE {' '.join(whens)} ELSE '{default}' END"


@query("document_type_I6", f"""
WITH x AS (SELECT doc_id, lower(text) AS c, lower(source || '.txt') AS n FROM documents)
SELECT doc_id, {', '.join(f"{_type_sql(I.TYPE_RULES[v], I.TYPE_DEFAULT[v])} AS by_{v}" for v in I.TYPE_RULES)},
 CASE {_type_sql(I.TYPE_RULES['content'], 'misc')} WHEN 'flight_log' THEN 'dataset' WHEN 'court_document' THEN 'court_filing' ELSE 'misc' END AS stored FROM x""")
def _(t):
    name = F.concat("source", F.lit(".txt"))
    return t("documents").select("doc_id", *[I.document_type("text", name, v).alias(f"by_{v}") for v in I.TYPE_RULES],
                                 I.stored_type(I.document_type("text", name)).alias("stored"))


@query("merge_sources_I7", """
WITH old AS (SELECT source, count(*) AS doc_count, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
new AS (SELECT source || CASE WHEN lang = 'en' THEN '' ELSE '-' || lang END AS source, count(*) AS d, CAST(sum(n_chars) AS BIGINT) AS c
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT coalesce(old.source, new.source) AS source, coalesce(doc_count, 0) + coalesce(d, 0) AS doc_count,
  coalesce(chars, 0) + coalesce(c, 0) AS chars, old.source IS NULL AS created FROM old FULL JOIN new ON old.source = new.source""")
def _(t):
    d, lab = t("documents"), t("labels").select("doc_id")
    old = d.join(lab, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("doc_count"), F.sum("n_chars").alias("chars"))
    suffix = F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("-"), "lang"))
    new = d.join(lab, "doc_id", "left_anti").select(F.concat("source", suffix).alias("source"), "n_chars")
    return I.merge_sources(old, new)


@query("work_queue_I8", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    audit = t("labels").select(F.col("doc_id").alias("target_id"), F.when(F.col("quality") == 1, "graded").otherwise("seen").alias("action"))
    return I.unprocessed(t("documents"), audit, "graded").select("doc_id")


@query("audit_rows_I9", """
SELECT 'document' AS target_type, doc_id AS target_id, 'scan' AS action,
  '{"chars":' || n_chars || ',"lang":"' || lang || '"}' AS new_value, 'first pass' AS reason FROM documents""")
def _(t):
    d = t("documents").select("doc_id", F.col("n_chars").alias("chars"), "lang")
    return I.audit_rows(d, "document", "scan", "first pass")


@query("sync_diff_I11", """
WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, 'only_a' AS side FROM a WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b)
UNION ALL SELECT l_orderkey, 'only_b' FROM b WHERE l_orderkey NOT IN (SELECT l_orderkey FROM a)""")
def _(t):
    li = t("lineitem")
    return I.sync_diff(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "l_orderkey")


@query("set_fingerprint_I11", """
WITH h AS (SELECT DISTINCT sha256(text) AS h FROM documents),
l AS (SELECT left(h, 3) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY p)) AS fingerprint FROM l""")
def _(t):
    return I.set_fingerprint(t("documents").select(I.text_hash("text").alias("h")), "h", bits=256)


@query("substantial_messages_I12", f"""WITH {S.MESSAGES} SELECT doc_id FROM messages
 WHERE length(body) > 500 AND subject NOT ILIKE '%license%' AND subject NOT ILIKE 'the %'""")
def _(t):
    return I.substantial(messages(t), 500, ["%license%", "the %"]).select("doc_id")


@query("attachment_findings_I13")
def _(t):
    from ..operators.attachments import attachment_findings
    # each page as a picture file: picture header, page bytes, end marker, and the address as trailing bytes
    body = F.concat(F.unhex(F.lit("FFD8FFE0")), F.encode("html", "UTF-8"), F.unhex(F.lit("FFD9")), F.encode("url", "UTF-8"))
    files = t("pages").select(F.col("page_id").alias("file_id"), F.concat("page_id", F.lit(".png")).alias("name"), body.alias("content"))
    return attachment_findings(files)


@query("number_documents_W4", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents")
def _(t):
    return I.numbered(t("documents").select("doc_id"), "doc_id")
