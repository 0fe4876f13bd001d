"""File readers: text folders, JSON wrappers, loose CSV, e-mail, feeds, dated logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# Candidate column names, first present wins.
CSV_COLUMNS = {
    "content": ["content", "text", "body", "description", "summary", "full_text", "message"],
    "id": ["id", "doc_id", "document_id", "docid", "number"],
    "title": ["title", "name", "subject", "filename", "headline"],
    "date": ["date", "date_sent", "created", "timestamp", "published"],
}
CSV_EXTRA = ["details", "notes"]
JSON_WRAPPERS = ["documents", "items", "records"]


def read_text_dir(spark: SparkSession, path: str, patterns: str = "*.{txt,eml}") -> DataFrame:
    """One row per text or e-mail file below ``path``: id (stem), content, title, source."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", patterns).load(path))
    name = F.element_at(F.split("path", "/"), -1)
    # undecodable bytes are dropped
    content = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), content.alias("content"), name.alias("title"),
                      F.col("path").alias("source"), F.col("modificationTime").alias("modified"))


def text_as_message(files: DataFrame) -> DataFrame:
    """Text files as messages: subject is the file name, the date is the file's time."""
    return files.select("id", F.col("title").alias("subject"), F.concat(F.lit("Document: "), "title").alias("sender"),
                        F.col("modified").alias("date_sent"), F.col("content").alias("body"), "source")


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array, a single object, or an object wrapping a list of documents."""
    df = spark.read.option("multiLine", "true").json(path)
    return unwrap_json(df)


def unwrap_json(df: DataFrame) -> DataFrame:
    for key in JSON_WRAPPERS:
        if key in df.columns and dict(df.dtypes)[key].startswith("array<struct"):
            return df.select(F.explode(key).alias("_d")).select("_d.*")
    return df


def read_csv_smart(spark: SparkSession, path: str, columns: dict[str, list[str]] | None = None, extra=CSV_EXTRA) -> DataFrame:
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return shape_csv(df, columns, extra)


def shape_csv(df: DataFrame, columns: dict[str, list[str]] | None = None, extra=CSV_EXTRA) -> DataFrame:
    """Loose string columns as (id, title, date, content, metadata).

    Each role takes the first candidate column present.  Secondary description
    columns are appended; with no content at all the cells longer than ten
    characters are joined.  A missing id is a unique number (its order is not promised).
    """
    names = {c.lower(): c for c in df.columns}
    role = {r: next((names[c] for c in cands if c in names), None) for r, cands in (columns or CSV_COLUMNS).items()}
    more = [names[c] for c in extra if c in names and names[c] != role["content"]]

    def text(c):
        return F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))

    main = F.concat_ws(" | ", *[text(c) for c in ([role["content"]] if role["content"] else []) + more])
    long_cells = F.concat_ws(" ", *[F.when(F.length(F.col(c).cast("string")) > 10, F.col(c).cast("string")) for c in df.columns])
    used = {role[r] for r in role if role[r]} | set(more)
    rest = [c for c in df.columns if c not in used]
    meta = (F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest])),
                         lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>"))
    row_id = F.col(role["id"]).cast("string") if role["id"] else (F.monotonically_increasing_id() + 1).cast("string")
    return df.select(row_id.alias("id"), (F.col(role["title"]) if role["title"] else F.lit(None)).cast("string").alias("title"),
                     (F.col(role["date"]) if role["date"] else F.lit(None)).cast("string").alias("date"),
                     F.when(main != "", main).otherwise(long_cells).alias("content"), meta.alias("metadata"))


def read_any(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Reader chosen by name: folder or .txt as text, .json, .csv; an unknown format raises."""
    if fmt == "auto":
        low = path.lower().rstrip("/")
        fmt = "json" if low.endswith(".json") else "csv" if low.endswith(".csv") else "txt"
    readers = {"txt": read_text_dir, "json": read_json_docs, "csv": read_csv_smart}
    if fmt not in readers:
        raise ValueError(f"unknown format {fmt}")
    return readers[fmt](spark, path)


_MAIL_FIELDS = ["sender", "recipients", "cc", "subject", "sent", "body", "error"]


@F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in _MAIL_FIELDS]))
def parse_eml(content: pd.Series) -> pd.DataFrame:
    """Header fields (encoded words decoded) and first plain-text part of raw e-mail bytes.

    A mail that cannot be read has its reason in ``error`` and no fields; null content is one.
    """
    from email import message_from_bytes
    from email.header import decode_header, make_header

    def header(value):
        if value is None:
            return None
        try:
            return str(make_header(decode_header(value)))
        except (LookupError, UnicodeError, ValueError):
            return str(value)

    def one(raw):
        if raw is None:
            return (None,) * 6 + ("no content",)
        try:
            m = message_from_bytes(bytes(raw))
            part = m
            if m.is_multipart():
                part = next((p for p in m.walk() if p.get_content_type() == "text/plain"), None)
            payload = part.get_payload(decode=True) if part is not None else None
            charset = (part.get_content_charset() if part is not None else None) or "utf-8"
            try:
                body = payload.decode(charset, "ignore") if payload else ""
            except LookupError:
                body = payload.decode("utf-8", "ignore")
            return (*(header(m.get(h)) for h in ("From", "To", "Cc", "Subject", "Date")), body, None)
        except Exception as e:  # the parser raises whatever a broken mail leads it to
            return (None,) * 6 + (f"{type(e).__name__}: {e}",)

    return pd.DataFrame([one(b) for b in content], columns=_MAIL_FIELDS, dtype=object)


def page_sections(docs: DataFrame, group: int = 100, min_chars: int = 100, width: int | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections at form feeds, or of ``group`` lines when there is no form feed; short ones dropped."""
    from ..functions.text import let

    feeds = F.split(text_col, "\f")
    lines = F.split(text_col, "\n")
    grouped = let(lines, lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / group).cast("int")),
                                                lambda g: F.array_join(F.slice(ls, g * group + 1, F.lit(group)), "\n")))
    parts = docs.select(id_col, F.when(F.size(feeds) >= 2, feeds).otherwise(grouped).alias("p"))
    rows = parts.select(id_col, F.size("p").alias("total"), F.posexplode("p").alias("section", "content"))
    kept = rows.where(F.length(F.trim("content")) >= min_chars)
    return kept.withColumn("content", F.left("content", F.lit(width))) if width else kept


def batch_rows(rows: DataFrame, key: str, title: str, text: str, size: int = 100, width: int | None = None,
               min_chars: int = 500, max_chars: int | None = None) -> DataFrame:
    """Every ``size`` rows in key order become one document of ``## title`` blocks."""
    from ..operators.ingest import numbered

    n = numbered(rows.select(key, title, text), key)
    block = F.concat(F.lit("## "), F.col(title), F.lit("\n"), F.left(F.col(text), F.lit(width)) if width else F.col(text))
    doc = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", block.alias("b")))), lambda s: s["b"]), "\n\n")
    out = n.groupBy(F.floor((F.col("rn") - 1) / size).alias("batch")).agg(F.count("*").alias("n_rows"), doc.alias("content")).where(F.length("content") > min_chars)
    return out.withColumn("content", F.left("content", F.lit(max_chars))) if max_chars else out


def dated_log(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entries of a Markdown log: blocks between ``---`` lines headed ``## date time | title``."""
    block = F.explode(F.split(text_col, "\n---\n"))
    head = r"(?m)^## (\d{4}-\d{2}-\d{2} \d{2}:\d{2}) \| (.+)$"
    e = docs.select(id_col, block.alias("block")).where(F.regexp_like("block", F.lit(head)))
    return e.select(id_col, F.try_to_timestamp(F.regexp_extract("block", head, 1), F.lit("yyyy-MM-dd HH:mm")).alias("at"),
                    F.regexp_extract("block", head, 2).alias("title"),
                    F.trim(F.regexp_replace("block", head, "")).alias("body"))


# ---------------------------------------------------------------- bibliographic dumps

WORK = """id string, doi string, title string, publication_year int, publication_date string,
authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string>>>>,
grants array<struct<funder_display_name: string>>, concepts array<struct<display_name: string, level: int>>,
open_access struct<is_oa: boolean, oa_url: string>"""


def parse_works(raw: DataFrame, col_name: str = "json") -> DataFrame:
    """Nested bibliographic records as flat papers."""
    w = raw.select(F.from_json(col_name, WORK).alias("w"))
    names = lambda arr, f: F.array_distinct(F.array_compact(F.transform(arr, f)))
    return w.select(
        F.regexp_replace("w.doi", "^https?://doi.org/", "").alias("doi"), F.col("w.title").alias("title"), F.col("w.publication_year").alias("year"),
        F.try_to_date(F.col("w.publication_date")).alias("published"),
        F.transform("w.authorships", lambda a: F.struct(a["author"]["display_name"].alias("name"),
                                                        F.get(a["institutions"], F.lit(0))["display_name"].alias("affiliation"))).alias("authors"),
        F.array_distinct(F.flatten(F.transform("w.authorships", lambda a: F.transform(
            F.coalesce(a["institutions"], F.array()), lambda i: i["display_name"])))).alias("institutions"),
        names("w.grants", lambda g: g["funder_display_name"]).alias("funders"),
        names("w.concepts", lambda c: c["display_name"]).alias("topics"),
        names(F.filter("w.concepts", lambda c: c["level"] == 0), lambda c: c["display_name"]).alias("fields"),
        F.col("w.open_access.is_oa").alias("is_oa"), F.col("w.open_access.oa_url").alias("oa_url"))


PAPER2 = """paperId string, title string, year int, abstract string, externalIds struct<DOI: string>,
authors array<struct<name: string>>, fieldsOfStudy array<string>, isOpenAccess boolean, openAccessPdf struct<url: string>"""


def parse_papers(raw: DataFrame, col_name: str = "json") -> DataFrame:
    """The second bibliographic shape, with the columns it shares with :func:`parse_works`."""
    w = raw.select(F.from_json(col_name, PAPER2).alias("w"))
    return w.select(F.col("w.externalIds.DOI").alias("doi"), F.col("w.title").alias("title"), F.col("w.year").alias("year"),
                    F.transform("w.authors", lambda a: F.struct(a["name"].alias("name"), F.lit(None).cast("string").alias("affiliation"))).alias("authors"),
                    F.col("w.fieldsOfStudy").alias("fields"), F.col("w.isOpenAccess").alias("is_oa"), F.col("w.openAccessPdf.url").alias("oa_url"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Papers of an Atom feed file."""
    schema = ("id string, title string, summary string, published string, author array<struct<name: string>>, "
              "category array<struct<_term: string>>, link array<struct<_href: string, _title: string, _type: string>>")
    e = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    pdf = F.get(F.filter("link", lambda k: (k["_title"] == "pdf") | (k["_type"] == "application/pdf")), F.lit(0))
    return e.select(F.element_at(F.split("id", "/abs/"), -1).alias("paper_id"), F.trim(F.regexp_replace("title", r"\s*\n\s*", " ")).alias("title"),
                    F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"),
                    pdf["_href"].alias("pdf_url"), F.try_to_date(F.left("published", F.lit(10))).alias("published"))


# ---------------------------------------------------------------- model responses

EXTRACTION = """array<struct<doc_id: bigint, nodes: array<struct<type: string, name: string>>,
edges: array<struct<from: string, to: string, type: string, excerpt: string>>,
properties: array<struct<node: string, key: string, value: string>>,
signals: array<struct<type: string, description: string>>,
cross_references: array<struct<entity: string, doc_id: bigint>>>>"""


def clean_response(x) -> Column:
    """The JSON object or array inside a model response: fences dropped, first to last bracket."""
    c = F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"```(?:json)?", "")
    obj = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    arr = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    first_obj, first_arr = F.instr(c, "{"), F.instr(c, "[")
    return F.when((first_arr > 0) & ((first_obj == 0) | (first_arr < first_obj)), arr).otherwise(obj)


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row per extraction of (batch_id, doc_ids, response_text); broken JSON gives an error row.

    Extractions about documents outside the request batch are dropped.
    """
    from ..functions.text import let

    none, entry = F.lit(None).cast("string"), EXTRACTION[len("array<"):-1]

    def rows(parsed):
        asked = F.filter(parsed["extractions"], lambda e: F.array_contains("doc_ids", e["doc_id"]))
        return F.transform(asked, lambda e: F.struct(none.alias("error"), e.alias("e")))

    broken = F.array(F.struct(F.lit("unparsable response").alias("error"), F.lit(None).cast(entry).alias("e")))
    def read(body):
        parsed = F.from_json(body, f"struct<extractions: {EXTRACTION}>")
        return F.when((body != "") & F.try_parse_json(body).isNotNull(), let(parsed, rows)).otherwise(broken)

    found = let(clean_response("response_text"), lambda js: let(
        F.when(F.startswith(js, F.lit("[")), F.concat(F.lit('{"extractions":'), js, F.lit("}"))).otherwise(js), read))
    return responses.select("batch_id", F.inline(found)).select("batch_id", "error", "e.*")


def response_part(parsed: DataFrame, part: str) -> DataFrame:
    """Long table of one list of the extractions: nodes, edges, properties, signals or cross_references."""
    inner = parsed.where(F.col("error").isNull()).select("batch_id", F.col("doc_id").alias("source_id"), F.explode(part).alias("x"))
    return inner.select("batch_id", "source_id", "x.*")


# ---------------------------------------------------------------- manifests

def manifest_years(lines: DataFrame) -> DataFrame:
    """Carry the last year header of a file forward to its lines (file, line_no, raw).

    Headers are few, so only they are put in order; every line then finds its header
    by an interval join on (file, line bucket) instead of one ordered scan per file.
    """
    is_year = F.regexp_like(F.trim("raw"), F.lit(r"^\d{4}")) & (F.length(F.trim("raw")) < 10)
    inline = F.regexp_like(F.trim("raw"), F.lit(r"^\d{4},\s*[A-Z]{3}"))
    heads = lines.where(is_year | inline).select("file", F.col("line_no").alias("from_line"), F.left(F.trim("raw"), F.lit(4)).cast("int").alias("year"))
    w = Window.partitionBy("file").orderBy("from_line")
    spans = heads.withColumn("to_line", F.lead("from_line").over(w))
    width = 1024
    last = F.coalesce("to_line", F.col("max_line") + 1) - 1
    ends = lines.groupBy("file").agg(F.max("line_no").alias("max_line"))
    buckets = spans.join(ends, "file").withColumn("b", F.explode(F.sequence(
        F.floor(F.col("from_line") / width), F.floor(last / width)))).select("file", "b", "from_line", "to_line", "year")
    body = lines.where(~is_year).withColumn("b", F.floor(F.col("line_no") / width))
    joined = body.join(buckets, ["file", "b"], "left").where(
        F.col("from_line").isNull() | ((F.col("line_no") >= F.col("from_line")) & (F.col("to_line").isNull() | (F.col("line_no") < F.col("to_line")))))
    covered = joined.select("file", "line_no", "raw", "year")
    missing = body.join(covered.select("file", "line_no"), ["file", "line_no"], "left_anti").select("file", "line_no", "raw", F.lit(None).cast("int").alias("year"))
    return covered.unionByName(missing)


# Accepted date shapes, vehicle types, and entries that are no parties.
MANIFEST_DATES = [r"^(\d{1,2}-[A-Za-z]{3})", r"^([A-Za-z]{3}-\d{1,2})", r"^(\d{4},\s*[A-Z]{3})"]
MANIFEST_VEHICLE = r"(?i)(B-727|G-1159|Gulfstream|G-IV|G-V)"
MANIFEST_SKIP = ["EMPTY", "CARGO", "FUEL ONLY"]


def parse_manifest(lines: DataFrame, codes: DataFrame, abbreviations: DataFrame, parties_from: str = "destination") -> DataFrame:
    """Manifest lines as trips with places and party list.

    ``codes`` (code, place) and ``abbreviations`` (short, name) are the caller's
    tables.  The party list is what follows the second known code and the trip number
    (``destination``), or the longer of that and what follows the first free-standing
    number (``longest``); without a second code it is the latter.
    """
    raw = F.trim("raw")
    date = F.lit("")
    for r in reversed(MANIFEST_DATES):
        date = F.when(F.regexp_like(raw, F.lit(r)), F.regexp_extract(raw, r, 1)).otherwise(date)
    base = lines.select("file", "line_no", raw.alias("raw"), date.alias("date_raw"), F.regexp_extract("raw", MANIFEST_VEHICLE, 1).alias("vehicle"),
                        F.regexp_extract("raw", r"(N\d{3}[A-Z]{2})", 1).alias("registration")).where("date_raw <> ''")
    seen = base.select("file", "line_no", F.posexplode(F.regexp_extract_all("raw", F.lit(r"\b([A-Z]{3,4})\b"), F.lit(1))).alias("i", "code"))
    from ..session import broadcast_checked

    known = seen.join(broadcast_checked(codes), "code")
    w = Window.partitionBy("file", "line_no").orderBy("i")
    two = known.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("file", "line_no").agg(
        F.max(F.when(F.col("k") == 1, F.col("code"))).alias("from_code"), F.max(F.when(F.col("k") == 1, F.col("place"))).alias("from_place"),
        F.max(F.when(F.col("k") == 2, F.col("code"))).alias("to_code"), F.max(F.when(F.col("k") == 2, F.col("place"))).alias("to_place"))
    t = base.join(two, ["file", "line_no"], "left")
    loose = F.regexp_extract("raw", r"\d+\s+(.+?)(?:\d+/|\s*$)", 1)
    after = F.regexp_replace(F.element_at(F.split("raw", F.col("to_code")), -1), r"^\s*\d+\s*", "")
    use_after = F.col("to_code").isNotNull()
    if parties_from == "longest":
        use_after = use_after & (F.length(after) > F.length(loose))
    text = F.when(use_after, after).otherwise(loose)
    t = t.withColumn("parties_raw", F.trim(text))
    parts = t.select("file", "line_no", F.posexplode(F.transform(F.split("parties_raw", ","), lambda p: F.trim(p))).alias("i", "part")).where("part <> ''")
    up = F.upper("part")
    count, kind = F.regexp_extract(up, r"^(\d+)\s*(?:FEMALE|MALE)S?", 1).try_cast("int"), F.regexp_extract(up, r"^\d*\s*(FEMALE|MALE)S?", 1)
    parts = parts.join(broadcast_checked(abbreviations.select(F.upper("short").alias("_s"), F.col("name").alias("_n"))), up == F.col("_s"), "left")
    names = (F.when(up.isin(MANIFEST_SKIP) | F.regexp_like("part", F.lit(r"^\d+$")), F.expr("cast(array() as array<string>)"))
             .when(count.isNotNull(), F.array_repeat(F.concat(F.lit("UNIDENTIFIED "), kind), count))
             .when(up.isin("FEMALE", "MALE"), F.array(F.concat(F.lit("UNIDENTIFIED "), up)))
             .otherwise(F.array(F.coalesce("_n", "part"))))
    listed = parts.select("file", "line_no", "i", names.alias("n")).groupBy("file", "line_no").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda s: s["n"])).alias("parties"))
    out = t.join(listed, ["file", "line_no"], "left").withColumn("parties", F.coalesce("parties", F.expr("cast(array() as array<string>)")))
    return out.where("from_code is not null or to_code is not null or size(parties) > 0")
