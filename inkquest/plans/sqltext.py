"""SQL fragments shared by the twins of several plans."""

from ..functions import wordlists as W


def lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def fold(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', ' ', 'g')"


def tok(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


def words(c: str) -> str:
    return (f"list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+'), "
            "lambda t: length(t) > 1)")


def qwords(c: str) -> str:
    return f"regexp_extract_all({fold(f'lower({c})')}, '\\b[a-z]{{2,}}\\b')"


# E-mail shaped view of the documents table.
MESSAGES = """messages AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS subject, source || '@' || source || '.example' AS sender,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS date_sent, text AS body
  FROM documents)"""

# Scores of documents from the labels table.
SCORES = """scores AS (
  SELECT 'document' AS target_type, doc_id AS target_id, CAST(50 + 40 * quality AS INTEGER) AS pertinence,
         CAST(60 * toxic AS INTEGER) AS suspicion, 70 AS confidence FROM labels)"""

KEYWORD_STOP = lst(W.KEYWORD_STOP)
QUERY_STOP = lst(W.QUERY_STOP)
