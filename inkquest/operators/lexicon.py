"""Lexicons of any size found in texts by an automaton, in one pass and without moving a text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import col

# Terms and characters of one automaton; a longer lexicon is several of them, one pass over the texts each.
PART_TERMS, PART_CHARS = 200_000, 4_000_000
# Automata that a Python worker keeps, and texts it answers at once.
KEPT, ROWS = 2, 1_000

_built: dict[str, object] = {}


def _automaton(token: str, terms: list[str]):
    """The automaton of a part, built once by each worker."""
    if token not in _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            a.add_word(t, k)
        a.make_automaton()
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        _built[token] = a
    return _built[token]


def _search(token: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        find = _automaton(token, terms).iter if terms else lambda text: ()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = b.slice(at, ROWS)
                source, found, counts = [], [], []
                for i, t in enumerate(rows.column(1)):
                    seen: dict[int, int] = {}
                    for _, k in find(t.as_py() or ""):
                        seen[k] = seen.get(k, 0) + 1
                    source += [i] * len(seen)
                    found += [terms[k] for k in seen]
                    counts += seen.values()
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(source, pa.int64())), pa.array(found, pa.string()), pa.array(counts, pa.int64())], ["id", "_term", "n"])

    return run


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text", id_col: str = "doc_id",
                part_terms: int = PART_TERMS, part_chars: int = PART_CHARS) -> DataFrame:
    """(id, _term, n): how often each lower-case term of ``terms`` (_term) occurs in each lower-case text, overlaps included.

    The lexicon is cut into parts of bounded size by a hash; each part is broadcast and becomes one
    automaton for each worker.  A text is read once by the automata of a part and never shuffled,
    whatever the length of the shortest term; each row leaves with its own matches.  Null and
    empty terms find nothing, null texts hold nothing, repeated terms count once.
    """
    spark = docs.sparkSession
    t = terms.select("_term").where("_term <> ''").distinct()
    n, chars = t.agg(F.count("*"), F.coalesce(F.sum(F.length("_term")), F.lit(0))).first()
    parts = max(-(-n // part_terms), -(-chars // part_chars), 1)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.lower(col(text)).alias("_text"))
    out = None
    for k in range(parts):
        part = [r["_term"] for r in t.where(F.pmod(F.xxhash64("_term"), F.lit(parts)) == k).collect()]  # a part is bounded, see above
        found = src.mapInArrow(_search(uuid.uuid4().hex, spark.sparkContext.broadcast(part)), f"id {kind}, _term string, n long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)
