"""Table functions for SQL over the pattern registry."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructType

from . import patterns as P

_COLUMNS = [("pattern", StringType()), ("category", StringType()), ("value", StringType()), ("start", IntegerType()), ("end", IntegerType()),
            ("confidence", DoubleType()), ("sensitive", BooleanType())]


class ExtractSpans:
    """Rows of ``extract_spans(text [, names [, context]])``: the matches of the registry in one text.

    ``names`` is a constant list of patterns separated by commas (all without it); ``context``
    is a constant number of characters on either side, 0 leaves the column out.  Offsets count
    characters from 0; a null text has no row.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, names: AnalyzeArgument | None = None, context: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("extract_spans takes a text as its first argument")
        for given in (names, context):
            if given is not None and not given.isConstantExpression:
                raise ValueError("extract_spans takes constants behind the text")
        if names is not None and names.value is not None:
            unknown = set(_names(names.value)) - {p.name for p in P.REGISTRY}
            if unknown:
                raise ValueError(f"unknown patterns: {', '.join(sorted(unknown))}")
        schema = StructType()
        for name, kind in _COLUMNS:
            schema = schema.add(name, kind)
        if context is None or context.value:
            schema = schema.add("context", StringType())
        return AnalyzeResult(schema)

    def eval(self, text, names=None, context=50):
        if text is None:
            return
        width = 50 if context is None else context
        folded = (text if text.isascii() else re.sub(r"[^\x00-\x7f]", " ", text)).replace("\x01", " ").replace("\x02", " ")
        met: dict = {}  # each guard is looked for once
        for p, find, guard in _compiled(names):
            if guard is not None:
                if guard not in met:
                    met[guard] = guard(folded) is not None
                if not met[guard]:
                    continue
            for m in find(folded):
                a, b = m.span(1)
                if a < 0:  # a dead run
                    continue
                row = (p.name, p.category, text[a:b], a, b, p.confidence, p.sensitive)
                yield (*row, text[max(a - width, 0):b + width]) if width else row


def _names(given: str) -> list[str]:
    return [n.strip() for n in given.split(",") if n.strip()]


_cache: dict = {}


def _compiled(names):
    if names not in _cache:
        guards: dict = {}
        for p in (chosen := P.select_patterns(_names(names) if names is not None else None)):
            if p.guard:
                guards.setdefault(p.guard, re.compile(p.guard, re.ASCII).search)
        _cache[names] = [(p, re.compile(_scoped(p), re.ASCII).finditer, guards.get(p.guard)) for p in chosen]
    return _cache[names]


def _scoped(p: P.Pattern) -> str:
    """``p.jvm`` with leading flags written as a group, which this engine asks for inside of one."""
    own = p.loop_form or p.regex
    flags = re.match(r"\(\?([a-z]+)\)", own)
    own = f"((?{flags[1]}:{own[flags.end():]}))" if flags else f"({own})"
    return f"{own}|({p.dead_run})" if p.dead_run else own


def register(spark: SparkSession) -> None:
    """Make ``extract_spans`` known to the SQL of a session."""
    spark.udtf.register("extract_spans", udtf(ExtractSpans))
