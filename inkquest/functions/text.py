"""Column functions over text: tokens, normal forms, statistics, hashes, dates.

All of them are row-local built-in expressions, so they fuse into the scan stage
and never shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import wordlists as W


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def str_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.expr("array()").cast("array<string>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_fold(x) -> Column:
    """Non-ASCII characters become one space, so word boundaries are ASCII in every regex engine."""
    return F.regexp_replace(col(x), r"[^\x00-\x7F]", " ")


# ---------------------------------------------------------------- tokens

def tokenize(x, variant: str = "index") -> Column:
    """Token array of a text.

    ``index``  lower-case ASCII alphanumeric runs of two or more characters;
    ``cased``  alphanumeric runs in original case, longer than two;
    ``words``  ASCII punctuation as blanks, lower case, whitespace split, longer than one;
    ``query``  lower-case whole ASCII words of two or more letters.
    """
    c = col(x)
    if variant == "index":
        return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)
    if variant == "cased":
        return F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda t: F.length(t) > 2)
    if variant == "words":
        plain = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", " ")
        return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) > 1)
    if variant == "query":
        return F.regexp_extract_all(ascii_fold(F.lower(c)), F.lit(r"\b[a-z]{2,}\b"), F.lit(0))
    raise ValueError(f"unknown token variant {variant}")


def normalize_text(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "))


def normalize_name(x, variant: str = "strip") -> Column:
    """``strip`` drops everything but letters, digits and blanks; ``plain`` only lowers and trims."""
    if variant == "plain":
        return F.trim(F.lower(col(x)))
    return F.trim(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9\s]", ""))


def token_jaccard(a, b) -> Column:
    """Jaccard similarity of the token sets, 0 when either side has no token."""
    def ratio(s):
        common = F.size(F.array_intersect(s["a"], s["b"]))
        return F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(
            common / (F.size(s["a"]) + F.size(s["b"]) - common))

    return let(F.struct(F.array_distinct(tokenize(a)).alias("a"), F.array_distinct(tokenize(b)).alias("b")), ratio)


def content_key(x) -> Column:
    """64-bit key for grouping equal texts (stands in for a hand-rolled byte hash)."""
    return F.xxhash64(col(x))


# ---------------------------------------------------------------- numbers

def numeric_values(x, strict: bool = True) -> Column:
    """Numbers of a text scaled by their K/M/B unit, as array<struct<value,unit>>.

    ``strict`` asks for a unit that ends a word; the loose form also takes the
    k, m or b that starts one ("5 kids" gives 5000).
    """
    unit = r"(?:([KkMmBb](?:illion)?|USD|EUR)\b|(%))?" if strict else r"(?:([KkMmBb](?:illion)?|USD|EUR)|(%))?"
    regex = r"(\d[\d,]*(?:\.\d+)?)\s*" + unit
    text = ascii_fold(x)
    def part(i):
        return F.regexp_extract_all(text, F.lit(regex), F.lit(i))

    def scale(z):
        number = F.regexp_replace(z["0"], ",", "").try_cast("double")
        first = F.lower(F.substring(z["1"], 1, 1))
        factor = (F.when(first == "k", 1e3).when(first == "m", 1e6).when(first == "b", 1e9)
                  .otherwise(1.0))
        return F.struct((number * factor).alias("value"), F.concat(z["1"], z["2"]).alias("unit"))

    return F.transform(F.arrays_zip(part(1).alias("0"), part(2).alias("1"), part(3).alias("2")), scale)


# ---------------------------------------------------------------- cleaners

def strip_markup(x) -> Column:
    """Remove tags and brace blocks, then collapse whitespace."""
    c = F.regexp_replace(col(x), r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"\{[^}]*\}", " ")
    return collapse_whitespace(c)


def collapse_whitespace(x) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def strip_punctuation(x) -> Column:
    return F.regexp_replace(col(x), r"[^a-zA-Z0-9_\s]", "")


def strip_digits(x) -> Column:
    return F.regexp_replace(col(x), "[0-9]+", "")


def strip_ansi(x) -> Column:
    return F.regexp_replace(col(x), r"\x1b\[[0-9;]*[a-zA-Z]", "")


def escape_html(x) -> Column:
    c = col(x)
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    return c


# ---------------------------------------------------------------- statistics

def text_stats(x, variant: str = "split") -> Column:
    """Counts of a text as one struct.

    ``split`` uses whitespace words and non-blank sentence pieces; ``tokens`` uses
    the punctuation-free lower-case words and counts sentence marks, at least one.
    """
    c = col(x)
    if variant == "split":
        words = F.filter(F.split(c, r"\s+"), lambda t: t != "")
        sentences = F.size(F.filter(F.split(c, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))
    else:
        words = tokenize(c, "words")
        sentences = F.greatest(F.regexp_count(c, F.lit("[.!?]")), F.lit(1))

    def stats(w):
        n, uniq = F.size(w), F.size(F.array_distinct(w))
        letters = F.aggregate(w, F.lit(0), lambda a, t: a + F.length(t))
        return F.struct(
            F.length(c).alias("chars"), n.alias("words"), sentences.alias("sentences"), uniq.alias("unique_words"),
            F.when(n > 0, letters / n).otherwise(0.0).alias("avg_word_length"),
            F.when(n > 0, uniq / n).otherwise(0.0).alias("lexical_diversity"))

    return let(words, stats)


def term_frequency(x, term, variant: str = "words") -> Column:
    """Share of a text's tokens equal to ``term``."""
    toks = tokenize(x, variant)
    want = F.lower(F.lit(term) if isinstance(term, str) else term)
    return let(toks, lambda ts: F.when(F.size(ts) > 0, F.size(F.filter(ts, lambda t: t == want)) / F.size(ts)).otherwise(0.0))


@F.pandas_udf(T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("distinct", T.IntegerType())]))
def _char_counts(text: pd.Series) -> pd.DataFrame:
    """Entropy and number of the distinct characters of each text, each read once."""
    rows = []
    for t in text:
        if t is None:
            rows.append((None, None))
            continue
        n = np.unique(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32), return_counts=True)[1]
        p = n / max(n.sum(), 1)
        rows.append((float(-(p * np.log2(p)).sum()) + 0.0, len(n)))
    return pd.DataFrame(rows, columns=["entropy", "distinct"]).astype({"entropy": "float64", "distinct": "Int32"})


def char_entropy(x) -> Column:
    """Shannon entropy in bits of the characters of a text (0 for an empty one)."""
    return _char_counts(col(x))["entropy"]


def uniqueness_score(x) -> Column:
    """0-100: 70 parts normalised entropy, 30 parts distinct characters per length."""
    c = col(x)
    distinct = _char_counts(c)["distinct"]
    top = F.when(distinct > 1, F.log2(distinct)).otherwise(1.0)
    return F.when(F.length(c) > 0,
                  (0.7 * char_entropy(c) / top + 0.3 * distinct / F.length(c)) * 100).otherwise(0.0)


# ---------------------------------------------------------------- language

def _letters_only(x) -> Column:
    return F.split(F.lower(col(x)), r"[^\p{L}\p{N}_]+")


def language_by_markers(x, markers=(("fr", W.FRENCH_MARKERS), ("es", W.SPANISH_MARKERS)),
                        min_hits: int = 2, default: str = "en") -> Column:
    """First language with at least ``min_hits`` distinct markers in the text."""
    def pick(words):
        out = F.lit(default)
        for lang, marks in reversed(markers):
            out = F.when(F.size(F.array_intersect(words, str_array(marks))) >= min_hits, lang).otherwise(out)
        return out

    return let(F.array_distinct(_letters_only(x)), pick)


def language_by_presence(x, markers=(("fr", W.FRENCH_PRESENCE), ("en", W.ENGLISH_PRESENCE))) -> Column:
    """Language whose markers, set off by blanks, are present most; the last one wins ties."""
    padded = F.concat(F.lit(" "), F.lower(col(x)), F.lit(" "))
    score = {}
    for lang, marks in markers:
        score[lang] = sum((F.contains(padded, F.lit(f" {m} ")).cast("int") for m in marks), F.lit(0))
    return _argmax(score)


def language_by_frequency(x, markers) -> Column:
    """Language whose markers make up most tokens; the last one wins ties."""
    def pick(toks):
        def hits(marks):
            return F.size(F.filter(toks, lambda t: F.array_contains(str_array(marks), t)))

        return _argmax({lang: hits(marks) for lang, marks in markers})

    return let(tokenize(x, "words"), pick)


def _argmax(score: dict) -> Column:
    langs = list(score)
    best = F.lit(langs[-1])
    top = score[langs[-1]]
    for lang in reversed(langs[:-1]):
        best = F.when(score[lang] > top, lang).otherwise(best)
        top = F.greatest(top, score[lang])
    return best


# ---------------------------------------------------------------- query shaping

def search_terms(x, limit: int = 5, stop=W.QUERY_STOP, filter_capitals: bool = True) -> Column:
    """Quoted phrases, capitalised words and long words, first seen first, without repeats.

    Repeats are judged without case and the first spelling is kept.
    """
    c = ascii_fold(x)
    stops = str_array(stop)
    quoted = F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))
    caps = F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"), F.lit(1))
    if filter_capitals:
        caps = F.filter(caps, lambda t: ~F.array_contains(stops, F.lower(t)))
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]{4,})\b"), F.lit(1)),
                     lambda t: ~F.array_contains(stops, t))
    def first_spellings(s):
        keep = F.slice(F.array_distinct(s["low"]), 1, limit)
        return F.transform(keep, lambda k: F.element_at(s["found"], F.array_position(s["low"], k).cast("int")))

    return let(F.concat(quoted, caps, words), lambda found: let(
        F.struct(found.alias("found"), F.transform(found, lambda t: F.lower(t)).alias("low")), first_spellings))


def query_keywords(x, limit: int = 5, stop=W.KEYWORD_STOP, fallback: int = 3, long_fallback: bool = False) -> Column:
    """Words that are no stop words, or else the first words of the query."""
    def pick(words):
        rest = F.filter(words, lambda t: F.length(t) > 2) if long_fallback else F.slice(words, 1, fallback)
        kept = F.filter(words, lambda t: ~F.array_contains(str_array(stop), t))
        return let(kept, lambda k: F.when(F.size(k) > 0, F.slice(k, 1, limit)).otherwise(rest))

    return let(tokenize(x, "query"), pick)


def conversation_title(x, starters=W.TITLE_STARTERS, width: int = 50, default: str = "New Chat") -> Column:
    """One opener dropped, first letter raised, at most ``width`` characters."""
    t = F.trim(col(x))
    lower = F.lower(t)
    cut = None
    for s in starters:
        hit = F.startswith(lower, F.lit(s))
        val = F.substring(t, len(s) + 1, 2**30)
        cut = F.when(hit, val) if cut is None else cut.when(hit, val)
    t = cut.otherwise(t) if cut is not None else t
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**30))
    t = F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)
    return F.when(t == "", default).otherwise(t)


def _title_letter(t) -> Column:
    """First letter raised; the sharp s has no one-letter title form and stays."""
    first = F.substring(t, 1, 1)
    return F.when(first == "ß", first).otherwise(F.upper(first))


def query_intent(x) -> Column:
    """Greeting and question flags, priority, confidence and main subject of a query."""
    low = F.lower(col(x))
    plain = F.trim(low)

    def has(*subs):
        out = F.lit(False)
        for s in subs:
            out = out | F.contains(low, F.lit(s))
        return out

    greeting = F.lit(False)
    for g in W.GREETINGS:
        greeting = greeting | (plain == g) | F.startswith(plain, F.lit(g + " "))
    high = has(*W.HIGH_PRIORITY)
    words = F.filter(F.split(low, r"\s+"), lambda t: (F.length(t) > 2) & ~F.array_contains(str_array(W.SUBJECT_SKIP), t))
    titled = F.transform(F.slice(words, 1, 3),
                         lambda t: F.concat(_title_letter(t), F.substring(t, 2, 2**30)))
    return F.struct(
        greeting.alias("is_greeting"), has("who", "qui").alias("is_who"),
        has("what", "quoi", "quel").alias("is_what"),
        has("connection", "associate", "lien").alias("is_connection"),
        F.when(high, "high").otherwise("normal").alias("priority"),
        F.when(high, 0.95).otherwise(0.8).alias("confidence"),
        F.when(F.size(words) == 0, "this topic").otherwise(F.array_join(titled, " ")).alias("subject"),
    )


# ---------------------------------------------------------------- snippets

def snippet(x, width: int) -> Column:
    return F.left(col(x), F.lit(width))


def clean_excerpt(x, width: int) -> Column:
    """Bold marks removed, blanks collapsed, cut to ``width`` with an ellipsis."""
    c = collapse_whitespace(F.replace(col(x), F.lit("**"), F.lit("")))
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def hit_window(x, terms, words: int = 30) -> Column:
    """About ``words`` words around the first word that equals a query term, hits marked.

    ``terms`` is an array column of lower-case terms.  The window starts a third of
    its length before the first hit, or at the text start when there is none.
    """
    def window(toks):
        first = F.array_position(F.transform(toks, lambda t: F.array_contains(col(terms), bare_word(t))), F.lit(True)).cast("int")
        return mark_hits(window_part(toks, first, words), col(terms))

    return let(window_words(x), window)


def window_words(x) -> Column:
    """Blank-separated words of a text, as hit windows count them."""
    return F.filter(F.split(col(x), r"\s+"), lambda t: t != "")


def bare_word(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), "[^a-z0-9]+", "")


def window_part(toks: Column, first: Column, words: int) -> Column:
    """The words of a window around the place ``first`` (0: none)."""
    return F.slice(toks, F.greatest(first - words // 3, F.lit(1)), words)


def mark_hits(part: Column, terms: Column) -> Column:
    return mark_pairs(F.transform(part, lambda t: F.struct(t.alias("word"), bare_word(t).alias("bare"))), terms)


def mark_pairs(part: Column, terms: Column) -> Column:
    """A window of (word, bare) with the words marked whose bare form is a term."""
    # the terms are hashed once for a window, not read through for each of its words
    return let(F.array_intersect(part["bare"], terms), lambda hits: F.array_join(F.transform(
        part, lambda t: F.when(F.array_contains(hits, t["bare"]), F.concat(F.lit("<mark>"), t["word"], F.lit("</mark>"))).otherwise(t["word"])), " "))


# ---------------------------------------------------------------- dates

def fuzzy_date(x) -> Column:
    """A date guessed from free text, or null when it has no year 1900-2029.

    The month defaults to June and the day to the 15th; the day is the first whole
    one- or two-digit number, whatever it counts.
    """
    def month(low):
        out = None
        for name, num in W.MONTHS:
            hit = F.contains(low, F.lit(name))
            out = F.when(hit, num) if out is None else out.when(hit, num)
        return out.otherwise("06")

    def day(n):
        return F.when(n.between(1, 31), F.lpad(n.cast("string"), 2, "0")).otherwise("15")

    def date(c):
        number = F.regexp_extract(c, r"\b([0-3]?[0-9])\b", 1).try_cast("int")
        return let(F.regexp_extract(c, "(20[0-2][0-9]|19[0-9][0-9])", 1), lambda year: F.when(
            year != "", F.concat_ws("-", year, let(F.lower(c), month), let(number, day))))

    return let(ascii_fold(x), date)


def mixed_date(x) -> Column:
    """Struct of (date, precision) for YYYY, YYYY-MM or YYYY-MM-DD text."""
    c = F.trim(col(x))
    precision = F.when(F.length(c) == 4, "year").when(F.length(c) == 7, "month").when(F.length(c) == 10, "day")
    full = (F.when(F.length(c) == 4, F.concat(c, F.lit("-01-01")))
            .when(F.length(c) == 7, F.concat(c, F.lit("-01"))).otherwise(c))
    return F.struct(F.try_to_date(full, "yyyy-MM-dd").alias("date"), precision.alias("precision"))


# ---------------------------------------------------------------- addresses, JSON

def email_domain(x) -> Column:
    return F.lower(F.split_part(col(x), F.lit("@"), F.lit(2)))


def email_local(x) -> Column:
    return F.lower(F.split_part(col(x), F.lit("@"), F.lit(1)))


def is_generic_domain(x, generic=W.GENERIC_MAIL_DOMAINS) -> Column:
    return email_domain(x).isin(generic)


def is_role_account(x, roles=W.ROLE_LOCALS, min_len: int = 4) -> Column:
    """Addresses whose local part stands for a role, or is too short to be a name."""
    local = email_local(x)
    return local.isin(list(roles)) | (F.length(local) < min_len)


def json_text(x, key: str) -> Column:
    """The value under ``key`` as text."""
    return F.get_json_object(col(x), f"$.{key}")


def map_merge(old, new) -> Column:
    """Union of two string maps where the new value wins."""
    o, n = col(old), col(new)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.array_contains(F.map_keys(n), k)), n)


# ---------------------------------------------------------------- chunks (I4)

def chunks(x, size: int, overlap: int) -> Column:
    """Overlapping pieces of a text; none for an empty text.

    A last piece that lies wholly inside the one before it is kept.
    """
    c = col(x)
    starts = F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(
        F.expr("cast(array() as array<string>)"))
