"""The pattern registry and span extraction as row-local expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from .text import ascii_fold, col, let


class Pattern(NamedTuple):
    name: str
    regex: str
    category: str
    confidence: float
    sensitive: bool = False
    # The same language written so that the JVM matches it without recursion: a
    # repeated group of variable length is recursive in java.util.regex and overflows
    # the task stack on long runs, a possessive one is a loop.
    loop_form: str | None = None

    # A run of words that holds no match when none starts at its first word.  It is
    # stepped over as a whole, so a long run is scanned once and not once per word.
    dead_run: str | None = None
    # A cheap pattern found in every text that has a match; texts without it are skipped.
    guard: str | None = None

    @property
    def jvm(self) -> str:
        """Group 1 is the match; group 2, if there is one, a dead run."""
        own = self.loop_form or self.regex
        return f"({own})|({self.dead_run})" if self.dead_run else f"({own})"


def values_of(folded, p: Pattern) -> Column:
    """All matches of a pattern on an ASCII-folded text, left to right."""
    found = F.regexp_extract_all(folded, F.lit(p.jvm), F.lit(1))
    if p.guard:
        found = F.when(F.regexp_like(folded, F.lit(p.guard)), found).otherwise(F.expr("cast(array() as array<string>)"))
    return F.filter(found, lambda v: v != "") if p.dead_run else found


def count_of(folded, p: Pattern) -> Column:
    return F.size(values_of(folded, p)) if p.dead_run else F.regexp_count(folded, F.lit(p.jvm))


def up_to_last(word: str, suffixes: str, gap: str = r"\s++") -> str:
    """Loop form of ``word(gap word)* gap (suffixes)\\b``: a run of words up to its last suffix.

    The run is eaten in segments of non-suffix words closed by a suffix, so no segment
    ever has to give words back.
    """
    return rf"{word}(?:(?:{gap}(?!(?:{suffixes})\b){word})*+{gap}(?:{suffixes})\b)++"


_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\."
_LAST_LABEL = r"[a-z]{2,}\b"
_LOOP = {
    "person_name": r"\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++",
    "organization": r"(?i)\b[A-Z][A-Za-z\s]*\s(?:Inc|Corp|LLC|Ltd|GmbH|SA|SAS|SARL|Co|Company|Foundation|Institute|University|Association)\b",
    "file_path": r"(?:/[a-zA-Z0-9._-]++)++|(?:[A-Z]:\\(?:[a-zA-Z0-9._-]++\\?+)++)",
    "domain": rf"(?i)\b(?:{_LABEL}(?:(?!{_LAST_LABEL}){_LABEL})*+(?={_LAST_LABEL}))++{_LAST_LABEL}",
    "currency": r"(?i)[$€£¥₿]\s*\d+(?:[.,]\d{2,3}+)*+|\d+(?:[.,]\d{3})*(?:[.,]\d{2})?\s*(?:USD|EUR|GBP|BTC|ETH|USDT)",
}


# Name, regular expression, category, confidence, sensitive.
REGISTRY = [
    Pattern("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "communication", 0.95),
    Pattern("phone", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}", "communication", 0.70),
    Pattern("url", r"(?i)https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)", "communication", 0.95),
    Pattern("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "network", 0.99),
    Pattern("ipv6_address", r"(?i)(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,7}:|(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}", "network", 0.99),
    Pattern("mac_address", r"(?i)(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}", "network", 0.95),
    Pattern("date_iso", r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?", "temporal", 0.95),
    Pattern("date_eu", r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}", "temporal", 0.70),
    Pattern("date_text", r"(?i)\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}\b", "temporal", 0.80),
    Pattern("time", r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?\s*(?:AM|PM|am|pm)?\b", "temporal", 0.75),
    Pattern("currency", r"(?i)[$€£¥₿]\s*\d+(?:[.,]\d{2,3})*(?:[.,]\d{2})?|\d+(?:[.,]\d{3})*(?:[.,]\d{2})?\s*(?:USD|EUR|GBP|BTC|ETH|USDT)", "financial", 0.85, True),
    Pattern("btc_address", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "crypto", 0.90, True),
    Pattern("eth_address", r"\b0x[a-fA-F0-9]{40}\b", "crypto", 0.95, True),
    Pattern("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b", "financial", 0.95, True),
    Pattern("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "financial", 0.90, True),
    Pattern("twitter_handle", r"@[A-Za-z0-9_]{1,15}\b", "social", 0.90),
    Pattern("hashtag", r"#[A-Za-z0-9_]+\b", "social", 0.95),
    Pattern("mention", r"@[A-Za-z0-9_.]+", "social", 0.85),
    Pattern("uuid", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "identifier", 0.99),
    Pattern("md5_hash", r"\b[a-fA-F0-9]{32}\b", "hash", 0.80),
    Pattern("sha1_hash", r"\b[a-fA-F0-9]{40}\b", "hash", 0.85),
    Pattern("sha256_hash", r"\b[a-fA-F0-9]{64}\b", "hash", 0.90),
    Pattern("base64", r"(?:[A-Za-z0-9+/]{4}){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?", "encoding", 0.60),
    Pattern("jwt", r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*", "auth", 0.95, True),
    Pattern("function_call", r"\b[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)", "code", 0.75),
    Pattern("import_statement", r"(?m)^(?:import|from|require|use|include)\s+.+$", "code", 0.90),
    Pattern("password_leak", r"""(?i)(?:password|passwd|pwd|secret|api[_-]?key|token|auth)\s*[:=]\s*['"]?[^\s'"]+""", "security", 0.80, True),
    Pattern("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "security", 0.99, True),
    Pattern("aws_key", r"(?i)AKIA[0-9A-Z]{16}", "security", 0.95, True),
    Pattern("github_token", r"ghp_[a-zA-Z0-9]{36}", "security", 0.99, True),
    Pattern("person_name", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", "entity", 0.50),
    Pattern("organization", r"(?i)\b[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:Inc|Corp|LLC|Ltd|GmbH|SA|SAS|SARL|Co|Company|Foundation|Institute|University|Association)\b", "entity", 0.60),
    Pattern("file_path", r"(?:/[a-zA-Z0-9._-]+)+|(?:[A-Z]:\\(?:[a-zA-Z0-9._-]+\\?)+)", "filesystem", 0.80),
    Pattern("domain", r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}\b", "network", 0.85),
]

_DEAD = {"organization": r"\b[A-Za-z][A-Za-z\s]*+"}
_DIGIT = "[0-9]"
_GUARD = {
    "email": "@", "twitter_handle": "@", "mention": "@", "hashtag": "#", "url": "://", "ip_address": _DIGIT, "phone": _DIGIT,
    "ipv6_address": ":", "mac_address": "[:-]", "date_iso": _DIGIT, "date_eu": _DIGIT, "date_text": _DIGIT, "time": _DIGIT, "currency": _DIGIT,
    "btc_address": "[13]", "eth_address": "0x", "iban": _DIGIT, "credit_card": _DIGIT, "uuid": "-", "jwt": "eyJ", "function_call": r"\(",
    "password_leak": "[:=]", "private_key": "-----BEGIN", "github_token": "ghp_", "file_path": r"[/\\]", "domain": r"\.[A-Za-z]{2}",
    "md5_hash": "[a-fA-F0-9]{32}", "sha1_hash": "[a-fA-F0-9]{40}", "sha256_hash": "[a-fA-F0-9]{64}", "base64": "[A-Za-z0-9+/]{40}",
}
REGISTRY = [p._replace(loop_form=_LOOP.get(p.name), dead_run=_DEAD.get(p.name), guard=_GUARD.get(p.name)) for p in REGISTRY]


def select_patterns(names=None, category=None, sensitive=None, registry=REGISTRY) -> list[Pattern]:
    return [p for p in registry if (names is None or p.name in names)
            and (category is None or p.category == category)
            and (sensitive is None or p.sensitive == sensitive)]


# Blocks of this many items keep the two-level running folds linear.
_BLOCK = 128


def running(values: Column, start: Column, step) -> Column:
    """All prefixes of a fold over an array: [start, step(start, v1), ...].

    ``step`` must be associative (sum, max).  A plain fold that appends to its own
    result copies it at every item; folding blocks first keeps long arrays cheap.
    """
    def prefixes(arr, first):
        return F.aggregate(arr, F.array(first), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))

    def fold(block):
        return F.aggregate(F.slice(block, F.lit(2), F.lit(_BLOCK)), F.element_at(block, 1), step)

    def blocked(arr):
        cuts = F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / _BLOCK).cast("int"))
        return let(F.transform(cuts, lambda b: F.slice(arr, b * _BLOCK + 1, F.lit(_BLOCK))),
                   lambda blocks: let(prefixes(F.transform(blocks, fold), start), lambda firsts: F.concat(
                       F.flatten(F.transform(
                           F.arrays_zip(blocks.alias("b"), F.slice(firsts, F.lit(1), F.size(blocks)).alias("f")),
                           lambda z: F.slice(prefixes(z["b"], z["f"]), F.lit(1), F.size(z["b"])))),
                       F.array(F.element_at(firsts, -1)))))

    return let(values, lambda arr: F.when(F.size(arr) <= _BLOCK, prefixes(arr, start)).otherwise(blocked(arr)))


def _spans(original: Column, folded: Column, p: Pattern, context: int) -> Column:
    def with_parts(parts):
        head = F.length(F.element_at(parts, 1))
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)),
                           lambda s: F.struct(F.length(F.substring_index(s, "\x02", 1)).alias("n"), (F.length(s) - 1).alias("step")))
        found = let(rest, lambda r: F.transform(F.arrays_zip(
            r.alias("r"), F.slice(running(F.transform(r, lambda z: z["step"]), head, lambda a, v: a + v), F.lit(1), F.size(r)).alias("s")), span))
        real = F.filter(found, lambda z: z["end"] > z["start"]) if p.dead_run else found
        return F.when(F.size(parts) > 1, real)

    def span(z):
        start, n = z["s"], z["r"]["n"]
        before = F.greatest(start - context, F.lit(0))
        return F.struct(
            F.lit(p.name).alias("pattern"), F.lit(p.category).alias("category"),
            F.substring(original, start + 1, n).alias("value"), start.alias("start"), (start + n).alias("end"),
            F.lit(p.confidence).alias("confidence"), F.lit(p.sensitive).alias("sensitive"),
            F.substring(original, before + 1, start + n - before + context).alias("context"))

    # a dead run becomes an empty match followed by its own text
    mark = "\x01$1\x02$2" if p.dead_run else "\x01$1\x02"
    found = let(F.split(F.regexp_replace(folded, p.jvm, mark), "\x01"), with_parts)
    return F.when(F.regexp_like(folded, F.lit(p.guard)), found) if p.guard else found


def all_spans(x, patterns, context: int = 50) -> Column:
    """Matches of several patterns with exact character offsets, as one array.

    One regex pass per pattern wraps each match in control marks; the lengths of the
    pieces between the marks give the offsets, so equal text elsewhere is never
    confused with a match.  The text is folded once for all patterns.
    """
    original = col(x)
    folded = F.translate(ascii_fold(original), "\x01\x02", "  ")
    return let(folded, lambda f: F.flatten(F.array_compact(F.array(*[_spans(original, f, p, context) for p in patterns]))))


def mask_spans(x, spans: Column, mark: str = "*") -> Column:
    """The text with the union of the spans replaced by ``mark``, length unchanged."""
    c = col(x)

    def masked(s):
        reach = running(F.transform(s, lambda z: z["e"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def piece(z):
            done, a, b = z["d"], z["z"]["s"], z["z"]["e"]
            gap = F.when(a > done, F.substring(c, done + 1, a - done)).otherwise("")
            return F.concat(gap, F.repeat(F.lit(mark), F.greatest(b - F.greatest(a, done), F.lit(0))))

        return let(reach, lambda r: F.concat(
            F.array_join(F.transform(F.arrays_zip(s.alias("z"), F.slice(r, F.lit(1), F.size(s)).alias("d")), piece), ""),
            F.substring(c, F.element_at(r, -1) + 1, F.length(c))))

    ordered = F.array_sort(F.transform(spans, lambda z: F.struct(z["start"].alias("s"), z["end"].alias("e"))))
    return let(ordered, lambda s: F.when(F.size(s) == 0, c).otherwise(masked(s)))


def highlight_spans(x, spans: Column) -> Column:
    """HTML of the text with typed spans wrapped; of overlapping spans the first stays."""
    from .text import escape_html

    c = col(x)
    s = F.array_sort(F.transform(spans, lambda z: F.struct(z["start"].alias("s"), z["end"].alias("e"), z["pattern"].alias("p"))))

    def keep(acc, z):
        take = z["s"] >= acc["done"]
        out = F.concat(acc["html"], escape_html(F.substring(c, acc["done"] + 1, z["s"] - acc["done"])),
                       F.lit('<span class="'), z["p"], F.lit('">'),
                       escape_html(F.substring(c, z["s"] + 1, z["e"] - z["s"])), F.lit("</span>"))
        return F.struct(F.when(take, z["e"]).otherwise(acc["done"]).alias("done"),
                        F.when(take, out).otherwise(acc["html"]).alias("html"))

    folded = F.aggregate(s, F.struct(F.lit(0).alias("done"), F.lit("").alias("html")), keep)
    return F.concat(folded["html"], escape_html(F.substring(c, folded["done"] + 1, F.length(c))))
