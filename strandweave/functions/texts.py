"""Column functions on text: repair, questions, tokens, sentences."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TOKEN = "[A-Za-z0-9']+"
#: White space as str.strip sees it.
_BLANK = r"[\s\u0085\u001c-\u001f\p{Z}]+"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_BLANK}|{_BLANK}$", "")


#: Repairs of JSON text, in order: line ends, bare NaN and infinities, control characters, trailing commas (fixed values).
REPAIRS = (
    (r"\r\n?", "\n"),
    (r'(?<!["\w])-?(?:NaN|Infinity)\b', "null"),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""),
    (r",(\s*[\]}])", "$1"),
)


def repair_json(s: Column) -> Column:
    return functools.reduce(lambda text, step: F.regexp_replace(text, *step), REPAIRS, s)


def remove_tags(s: Column) -> Column:
    return F.regexp_replace(s, rf"#{WORD}", "")


#: What a question is freed of, in order: pattern, replacement (fixed values).
PREFIXES = (
    (r"(?i)^\s*(?:---\s*QUESTION\s*---|Question\s*:)\s*", ""),
    (r"^\s*(?:-+\s*|\*+\s*)", ""),
    (r"\s+", " "),
    (rf"#{WORD}", ""),
)
#: Marks that don't end a question, and a generator's refusal (fixed values).
OTHER_ENDS = r"[.!]+$"
REFUSAL = r"(?i)^\s*\(?no question can be generated from the given narrations\)?\s*\?$"


def without_prefixes(s: Column) -> Column:
    return functools.reduce(lambda text, step: F.trim(F.regexp_replace(text, *step)), PREFIXES, s)


def normalized_question(s: Column) -> Column:
    q = F.trim(F.regexp_replace(without_prefixes(F.coalesce(s, F.lit(""))), OTHER_ENDS, ""))
    return F.when((q == "") | q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))


def refuses(s: Column) -> Column:
    return s.rlike(REFUSAL)


def tokens(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(WORD))


def sentences(s: Column) -> Column:
    """Parts between sentence ends, stripped, longer than two characters; the whole text if there is no part."""
    parts = F.filter(F.transform(F.split(s, r"[.!?]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(s))
    return F.filter(parts, lambda p: F.length(p) > 2)


def thinned(lines: Column, most: int) -> Column:
    """At most ``most`` entries, evenly spread from first to last, ties to even."""
    n = F.size(lines)
    place = lambda k: F.bround(k * (n - 1) / F.lit(float(most - 1))).cast("int")
    return F.when(n <= most, lines).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get(lines, place(k))))


def anchors(lines: Column, n: int = 10) -> Column:
    """The first ``n`` distinct tokens of all lines, sorted."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(lines, tokens)))), 1, n)


def shortened(s: Column, n: int = 24) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)
