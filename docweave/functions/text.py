"""Scalar text functions as Column expressions (built in functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries.  The JVM's ``\b`` follows Unicode letters, which the semantics here do not.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Extractor kind -> stored kind.
KINDS = {
    "function": "function",
    "method": "function",
    "func": "function",
    "class": "class",
    "struct": "class",
    "module": "module",
    "namespace": "module",
    "api_endpoint": "api_endpoint",
    "endpoint": "api_endpoint",
    "route": "api_endpoint",
    "type": "type",
    "interface": "interface",
    "variable": "variable",
    "const": "variable",
    "let": "variable",
}


def strip(text: Column) -> Column:
    """Removes white space of all kinds at both ends (``trim`` removes spaces alone)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def kind_map(kind: Column, default: str = "unknown") -> Column:
    """Stored kind of an extractor's kind; what is not known becomes ``default``."""
    table = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(kind)), F.lit(default))


def normalize(text: Column) -> Column:
    """Lower case, letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def contains_ignore_case(needle: Column, haystack: Column) -> Column:
    return (F.length(needle) > 0) & (F.length(haystack) > 0) & F.contains(F.lower(haystack), F.lower(needle))


def file_stem(path: Column) -> Column:
    """Lower-case base name without its last extension."""
    base = F.substring_index(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/", -1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def clean_name(name: Column) -> Column:
    """Drops a call suffix: ``login(user)`` becomes ``login``."""
    return F.regexp_replace(name, r"\(.*\)$", "")


def is_code_like(name: Column) -> Column:
    """Upper case somewhere, an underscore between letters, or a leading underscore."""
    return name.rlike("[A-Z]|[a-zA-Z]_[a-zA-Z]|^_.")


def has_word(text: Column, word: str) -> Column:
    return F.lower(text).rlike(f"{LEFT}{escape_regex(word.lower())}{RIGHT}")


def escape_regex(text: str) -> str:
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\/-" else c for c in text)


def escape_like(text: str) -> str:
    return "".join(f"\\{c}" if c in "\\%_" else c for c in text)


def parse_location(location: Column) -> tuple[Column, Column]:
    """(file, line) of ``file:line``, divided at the last colon; nulls where it is malformed."""
    ok = location.rlike(r"^.+:\d+$")
    return F.when(ok, F.regexp_extract(location, r"^(.+):(\d+)$", 1)), F.when(ok, F.regexp_extract(location, r"^(.+):(\d+)$", 2).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(F.size(differs) > 0, F.array_min(differs) - 1).otherwise(n)


def has_common_substring(a: Column, b: Column, length: Column) -> Column:
    """Whether a substring of ``length`` characters of ``a`` stands in ``b``.

    A threshold on the longest common substring needs no dynamic programme: one of that length or
    more exists just if some window of that length does.
    """
    last = F.length(a) - length + 1
    windows = F.when((last > 0) & (length > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.exists(windows, lambda i: F.contains(b, F.substr(a, i, length)))


def fuzzy_match(needle: Column, haystack: Column) -> Column:
    """Containment either way, a long common prefix, or a long common substring, after ``normalize``.

    Prefix: at least 4 and six tenths of the shorter; substring: at least 4 and half of it.
    """
    n, h = normalize(needle), normalize(haystack)
    short = F.least(F.length(n), F.length(h))
    prefix = F.greatest(F.lit(4), F.floor(short * 0.6)).cast("int")
    middle = F.greatest(F.lit(4), F.floor(short * 0.5)).cast("int")
    similar = F.contains(h, n) | F.contains(n, h) | ((short >= prefix) & (F.substr(n, F.lit(1), prefix) == F.substr(h, F.lit(1), prefix))) | has_common_substring(n, h, middle)
    return F.coalesce((F.length(n) > 0) & (F.length(h) > 0) & similar, F.lit(False))


def occurrence_count(text: Column, part: Column, longest: int | None = None, most: int | None = None) -> Column:
    """Occurrences without overlap; if limits are given, -1 for a part that is longer than ``longest`` or found ``most`` times."""
    n = F.when(F.length(part) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))
    over = F.lit(False)
    if longest is not None:
        over |= F.length(part) > longest
    if most is not None:
        over |= n >= most
    return F.when(over, -1).otherwise(n).cast("long")


def strip_tail(signature: Column) -> Column:
    """A signature without a closing ``{``, ``=>`` or ``;``."""
    return strip(F.regexp_replace(signature, r"\s*(\{|=>|;)\s*$", ""))


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(100.0 * part / whole + 0.5)).otherwise(0).cast("long")


def first_of(*conditions: tuple[Column, object], otherwise: object) -> Column:
    return reduce(lambda acc, c: acc.when(c[0], c[1]), conditions[1:], F.when(*conditions[0])).otherwise(otherwise)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def normalize_doc_lines(text: Column) -> Column:
    """Line ends of one character; no white space at line ends."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t\r\f\x0B]+(?=\n|$)", "")


def is_newer(current: Column, latest: Column) -> Column:
    """Whether version ``latest`` is above ``current``: three numbers, suffixes after ``-`` left out.

    A part that is no number proves nothing.
    """

    def parts(version: Column) -> Column:
        numbers = F.transform(F.split(F.split_part(version, F.lit("-"), F.lit(1)), r"\."), lambda p: p.try_cast("int"))
        padded = F.concat(numbers, F.array(F.lit(0), F.lit(0), F.lit(0)))
        return F.slice(padded, 1, 3)

    a, b = parts(current), parts(latest)
    known = ~F.exists(a, lambda p: p.isNull()) & ~F.exists(b, lambda p: p.isNull())
    return F.when(known, b > a).otherwise(False)


def json_depth(text: Column) -> Column:
    """Deepest nesting of brackets outside strings."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    step = lambda acc, c: F.struct(
        (acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("d"), F.greatest(acc["m"], acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("m")
    )
    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda acc: acc["m"])
