"""Ignore rules: a subset of gitignore patterns, the last that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(rule: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, whether a match ignores it); None for blanks and comments."""
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    ignores = not rule.startswith("!")
    rule = rule if ignores else rule[1:]
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    rooted, rule = "/" in rule, rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(rule[i], re.escape(rule[i])), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), ignores


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the rules ignore a path.  Rules are read from the last: the first hit decides."""
    out: Column | None = None
    for compiled in filter(None, map(pattern, reversed(rules))):
        hit = path.rlike(compiled[0])
        out = F.when(hit, compiled[1]) if out is None else out.when(hit, compiled[1])
    return F.lit(False) if out is None else out.otherwise(False)


def with_ignored(files: DataFrame, rules: list[str], path: str = "path") -> DataFrame:
    return files.withColumn("ignored", ignored(F.col(path), rules))


def is_ignored(path: str, rules: list[str]) -> bool:
    for compiled in filter(None, map(pattern, reversed(rules))):
        if re.search(compiled[0], path):
            return compiled[1]
    return False
