"""Symbol extraction from source files (path, content): definitions by rule, signatures, docstrings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signatures import docstring_before, python_docstring, signature_udf

SYMBOL_SCHEMA = "name string, kind string, file string, line int, signature string, raw_signature string, docstring string, language string"

# Languages by extension, and the definition patterns of each, in order of precedence.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": ".mjs", "cjs": ".cjs", "py": "python", "go": "go", "rs": "rust", "pyi": "python"}
_SCRIPT = [
    (r"\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+(\w[\w$]*)", "function"),
    (r"\s*(?:export\s+(?:default\s+)?)?class\s+(\w[\w$]*)", "class"),
    (r"\s*export\s+const\s+(\w[\w$]*)\s*[:=]", "variable"),
    (r"\s*(?:export\s+)?const\s+(\w[\w$]*)\s*=\s*(?:async\s*)?(?:\(|function)", "function"),
    (r"\s*(?:export\s+)?interface\s+(\w[\w$]*)", "interface"),
    (r"\s*(?:export\s+)?type\s+(\w[\w$]*)\s*[=<]", "type"),
]
RULES = {
    "py": [(r"\s*(?:async\s+)?def\s+(\w+)\s*\(", "function"), (r"\s*class\s+(\w+)", "class")],
    "go": [
        (r"\s*func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?(\w+)\s*\(", "function"),
        (r"\s*type\s+(\w+)\s+struct\s*\{", "class"),
        (r"\s*type\s+(\w+)\s+interface\s*\{", "interface"),
    ],
    "rs": [
        (r"\s*(?:pub(?:\s*\(\s*crate\s*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)\s*[<(]", "function"),
        (r"\s*(?:pub\s+)?struct\s+(\w+)", "class"),
        (r"\s*(?:pub\s+)?trait\s+(\w+)", "interface"),
        (r"\s*(?:pub\s+)?enum\s+(\w+)", "type"),
        (r"\s*impl\s+(?:\w+\s+for\s+)?(\w+)", "class"),
    ],
} | dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs"), _SCRIPT)
_COMPILED = {ext: [(re.compile(p, re.ASCII), k) for p, k in rules] for ext, rules in RULES.items()}
SIGNATURE_LINES = 10


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    file: str
    line: int
    signature: str
    raw_signature: str
    docstring: str | None
    language: str


def fold_signature(lines: list[str], start: int, most: int = SIGNATURE_LINES) -> tuple[str, str]:
    """(one line, as written): lines from ``start`` until parentheses balance and ``{``, ``=>`` or ``;`` has come."""
    depth, taken = 0, []
    for line in lines[start : start + most]:
        taken.append(line)
        depth += line.count("(") - line.count(")")
        if depth <= 0 and re.search(r"\{|=>|;", line):
            break
    return " ".join(" ".join(taken).split()), "\n".join(taken)


def extract(path: str, content: str) -> Iterator[Symbol]:
    """All definitions; a line may match several rules, equal (line, name, kind) count once."""
    ext = path.rsplit(".", 1)[-1].lower()
    lines, seen = content.split("\n"), set()
    for i, line in enumerate(lines):
        for rule, kind in _COMPILED.get(ext, ()):
            m = rule.match(line)
            if m and (i, m[1], kind) not in seen:
                seen.add((i, m[1], kind))
                signature, raw = fold_signature(lines, i)
                language = LANGUAGES[ext]
                doc = python_docstring(lines, i) if language == "python" else docstring_before(lines, i, language)
                yield Symbol(m[1], kind, path, i + 1, signature, raw, doc, language)


_FIELDS = [("name", pa.string()), ("kind", pa.string()), ("file", pa.string()), ("line", pa.int32()), ("signature", pa.string()), ("raw_signature", pa.string()), ("docstring", pa.string()), ("language", pa.string())]


def extract_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Symbols of all files, row by row, without a shuffle."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if p and c for s in extract(p, c)]
            yield pa.RecordBatch.from_arrays([pa.array([getattr(s, n) for s in found], t) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])

    return files.select(F.col(path), F.col(content)).mapInArrow(parse, SYMBOL_SCHEMA)


# ---- text answers of an external index -------------------------------------------

_HEADER = re.compile(r"^#+\s*(?:(\w+)\s+)?`?([\w.$]+)`?.*?\(([^():]+?)(?::(\d+))?\)\s*$")
_BULLET = re.compile(r"^\s*[-*]\s+`?([\w.$]+)`?\s*(?:\((\w+)\))?\s*(?:[—:-]|in)?\s*([\w./-]+\.\w+):(\d+)")


def parse_index_text(text: str) -> list[tuple[str, str, str, int]]:
    """(name, kind, file, line) from an index's listing.

    Bullets give lines, headers give kinds; a header without a bullet stands for itself; lists that
    only mention names have no place and are left out.
    """
    kinds: dict[tuple[str, str], str] = {}
    found: dict[tuple[str, str, int], str | None] = {}
    for line in text.split("\n"):
        if m := _HEADER.match(line):
            kinds[m[2], m[3]] = (m[1] or "function").lower()
            if m[4]:
                found.setdefault((m[2], m[3], int(m[4])), None)
        elif m := _BULLET.match(line):
            found.setdefault((m[1], m[3], int(m[4])), m[2])
    return [(n, k or kinds.get((n, f), "function"), f, at) for (n, f, at), k in found.items()]


def index_rows(answers: DataFrame, text: str = "text") -> DataFrame:
    """``answers`` with name, kind, file and line for each symbol that an index's listing names."""

    @F.pandas_udf("array<struct<name:string,kind:string,file:string,line:int>>")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("name", "kind", "file", "line"), row, strict=True)) for row in parse_index_text(t or "")])

    return answers.select("*", F.inline(listed(F.col(text))))


class SymbolExtractor(Protocol):
    """What a source of symbols has to offer: rows of SYMBOL_SCHEMA from (path, content)."""

    def extract(self, files: DataFrame) -> DataFrame: ...


class RuleExtractor:
    """The built-in rules."""

    def extract(self, files: DataFrame) -> DataFrame:
        return extract_symbols(files)


@dataclass(frozen=True)
class IndexExtractor:
    """Symbols from the captured listings (text) of an external index, signatures and docstrings from the files.

    Starting the index's process is no matter of an engine: its answers come as a table.  If they name
    no symbol although there are files, the built-in rules take over.
    """

    answers: DataFrame

    def extract(self, files: DataFrame) -> DataFrame:
        found = index_rows(self.answers).select("name", "kind", F.col("file").alias("path"), "line").distinct()
        if found.isEmpty():
            return extract_symbols(files)
        language = F.try_element_at(F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p)), F.lower(F.substring_index("path", ".", -1)))
        met = found.join(files.select("path", "content"), "path", "left")
        signature = signature_udf()("content", "name", "line", "path")
        return met.select(
            "name", "kind", F.col("path").alias("file"), "line", F.regexp_replace(signature, r"\s+", " ").alias("signature"), signature.alias("raw_signature"),
            signature_udf("docstring")("content", "name", "line", "path").alias("docstring"), F.coalesce(language, F.lit("")).alias("language"),
        )


def last_definition(lines: DataFrame, name: str, text: str = "text", pos: str = "pos") -> DataFrame:
    """The last line (by ``pos``) that defines ``name``."""
    pattern = rf"(?<![A-Za-z0-9_])(function|class|def|fn|func|const|interface|type|struct|trait)\s+{re.escape(name)}(?![A-Za-z0-9_])"
    return lines.filter(F.col(text).rlike(pattern)).agg(F.max_by(text, pos).alias(text))


def impact_rows(lines: DataFrame, text: str = "text") -> DataFrame:
    """(name, kind, file, relation) of an index's impact lines; without a relation, ``depends_on``."""
    pattern = r"(\w+)\s*\((\w+)\)\s*(?:\[(\w+)\]\s*)?(?:in\s+)?(\S+):(\d+)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    relation = F.when(part(3) == "", "depends_on").otherwise(part(3))
    return lines.filter(F.col(text).rlike(pattern)).select(part(1).alias("name"), part(2).alias("kind"), part(4).alias("file"), relation.alias("relation"))


def search_rows(lines: DataFrame, text: str = "text") -> DataFrame:
    """(name, kind, file, line) of an index's search lines."""
    pattern = r"(\w+)\s*\((\w+)\)\s*in\s+(\S+):(\d+)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return lines.filter(F.col(text).rlike(pattern)).select(part(1).alias("name"), part(2).alias("kind"), part(3).alias("file"), part(4).cast("int").alias("line"))
