"""Documentation parsers as table functions: files (path, content) to sections with code references.

One driver serves all formats.  A format says where headings stand, which lines are code, and what
references a line holds; fence state is the only thing that needs a loop, so texts are parsed in
Arrow batches, one row in, sections out, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REF = "struct<symbolName:string,refType:string,confidence:double,lineInDoc:int>"
SECTION_SCHEMA = f"file string, anchor string, content string, codeRefs array<{REF}>, position int"

# Prose words that are no weak references.
STOPWORDS = frozenset(
    """the this that these those there function functions method methods class classes returns return
    result results input output example below above called call calls using used when with from your
    into about through because which where have has would should could might more only also what will
    being been were does done very much such each any many some most other another after before during
    while""".split()
)

TICKED = re.compile(r"`(\w[\w.]+)`", re.ASCII)
TICKED_CALL = re.compile(r"`\w[\w.]*\(", re.ASCII)
CALL = re.compile(r"\b(\w[\w.]+\([^)]*\))", re.ASCII)
CALL_HEAD = re.compile(r"\b(\w[\w.]*)\(", re.ASCII)
BARE = re.compile(r"\b([A-Za-z][A-Za-z0-9_]*\.[A-Za-z0-9_]+|_?[A-Za-z][A-Za-z0-9_]*)\b", re.ASCII)
FENCE = re.compile(r"(```+|~~~+)(.*)", re.S)


@dataclass(frozen=True)
class Ref:
    name: str
    kind: str
    confidence: float
    line: int


class Seen:
    """Collects references, each name once in a collector."""

    def __init__(self):
        self.refs: list[Ref] = []
        self.names: set[str] = set()

    def add(self, name: str | None, kind: str, confidence: float, line: int) -> None:
        if name and name not in self.names:
            self.names.add(name)
            self.refs.append(Ref(name, kind, confidence, line))


def balanced_end(text: str, opening: int) -> int:
    """Place after the parenthesis that closes the one at ``opening``; -1 if none does."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, opening):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return -1


def ticked_call(text: str, tick: int) -> str | None:
    """The call within the backticks that open at ``tick``; backticks within its arguments pair up."""
    depth, quoted, i = 0, False, tick + 1
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != "`"
        elif c == "`":
            if not depth:
                return text[tick + 1 : i]
            quoted = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                close = text.find("`", i + 1)
                rest = text[i + 1 : close if close >= 0 else len(text)]
                if close >= 0 and rest.count("(") == rest.count(")"):
                    return text[tick + 1 : close]
                depth += rest.count("(") - rest.count(")")
        i += 1
    return None


def is_bare_candidate(word: str) -> bool:
    if word.lower() in STOPWORDS:
        return False
    if "." in word:
        return all(re.fullmatch(r"[a-zA-Z][a-zA-Z0-9_]*", p) for p in word.split("."))
    return bool(re.search(r"[A-Z_]", word)) or len(word) >= 4


def body_refs(text: str, base: int) -> list[Ref]:
    """Backtick calls .85 and names .6, each once; bare identifiers .15 wherever they stand."""
    seen, out = Seen(), []
    for n, line in enumerate(text.split("\n"), base + 1):
        before = len(seen.refs)
        for m in TICKED_CALL.finditer(line):
            seen.add(ticked_call(line, m.start()), "backtick", 0.85, n)
        for m in TICKED.finditer(line):
            seen.add(m[1], "backtick", 0.6, n)
        out += seen.refs[before:]
        out += [Ref(m[1], "bodytext", 0.15, n) for m in BARE.finditer(line) if is_bare_candidate(m[1]) and m[1] not in seen.names]
    return out


def heading_refs(heading: str, line: int) -> list[Ref]:
    seen = Seen()
    for m in TICKED.finditer(heading):
        seen.add(m[1], "heading", 0.7, line)
    for m in CALL_HEAD.finditer(heading):
        end = balanced_end(heading, m.end() - 1)
        if end > 0:
            seen.add(heading[m.start(1) : end], "heading", 0.5, line)
    return seen.refs


def fenced(lines: list[str]) -> list[str]:
    """For each line: "fence", "code" or "text".  A fence closes on the same mark, as long or longer, alone."""
    out, mark = [], ""
    for line in lines:
        m = FENCE.match(line)
        if not m:
            out.append("code" if mark else "text")
            continue
        out.append("fence")
        if not mark:
            mark = m[1]
        elif m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
            mark = ""
    return out


def rst_code(lines: list[str]) -> list[bool]:
    """Lines in a ``.. code::`` block, which an empty line before unindented text ends."""
    out, inside = [], False
    for i, line in enumerate(lines):
        opens = re.match(r"\.\.\s+code::", line, re.I)
        closes = inside and not line.strip() and i + 1 < len(lines) and not lines[i + 1].startswith(" ")
        out.append(inside and not opens and not closes)
        inside = bool(opens) or (inside and not closes)
    return out


def delimited_code(lines: list[str]) -> list[bool]:
    """Lines between lines of four or more dashes or dots."""
    out, inside = [], False
    for line in lines:
        edge = re.fullmatch(r"[-.]{4,}", line.strip())
        out.append(inside and not edge)
        inside ^= bool(edge)
    return out


def _calls(lines: list[str], code: list[bool], base: int) -> list[Ref]:
    seen = Seen()
    for n, (line, inside) in enumerate(zip(lines, code, strict=True), base + 1):
        for m in CALL.finditer(line) if inside else ():
            seen.add(m[1], "codeblock", 0.9, n)
    return seen.refs


def _found(pattern: str, confidence: float, inner: re.Pattern | None = None):
    """References that a pattern's first group gives, or the calls within it."""
    compiled = re.compile(pattern)

    def refs(lines: list[str], base: int) -> list[Ref]:
        seen = Seen()
        for n, line in enumerate(lines, base + 1):
            for m in compiled.finditer(line):
                for name in [x[1] for x in inner.finditer(m[1])] if inner else [m[1].strip()]:
                    seen.add(name, "link", confidence, n)
        return seen.refs

    return refs


@dataclass(frozen=True)
class Format:
    """headings: (line, lines that it takes, text, level) of each heading."""

    headings: Callable[[list[str]], list[tuple[int, int, str, int]]]
    code: Callable[[list[str]], list[bool]]
    links: Callable[[list[str], int], list[Ref]]

    def sections(self, content: str) -> Iterator[tuple[str, str, list[Ref]]]:
        lines = content.split("\n")
        heads = self.headings(lines)
        first = heads[0][0] if heads else len(lines)
        preamble = "\n".join(lines[:first])
        if preamble.strip():
            yield "", preamble, self.refs(preamble, 0)
        for (at, taken, text, _), until in zip(heads, [*(h[0] for h in heads[1:]), len(lines)], strict=False):
            body = "\n".join(lines[at + taken : until])
            refs = self.refs(body, at + taken, heading_refs(text, at + 1))
            yield text, "\n".join([*lines[at : at + taken], body]), refs

    def refs(self, body: str, base: int, heading: list[Ref] | None = None) -> list[Ref]:
        lines = body.split("\n")
        return body_refs(body, base) + (heading or []) + _calls(lines, self.code(lines), base) + self.links(lines, base)


def _markdown_headings(lines: list[str]) -> list[tuple[int, int, str, int]]:
    out = []
    for i, (line, state) in enumerate(zip(lines, fenced(lines), strict=True)):
        if state == "text" and (m := re.match(r"(#{1,6})\s+(.+)", line)):
            out.append((i, 1, m[2].strip(), len(m[1])))
    return out


def _rst_headings(lines: list[str]) -> list[tuple[int, int, str, int]]:
    return [(i, 2, line.strip(), 1) for i, line in enumerate(lines[:-1]) if re.fullmatch(r"[=\-~^\"']{3,}", lines[i + 1])]


def _asciidoc_headings(lines: list[str]) -> list[tuple[int, int, str, int]]:
    found = ((i, re.match(r"(={2,4})\s+(.+)", line)) for i, line in enumerate(lines))
    return [(i, 1, m[2].strip(), len(m[1])) for i, m in found if m]


MARKDOWN = Format(_markdown_headings, lambda lines: [s == "code" for s in fenced(lines)], _found(r"\[([^\]]+)\]\([^)]+\)", 0.5, CALL))
RST = Format(_rst_headings, rst_code, _found(r":(?:func|meth|class|mod|attr|exc|data|const|obj):`([^`]+)`", 0.95))
ASCIIDOC = Format(_asciidoc_headings, delimited_code, _found(r"(?:link|xref):([^\[]+)\[", 0.4))

_HTML_HEADING = re.compile(r"<h([1-6])[^>]*>(.+?)</h\1>", re.I)
_TAG = re.compile(r"<[^>]+>")
_PRE_END = re.compile("</pre>", re.I)


class Html:
    """Headings with a body on one line; references from code, pre and link elements."""

    @staticmethod
    def refs(text: str, base: int) -> list[Ref]:
        seen = Seen()
        at = 0
        for i, line in enumerate(text.split("\n")):
            n, start = base + i, at
            at += len(line) + 1
            for m in re.finditer(r"<code[^>]*>(.+?)</code>", line):
                code = _TAG.sub("", m[1])
                for c in CALL.finditer(code):
                    seen.add(c[1], "backtick", 0.85, n)
                for c in re.finditer(r"\b(\w[\w.]+)\b", code, re.ASCII):
                    seen.add(c[1], "backtick", 0.6, n)
            if pre := re.search(r"<pre[^>]*>", line, re.I):
                end = _PRE_END.search(text, start + pre.end())
                inner = text[start + pre.end() : end.start() if end else len(text)]
                for c in CALL.finditer(_TAG.sub("", inner)):
                    seen.add(c[1], "codeblock", 0.9, n)
            for m in re.finditer(r"<a[^>]*?href=[\"'][^\"']+[\"'][^>]*>(.+?)</a>", line):
                for c in CALL.finditer(_TAG.sub("", m[1])):
                    seen.add(c[1], "link", 0.5, n)
            for m in TICKED_CALL.finditer(line):
                seen.add(ticked_call(line, m.start()), "backtick", 0.85, n)
        return seen.refs

    def sections(self, content: str) -> Iterator[tuple[str, str, list[Ref]]]:
        heads = list(_HTML_HEADING.finditer(content))
        first = heads[0].start() if heads else len(content)
        if content[:first].strip():
            yield "", content[:first], self.refs(content[:first], 1)
        for m, until in zip(heads, [*(h.start() for h in heads[1:]), len(content)], strict=False):
            part, line = content[m.start() : until], content.count("\n", 0, m.start()) + 1
            text = _TAG.sub("", m[2]).strip()
            unique = {(r.name, r.kind, r.line): r for r in [*heading_refs(text, line)[::-1], *self.refs(part, line)[::-1]]}
            yield text, part, list(unique.values())[::-1]


class DocParser(Protocol):
    """What a documentation format has to offer: (anchor, content, references) of each section of a text."""

    def sections(self, content: str) -> Iterator[tuple[str, str, list[Ref]]]: ...


HTML: DocParser = Html()
#: Extension -> format; ``register`` adds others.
FORMATS = {"md": MARKDOWN, "mdx": MARKDOWN, "rst": RST, "adoc": ASCIIDOC, "asciidoc": ASCIIDOC, "html": HTML, "htm": HTML}


def register(extension: str, parser: DocParser) -> None:
    """Makes a format known to every reader of this process; executors get it with the functions that use it."""
    FORMATS[extension.lower()] = parser


_ARROW_REF = pa.struct([("symbolName", pa.string()), ("refType", pa.string()), ("confidence", pa.float64()), ("lineInDoc", pa.int32())])


def parse_text(path: str, content: str | None, max_bytes: int | None = None, max_lines: int | None = None, formats: dict[str, DocParser] | None = None) -> list[tuple[str, str, list[Ref]]]:
    """Sections of one file; a limit, if given, leaves out a longer file (``max_bytes`` counts characters)."""
    form = (formats or FORMATS).get(path.rsplit(".", 1)[-1].lower()) if path else None
    if form is None or not content or (max_bytes is not None and len(content) > max_bytes):
        return []
    if max_lines is not None and content.count("\n") >= max_lines:
        return []
    return list(form.sections(content))


def parse_documents(files: DataFrame, path: str = "path", content: str = "content", max_bytes: int | None = None, max_lines: int | None = None) -> DataFrame:
    """Sections of all files: (file, anchor, content, codeRefs, position); limits on a file are off by default."""
    formats = dict(FORMATS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *s, k) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, s in enumerate(parse_text(p, c, max_bytes, max_lines, formats))]
            refs = [[{"symbolName": r.name, "refType": r.kind, "confidence": r.confidence, "lineInDoc": r.line} for r in row[3]] for row in rows]
            columns = [pa.array([row[k] for row in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(refs, pa.list_(_ARROW_REF)), pa.array([row[4] for row in rows], pa.int32())], names=["file", "anchor", "content", "codeRefs", "position"])

    return files.select(F.col(path), F.col(content)).mapInArrow(parse, SECTION_SCHEMA)


def references(sections: DataFrame) -> DataFrame:
    """(file, anchor, ref, ref_type, confidence, line): one row a reference."""
    return sections.select("file", "anchor", F.inline("codeRefs")).toDF("file", "anchor", "ref", "ref_type", "confidence", "line")


# ---- built-in forms for texts in a column --------------------------------------


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, anchor, length): sections of pages in JVM code: heading bodies, and texts between them."""
    head = r"(?i)<h([1-6])[^>]*>(.+?)</h\1>"
    marked = F.split(F.regexp_replace(F.col(html), head, "\u0001$2\u0002"), "\u0001")
    parts = pages.select(key, F.posexplode(marked).alias("n", "part"))
    anchor = F.when(F.col("n") == 0, "").otherwise(F.trim(F.regexp_replace(F.split_part("part", F.lit("\u0002"), F.lit(1)), "<[^>]+>", "")))
    return parts.filter((F.col("n") > 0) | (F.length(F.trim("part")) > 0)).select(key, F.col("n").cast("long").alias("n"), anchor.alias("anchor"))


def bodytext_words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n): weak references of prose, counted; stop words and short lower-case words are none."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_]*\.[A-Za-z0-9_]+|_?[A-Za-z][A-Za-z0-9_]*)(?![A-Za-z0-9_])"), F.lit(1))
    words = texts.select(key, F.explode(found).alias("word"))
    ordinary = F.lower("word").isin(*sorted(STOPWORDS))
    dotted = F.col("word").rlike(r"^[a-zA-Z][a-zA-Z0-9_]*\.[a-zA-Z][a-zA-Z0-9_]*$")
    code = F.when(F.contains("word", F.lit(".")), dotted).otherwise(F.col("word").rlike("[A-Z_]") | (F.length("word") >= 4))
    return words.filter(~ordinary & code).groupBy(key, "word").agg(F.count("*").alias("n"))


# ---- locating a section in a file -----------------------------------------------


def section_bounds(content: str, anchor: str | None) -> tuple[int, int] | None:
    """(first line, line after the last) of the section under the heading ``anchor``, or None."""
    lines = content.split("\n")
    heads = _markdown_headings(lines)
    if not anchor:
        end = heads[0][0] if heads else len(lines)
        return (0, end) if "\n".join(lines[:end]).strip() else None
    for k, (at, _, text, level) in enumerate(heads):
        if text == anchor:
            return at, next((h[0] for h in heads[k + 1 :] if h[3] <= level), len(lines))
    return None


def locate_section(content: str, anchor: str) -> str | None:
    """The section under the heading ``anchor`` (case counts), to the next heading of its level or above.

    Headings in fences are none; ``''`` is the text before the first heading; None if there is none.
    """
    bounds = section_bounds(content, anchor)
    return "\n".join(content.split("\n")[bounds[0] : bounds[1]]) if bounds else None


def review_section(content: str, anchor: str) -> str | None:
    """As a review finds it: case apart, to the next heading of any level, fences unseen."""
    m = re.search(rf"^#{{1,6}}\s+{re.escape(anchor)}\s*$", content, re.I | re.M)
    if not m or not anchor:
        return None
    end = re.compile(r"^#{1,6}\s", re.M).search(content, m.end())
    return content[m.start() : end.start() if end else len(content)]


def located(files: DataFrame, content: str, anchor: str, review: bool = False) -> DataFrame:
    """``files`` with section: the located text of each row's anchor."""
    find = review_section if review else locate_section

    @F.pandas_udf("string")
    def section(contents: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([find(c or "", a or "") for c, a in zip(contents, anchors, strict=True)], dtype=object)

    return files.withColumn("section", section(F.col(content), F.col(anchor)))
