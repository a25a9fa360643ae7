"""Signatures and docstrings: what needs a scan with state, as plain functions and Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


#: Where a comment or a string may begin.
_CODE_MARK, _PYTHON_MARK = re.compile(r"//|/\*|[\"'`]"), re.compile(r"[#\"'`]")


def strip_code(text: str, language: str = "typescript", strings: bool = True, lines: bool = True) -> str:
    """Blanks out comments, and the insides of strings if ``strings``; length and lines stay.

    Without ``lines`` comments to the end of a line stay.
    """
    line_mark, mark = ("#", _PYTHON_MARK) if language == "python" else ("//", _CODE_MARK)
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while found := mark.search(text, i):
        i = found.start()
        if text.startswith(line_mark, i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            if lines:
                blank(i, end)
        elif language != "python" and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
        elif language == "python" and text[i : i + 3] in ('"""', "'''"):
            end = text.find(text[i : i + 3], i + 3)
            end = n if end < 0 else end + 3
            if strings:
                blank(i + 3, end - 3)
        elif text[i] in "\"'`" and not (language == "rust" and text[i] == "'" and not re.match(r"'(\\.|[^'\\])'", text[i:])):
            end = i + 1
            while end < n and text[end] != text[i] and (text[i] == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            if strings:
                blank(i + 1, end)
            end += 1
        else:
            end = i + 1
        i = end
    return "".join(out)


def matching_close(text: str, opening: int) -> int:
    """Place of the bracket that closes the one at ``opening``; -1 if none does.  ``=>`` and ``->`` close nothing."""
    stack = []
    for i in range(opening, len(text)):
        c = text[i]
        if c in "([{" or (c == "<" and stack):
            stack.append(_PAIRS[c])
        elif stack and c == stack[-1] and not (c == ">" and text[i - 1] in "=-"):
            stack.pop()
            if not stack:
                return i
    return -1


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between ``mark`` outside all brackets, stripped, without empty ones."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] not in ("=", "-")):
            depth -= 1
        elif c == mark and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def parameter_list(signature: str) -> str | None:
    """Text between the parentheses of the parameters (in Go not those of the receiver)."""
    start = re.match(r"\s*func\s*\([^)]*\)\s*", signature)
    opening = signature.find("(", start.end() if start else 0)
    close = matching_close(signature, opening) if opening >= 0 else -1
    return signature[opening + 1 : close] if close >= 0 else None


def parameters(signature: str | None) -> list[tuple[str, str]]:
    """(name, type) of each parameter; self and receivers are none, defaults are left out."""
    text = parameter_list(signature or "")
    out = []
    for part in split_top(text or ""):
        part = re.sub(r"^(?:public|private|protected|readonly|mut|&mut|&)\s+", "", part)
        left = split_top(part, "=")[0] if part else ""
        name, colon, kind = left.partition(":")
        if not colon and signature.lstrip().startswith("func") and " " in left:
            name, _, kind = left.partition(" ")
        name = name.strip().lstrip("*.").rstrip("?")
        if name and name not in ("self", "cls", "&self", "&mut self", "mut self", "/"):
            out.append((name, kind.strip()))
    return out


def return_type(signature: str | None) -> str:
    """What follows the parameters: after ``->`` or ``:``, or bare as in Go."""
    if parameter_list(signature or "") is None:
        return ""
    start = re.match(r"\s*func\s*\([^)]*\)\s*", signature)
    rest = signature[matching_close(signature, signature.find("(", start.end() if start else 0)) + 1 :].strip()
    rest = re.sub(r"\s*(\{.*|=>.*|;\s*)$", "", rest, flags=re.S) if not rest.startswith("->") else re.sub(r"\s*(\{.*|:\s*|;\s*)$", "", rest, flags=re.S)
    return rest.removeprefix("->").removeprefix(":").strip()


def python_docstring(lines: list[str], start: int) -> str | None:
    """The string that opens the body of the definition at ``start``."""
    depth, i = 0, start
    while i < len(lines):
        depth += sum(lines[i].count(c) for c in "([{") - sum(lines[i].count(c) for c in ")]}")
        i += 1
        if depth <= 0 and lines[i - 1].rstrip().endswith(":"):
            break
    while i < len(lines) and not lines[i].strip():
        i += 1
    m = re.match(r"\s*[rRuU]?(\"\"\"|''')", lines[i]) if i < len(lines) else None
    if not m:
        return None
    text = "\n".join([lines[i][m.end() :], *lines[i + 1 :]])
    end = text.find(m[1])
    return text[:end].strip() if end >= 0 else None


def docstring_before(lines: list[str], start: int, language: str) -> str | None:
    """The comment right above a definition: JSDoc, or a block of ``//`` (Go) or ``///`` (Rust) lines.

    Rust attributes may stand between.  Other languages have none.
    """
    i = start - 1
    if language == "rust":
        while i >= 0 and lines[i].strip().startswith("#["):
            i -= 1
    mark = {"go": "//", "rust": "///"}.get(language)
    if mark:
        taken = []
        while i >= 0 and lines[i].strip().startswith(mark):
            taken.append(lines[i].strip()[len(mark) :].strip())
            i -= 1
        return "\n".join(reversed(taken)) or None
    if language not in ("typescript", "javascript") or i < 0 or not lines[i].rstrip().endswith("*/"):
        return None
    first = i
    while first >= 0 and "/*" not in lines[first]:
        first -= 1
    if first < 0 or not lines[first].lstrip().startswith("/**"):
        return None
    text = "\n".join(lines[first : i + 1]).strip()[3:-2]
    return "\n".join(re.sub(r"^\s*\*\s?", "", x).rstrip() for x in text.split("\n")).strip() or None


def regenerate_docstring(old: str, signature: str, language: str = "typescript") -> str:
    """``old`` with its parameter and return entries brought in line with the signature.

    The description and the texts of parameters that remain are kept, in the signature's order.
    """
    name = r"@param\s+(?:\{[^}]*\}\s*)?\[?(\w+)" if language != "python" else r":param\s+(\w+)\s*:"
    head, texts, returns = [], {}, None
    for line in old.split("\n"):
        if m := re.match(rf"\s*{name}(.*)", line):
            texts[m[1]] = m[2].strip(" ]-:")
        elif m := re.match(r"\s*(?:@returns?|:returns?:)\s*(?:\{[^}]*\}\s*)?(.*)", line):
            returns = m[1].strip()
        else:
            head.append(line)
    out = ["\n".join(head).rstrip()] if "\n".join(head).strip() else []
    for p, kind in parameters(signature):
        text = texts.get(p, "")
        out.append(f":param {p}: {text}".rstrip() if language == "python" else f"@param {{{kind or '*'}}} {p}{' ' + text if text else ''}")
    kind = return_type(signature)
    if kind and kind not in ("void", "None", "()") or returns:
        out.append(f":returns: {returns or kind}".rstrip() if language == "python" else f"@returns {{{kind or '*'}}}{' ' + returns if returns else ''}")
    return "\n".join(out)


def is_bare_type(text: str) -> bool:
    return bool(re.fullmatch(r"[\w.$\[\]<>,|&\s*?]+", text.strip())) if text.strip() else False


def without_tail(signature: str) -> str:
    """A signature without a closing ``{``, ``=>`` or ``;``."""
    return re.sub(r"\s*(\{|=>|;)\s*$", "", signature).strip()


# ---- definitions in a file ---------------------------------------------------------

DOC_MARKS = {"go": "//", "rust": "///"}


def doc_language(path: str) -> str:
    """How a file's documentation is written: python, go, rust, or typescript for all else."""
    return {"py": "python", "pyi": "python", "go": "go", "rs": "rust"}.get(path.rsplit(".", 1)[-1].lower(), "typescript")


def _definition(name: str, language: str) -> re.Pattern:
    """Lines that define ``name``."""
    n = re.escape(name) + r"(?![\w$])"
    return re.compile(
        {
            "python": rf"\s*(?:async\s+)?(?:def|class)\s+{n}",
            "go": rf"\s*(?:func\s+(?:\([^)]*\)\s*)?|type\s+){n}",
            "rust": rf"\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*(?:fn|struct|trait|enum|type|mod)\s+{n}",
        }.get(language, rf".*?(?<![\w$])(?:(?:function|class|const|let|var|interface|type)\s+{n}|(?:async\s+)?{n}(?:<[^>]*>)?\s*\()"),
        re.ASCII,
    )


#: The same for any name of word characters, which is what the match names: a pattern a name takes longer to
#: compile than to apply.
_WORD = re.compile(r"\w+", re.ASCII)
_HEADS = {
    "python": re.compile(r"\s*(?:async\s+)?(?:def|class)\s+([\w$]+)", re.ASCII),
    "go": re.compile(r"\s*(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([\w$]+)", re.ASCII),
    "rust": re.compile(r"\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*(?:fn|struct|trait|enum|type|mod)\s+([\w$]+)", re.ASCII),
}
_DECLARED = re.compile(r"(?<![\w$])(?:function|class|const|let|var|interface|type)(?=\s+([\w$]+))", re.ASCII)
_CALLED = re.compile(r"(?<![\w$])([\w$]+)(?=(?:<[^>]*>)?\s*\()", re.ASCII)
_KEYWORD = re.compile(r"(?<!\w)(?:(function|class|interface)(?=\s+(\w+))|(?:const|let|var)(?=\s+(\w+)\s*=)|type(?=\s+(\w+)(?:<[^>]*>)?\s*=))", re.ASCII)
_METHOD = re.compile(r"(?<!\w)(\w+)(?=((?:<[^>]*>)?\s*\())", re.ASCII)


def _defines(name: str, language: str):
    """Whether a line defines ``name``, as a function of the line."""
    if not _WORD.fullmatch(name):
        return _definition(name, language).match
    if head := _HEADS.get(language):
        return lambda line: (m := head.match(line)) and m[1] == name
    return lambda line: name in line and any(m[1] == name for p in (_DECLARED, _CALLED) for m in p.finditer(line))


def _met(name: str):
    """(whether a line declares ``name``, whether as a function, end of the parenthesis that opens a method of it or 0), as a function of the line."""
    if _WORD.fullmatch(name):

        def met(code: str) -> tuple[bool, bool, int]:
            declared = [m[1] for m in _KEYWORD.finditer(code) if name in (m[2], m[3], m[4])]
            return bool(declared), "function" in declared, next((m.end() + len(m[2]) for m in _METHOD.finditer(code) if m[1] == name), 0)

        return met
    escaped = re.escape(name)
    function = re.compile(rf"(?<!\w)function\s+{escaped}(?!\w)", re.ASCII)
    keyword = re.compile(rf"(?<!\w)(?:(?:function|class|interface)\s+{escaped}(?!\w)|(?:const|let|var)\s+{escaped}(?!\w)\s*=|type\s+{escaped}(?!\w)(?:<[^>]*>)?\s*=)", re.ASCII)
    method = re.compile(rf"(?:async\s+)?(?<!\w){escaped}(?:<[^>]*>)?\s*\(", re.ASCII)
    return lambda code: (bool(keyword.search(code)), bool(function.search(code)), m.end() if (m := method.search(code)) else 0)


def _from_hint(count: int, hint: int | None):
    """Line numbers from ``hint`` to the end, then those before it."""
    start = hint if hint is not None and 0 <= hint < count else 0
    return [*range(start, count), *range(start)]


def _list_open(text: str, start: int = 0) -> int:
    """The first ``(`` outside angle brackets; -1 if there is none."""
    depth = 0
    for i in range(start, len(text)):
        if text[i] == "<":
            depth += 1
        elif text[i] == ">" and text[i - 1] not in "=-":
            depth = max(0, depth - 1)
        elif text[i] == "(" and not depth:
            return i
    return -1


def _parenthesis_end(text: str, opening: int) -> int:
    depth = 0
    for m in re.compile(r"[()]").finditer(text, opening):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return -1


def _folded(lines: list[str], i: int, opening: int) -> tuple[str, int, str] | None:
    """(text from line ``i`` to where the parenthesis closes, its last line, what follows the parenthesis)."""
    text, end = lines[i].strip(), i
    close = _parenthesis_end(text, opening)
    while close < 0 and end + 1 < len(lines):
        end += 1
        text += "\n" + lines[end]
        close = _parenthesis_end(text, opening)
    return (text, end, text[close + 1 :].lstrip()) if close >= 0 else None


def _next_text(lines: list[str], after: int) -> int:
    """The next line that is not blank; the number of lines if there is none."""
    return next((k for k in range(after + 1, len(lines)) if lines[k].strip()), len(lines))


def _with_body(lines: list[str], found: tuple[str, int, str], loose: bool) -> str | None:
    """The folded signature if a body follows, on its line or, brace alone, on the next one.

    Declarations that end with ``;`` have none.  ``loose``: a return type may stand before the brace
    on the next line.
    """
    text, end, rest = found
    if rest.startswith(("{", ":")):
        return None if re.sub(r"//.*$", "", rest).rstrip().endswith(";") else text.strip()
    k = _next_text(lines, end)
    if k == len(lines):
        return None
    if lines[k].strip().startswith("{"):
        return "\n".join([text, *lines[end + 1 : k + 1]]).strip()
    longer = f"{text}\n{lines[k]}"
    return longer.strip() if loose and "{" in longer else None


def current_signature(content: str, name: str, line: int | None = None) -> str | None:
    """The signature under which a file defines ``name`` now, or None.

    ``line`` (from 0) is where the search begins; it goes on from the top.  Comments and strings hold
    no definitions, overloads without a body are passed over, and a parameter list may go on over
    lines.  Functions, classes, variables, interfaces, types and methods count.
    """
    plain = not re.search(r"\s", name)  # then a line without the name defines it neither, whatever is blanked out
    if plain and name not in content:
        return None
    met = _met(name)
    lines = strip_code(content, strings=False, lines=False).split("\n")
    for i in _from_hint(len(lines), line):
        text = lines[i].strip()
        if plain and name not in text:
            continue
        declared, function, end = met(strip_code(text))
        if declared:
            opening = _list_open(text) if function else -1
            folded = _folded(lines, i, opening) if opening >= 0 else None
            if folded:
                if found := _with_body(lines, folded, loose=False):
                    return found
                continue
            opening = text.find("(")
            if opening >= 0 and _parenthesis_end(text, opening) < 0 and (folded := _folded(lines, i, opening)):
                return folded[0].strip()
            return text
        if end and (folded := _folded(lines, i, end - 1)) and (found := _with_body(lines, folded, loose=True)):
            return found
    return None


def docstring_span(content: str, name: str, language: str, line: int | None = None) -> tuple[int, int, str] | None:
    """(first line, line after the last, text) of the documentation of ``name`` as it stands in a file."""
    lines, defines = content.split("\n"), _defines(name, language)
    at = next((i for i in _from_hint(len(lines), line) if defines(lines[i])), None)
    if at is None:
        return None
    if language == "python":
        text = python_docstring(lines, at)
        first = next((i for i in range(at + 1, len(lines)) if re.match(r"\s*[rRuU]?(\"\"\"|''')", lines[i])), None)
        if text is None or first is None:
            return None
        mark = re.match(r"\s*[rRuU]?(\"\"\"|''')", lines[first])
        last = first if mark[1] in lines[first][mark.end() :] else next(i for i in range(first + 1, len(lines)) if mark[1] in lines[i])
        return first, last + 1, text
    text = docstring_before(lines, at, language)
    if text is None:
        return None
    while language == "rust" and lines[at - 1].strip().startswith("#["):
        at -= 1
    first = at - 1
    if language in DOC_MARKS:
        while first > 0 and lines[first - 1].strip().startswith(DOC_MARKS[language]):
            first -= 1
    else:
        while "/*" not in lines[first]:
            first -= 1
    return first, at, text


def replace_docstring(content: str, name: str, language: str, new: str, line: int | None = None) -> str | None:
    """``content`` with the documentation of ``name`` replaced in its language's form; None if it has none."""
    span = docstring_span(content, name, language, line)
    if span is None:
        return None
    first, until, old = span
    lines = content.split("\n")
    indent = re.match(r"\s*", lines[first])[0]
    if language in DOC_MARKS:
        written = [f"{indent}{DOC_MARKS[language]} {x}".rstrip() for x in new.split("\n")]
    elif language == "python":
        written = "\n".join(lines[first:until]).replace(old, new.replace("\n", "\n" + indent), 1).split("\n")
    elif "\n" not in new and until - first == 1:
        written = [f"{indent}/** {new} */"]
    else:
        written = [f"{indent}/**", *(f"{indent} * {x}".rstrip() for x in new.split("\n")), f"{indent} */"]
    return "\n".join([*lines[:first], *written, *lines[until:]])


def update_inline(content: str, name: str, language: str, new_doc: str, old_signature: str, new_signature: str, line: int | None = None) -> tuple[str, str]:
    """(text, outcome) of bringing a file's documentation of ``name`` in line with a new signature.

    updated; or, with the text unchanged: no docstring (nothing may be destroyed), empty, ambiguous or
    missing signature (a signature that stands in code other than once), or broken (the result does
    not hold the new signature or documentation exactly once).  In scripts the signature is replaced
    too; elsewhere only the documentation is.
    """
    span = docstring_span(content, name, language, line)
    if span is None:
        return content, "no docstring"
    if not span[2].strip() or not new_doc.strip():
        return content, "empty"
    if language == "typescript":
        if not old_signature.strip() or not new_signature.strip():
            return content, "empty"
        # Strings are blanked with their quotes kept, on both sides alike.
        n = strip_code(content).count(strip_code(old_signature))
        if n != 1 or content.count(old_signature) != 1:
            return content, "missing signature" if n == 0 else "ambiguous signature"
        changed = content.replace(old_signature, new_signature)
        written = replace_docstring(changed, name, language, new_doc, line)
        if written is None or strip_code(written).count(strip_code(new_signature)) != 1:
            return content, "broken"
        return written, "updated"
    written = replace_docstring(content, name, language, new_doc, line)
    return (written, "updated") if written is not None else (content, "broken")


def signature_udf(kind: str = "current"):
    """UDF (content, name, line from 1, path) -> text: the ``current`` signature, or the ``docstring``."""

    @F.pandas_udf("string")
    def found(content: pd.Series, name: pd.Series, line: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for c, n, at, p in zip(content, name, line, path, strict=True):
            hint = int(at) - 1 if at is not None and at == at else None
            if not c or not n:
                out.append(None)
            elif kind == "current":
                out.append(current_signature(c, n, hint))
            else:
                span = docstring_span(c, n, doc_language(p or ""), hint)
                out.append(span and span[2])
        return pd.Series(out, dtype=object)

    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])))
def signature_params(signature: pd.Series) -> pd.Series:
    return signature.map(lambda s: [{"name": n, "type": t} for n, t in parameters(s)])


@F.pandas_udf(T.StringType())
def signature_return(signature: pd.Series) -> pd.Series:
    return signature.map(return_type)


@F.pandas_udf(T.StringType())
def docstring_regen(old: pd.Series, signature: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([regenerate_docstring(o or "", s or "", x or "typescript") for o, s, x in zip(old, signature, language, strict=True)])


@F.pandas_udf(T.StringType())
def stripped(content: pd.Series) -> pd.Series:
    return content.map(lambda c: strip_code(c or ""))


@F.pandas_udf(T.BooleanType())
def bare_type(text: pd.Series) -> pd.Series:
    return text.map(lambda t: is_bare_type(t or ""))
