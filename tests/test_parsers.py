from __future__ import annotations

from docweave.sources import code, ignore, parsers


def names(text, path, *kinds):
    return [(anchor, [r.name for r in refs if r.kind in kinds]) for anchor, _, refs in parsers.parse_text(path, text)]


def test_markdown_sections_and_fences():
    text = "Intro words.\n\n# One\ntext\n~~~\n# not one\n```\n~~~\n## Two\n### Three\nend"
    found = parsers.parse_text("a.md", text)
    assert [f[0] for f in found] == ["", "One", "Two", "Three"]
    assert "# not one" in found[1][1]


def test_longer_fence_is_closed_by_its_own_kind():
    text = "````\n```js\n# inside\n```\n````\n# Out"
    assert [f[0] for f in parsers.parse_text("a.md", text)] == ["", "Out"]


def test_no_heading_is_one_section_and_blank_is_none():
    assert [f[0] for f in parsers.parse_text("a.md", "just text")] == [""]
    assert parsers.parse_text("a.md", "  \n") == []
    assert parsers.parse_text("a.txt", "text") == []
    assert parsers.parse_text("a.md", None) == []


def test_backticks_nested_calls_and_unbalanced():
    assert names("Use `f(g(1), \"`x`\")` and `Name.part`.", "a.md", "backtick") == [("", ['f(g(1), "`x`")', "Name.part"])]
    assert names("Broken `f(1` here", "a.md", "backtick") == [("", [])]


def test_body_words():
    found = names("The loginUser of a small_thing in auth.login is good", "a.md", "bodytext")[0][1]
    assert found == ["loginUser", "small_thing", "auth.login", "good"]


def test_heading_and_link_references():
    assert names("# Use `run` and go(f(1))\nsee [call_it(x)](u)", "a.md", "heading", "link") == [("Use `run` and go(f(1))", ["run", "go(f(1))", "f(1)", "call_it(x)"])]


def test_rst_and_asciidoc():
    assert names("Top\n===\n:class:`Box` x\n\nNext\n~~~~\n", "a.rst", "link") == [("Top", ["Box"]), ("Next", [])]
    assert [f[0] for f in parsers.parse_text("a.adoc", "= Title\n== A\n...\n==== B")] == ["", "A", "B"]


def test_html():
    text = "<p>pre</p>\n<H2 class='x'>The <b>one</b></H2>\n<code>go(1)</code> <a href=\"u\">see(2)</a>\n<pre>run(3)</pre>"
    found = parsers.parse_text("x.html", text)[1][2]
    assert {(r.name, r.kind, r.line) for r in found} == {("go(1)", "backtick", 3), ("go", "backtick", 3), ("see(2)", "link", 3), ("run(3)", "codeblock", 4)}
    assert [f[0] for f in parsers.parse_text("x.htm", text)] == ["", "The one"]


def test_locating_sections():
    text = "pre\n# A\nx\n## B\ny\n# C\nz"
    assert parsers.locate_section(text, "A") == "# A\nx\n## B\ny"
    assert parsers.locate_section(text, "a") is None
    assert parsers.locate_section(text, "") == "pre"
    assert parsers.review_section(text, "a") == "# A\nx\n"
    assert parsers.review_section(text, "") is None


def test_extraction_order_signature_and_docstrings():
    text = "/** Adds. */\nexport const add = (a: number,\n  b: number) => {\n}\nfunction x();"
    found = list(code.extract("a.ts", text))
    assert [(s.name, s.kind, s.line) for s in found] == [("add", "variable", 2), ("add", "function", 2), ("x", "function", 5)]
    assert found[0].signature == "export const add = (a: number, b: number) => {"
    assert found[0].docstring == "Adds."
    python = "class A:\n    def f(self, x):\n        '''Says.'''\n        return x\n"
    assert [(s.name, s.docstring) for s in code.extract("a.py", python)] == [("A", None), ("f", "Says.")]
    rust = "/// Makes.\n#[inline]\npub fn make<T>(x: T) -> T {\n}"
    assert [(s.name, s.docstring) for s in code.extract("a.rs", rust)] == [("make", "Makes.")]
    go = "// Run runs.\nfunc (s *S) Run(a int) error {\n}"
    assert [(s.name, s.docstring) for s in code.extract("a.go", go)] == [("Run", "Run runs.")]
    assert list(code.extract("a.pyi", "def f(): ...")) == []


def test_ignore_last_match_wins():
    rules = ["*.log", "!keep.log", "/build/", "docs/**/tmp", "# comment", ""]
    cases = {"a.log": True, "x/a.log": True, "keep.log": False, "build/x": True, "src/build/x": False, "docs/a/b/tmp": True, "docs/tmp/x": True, "other": False}
    assert {p: ignore.is_ignored(p, rules) for p in cases} == cases


def test_ignore_column_agrees(spark):
    rules = ["*.log", "!keep.log", "build/"]
    paths = ["a.log", "keep.log", "x/build/y", "z"]
    df = ignore.with_ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    assert {r.path: r.ignored for r in df.collect()} == {p: ignore.is_ignored(p, rules) for p in paths}


def test_index_text():
    text = "## class `Box` (src/a.ts)\n- `Box` (class) - src/a.ts:12\n- `go` in src/b.ts:3\nmentions: a, b"
    assert code.parse_index_text(text) == [("Box", "class", "src/a.ts", 12), ("go", "function", "src/b.ts", 3)]


def test_parse_documents(spark):
    files = spark.createDataFrame([("a.md", "# X\n`go`"), ("b.md", None), ("c.txt", "x")], "path string, content string")
    rows = parsers.references(parsers.parse_documents(files)).collect()
    assert [(r.file, r.anchor, r.ref, r.ref_type, r.line) for r in rows] == [("a.md", "X", "go", "backtick", 2)]
