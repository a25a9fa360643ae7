"""Small functions that no other test reaches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import rewrite
from docweave.sources import code


@pytest.mark.parametrize(("a", "b", "newer"), [("1.2.3", "1.10.0", True), ("1.2", "1.2.0", False), ("2.0.0-rc1", "2.0.1", True), ("1.x", "2.0", False), ("1.0.0", "0.9.9", False)])
def test_versions(spark, a, b, newer):
    assert spark.range(1).select(tx.is_newer(F.lit(a), F.lit(b)).alias("x")).first().x is newer


def test_json_depth(spark):
    assert spark.range(1).select(tx.json_depth(F.lit('{"a": [1, {"b": "]}["}]}')).alias("x"), tx.json_depth(F.lit("1")).alias("y")).first() == (3, 0)


def test_index_lines(spark):
    lines = spark.createDataFrame([("- go (function) [calls] in src/a.ts:3",), ("run (class) src/b.ts:4",), ("find (type) in c.ts:5",), ("nothing",)], "text string")
    assert sorted(map(tuple, code.impact_rows(lines).collect())) == [("find", "type", "c.ts", "depends_on"), ("go", "function", "src/a.ts", "calls"), ("run", "class", "src/b.ts", "depends_on")]
    assert list(map(tuple, code.search_rows(lines).collect())) == [("find", "type", "c.ts", 5)]


def test_inline_update(spark):
    rows = [("/** Old. */\nf();", "Old.", "New."), ("/** A */ /** A */", "A", "B"), ("x", "y", "z"), ("/** A */", "A", "A"), ("/** S */\nT", "T", "U")]
    df = spark.createDataFrame([(*r, "typescript") for r in rows], "content string, old string, new string, language string")
    out = [(r.content, r.outcome) for r in rewrite.update_inline(df, "content", "old", "new", "language").collect()]
    assert out == [("/** New. */\nf();", "updated"), (rows[1][0], "ambiguous"), ("x", "not found"), ("/** A */", "unchanged"), (rows[4][0], "broken")]


def test_generator_choice(spark):
    rows = [("a/openapi.yaml", "", "generate:openapi"), ("a/x.yml", "openapi: 3.0\n", "generate:openapi"), ("docs/api/x.md", "", "docs:build"), ("a/x.yml", "other: 1", "docs:build")]
    df = spark.createDataFrame([(f, h) for f, h, _ in rows], "file string, head string").withColumn("scripts", F.array(F.lit("docs:build"), F.lit("generate:openapi")))
    assert [r.x for r in df.select(rewrite.generator(F.col("file"), F.col("scripts"), F.col("head")).alias("x")).collect()] == [r[2] for r in rows]
    none = df.withColumn("scripts", F.array().cast("array<string>"))
    assert {r.x for r in none.select(rewrite.generator(F.col("file"), F.col("scripts"), F.col("head")).alias("x")).collect()} == {None}


def test_locations_and_stems(spark):
    file, line = tx.parse_location(F.lit("C:/a/b.ts:12"))
    r = spark.range(1).select(file.alias("f"), line.alias("n"), tx.file_stem(F.lit("Docs\\Auth.Api.md")).alias("s"), tx.percent(F.lit(1), F.lit(8)).alias("p"), tx.strip_tail(F.lit("f() {")).alias("t"), tx.normalize_doc_lines(F.lit("a  \r\nb")).alias("d")).first()
    assert tuple(r) == ("C:/a/b.ts", 12, "auth.api", 13, "f()", "a\nb")


def test_an_index_names_symbols_and_files_give_the_rest(spark):
    sources = spark.createDataFrame([("src/a.ts", "/** Goes. */\nfunction go(\n  a: number,\n): void {\n}\n"), ("src/b.ts", "function other() {\n}\n")], "path string, content string")
    answers = spark.createDataFrame([("## function `go` (src/a.ts)\n- go in src/a.ts:2\n",)], "text string")
    (row,) = code.IndexExtractor(answers).extract(sources).collect()
    assert (row["name"], row.kind, row.file, row.line, row.signature, row.docstring, row.language) == ("go", "function", "src/a.ts", 2, "function go( a: number, ): void {", "Goes.", "typescript")
    fallback = code.IndexExtractor(answers.filter("false")).extract(sources)
    assert {r["name"] for r in fallback.collect()} == {"go", "other"}


def test_another_format_can_be_added(spark):
    from docweave.sources import parsers

    class Lines:
        def sections(self, content):
            for i, line in enumerate(content.split("\n")):
                yield f"line {i}", line, []

    parsers.register("lines", Lines())
    try:
        files = spark.createDataFrame([("a.lines", "x\ny")], "path string, content string")
        assert [(r.anchor, r.content, r.position) for r in parsers.parse_documents(files).orderBy("position").collect()] == [("line 0", "x", 0), ("line 1", "y", 1)]
    finally:
        parsers.FORMATS.pop("lines")


def test_signatures_in_awkward_sources():
    from docweave.functions import signatures as s

    assert s.current_signature("class A {\n  run(a)\n  {\n  }\n}", "run") == "run(a)\n  {"
    assert s.current_signature("interface I {\n  run(a): void;\n}\nfunction run<T extends (x: number) => void>(a: T) {\n}", "run").startswith("function run<T")
    assert s.current_signature("function f() {\n}\nfunction f(a) {\n}", "f", 2) == "function f(a) {"
    assert s.update_inline("/** A. */\nfunction f() {\n}\nf() {\nfunction f() {", "f", "typescript", "B.", "function f() {", "function f(a) {")[1] == "ambiguous signature"
    assert s.update_inline("def f():\n    '''A.'''\n", "f", "python", "B.", "", "") == ("def f():\n    '''B.'''\n", "updated")
