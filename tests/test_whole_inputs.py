"""Queries over whole inputs hold what narrower ones leave out."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docweave.functions.text import occurrence_count
from docweave.operators import rewrite
from docweave.plans import queries as core
from docweave.sources.files import read_docs
from docweave.sources.parsers import parse_documents, parse_text
from tests.oracle import connect


def test_implied_reads_short_names_and_conversations(spark, sf_dir):
    con = connect(sf_dir)
    names = {w for (t,) in con.execute("SELECT text FROM benchmark").fetchall() for w in re.findall("[a-z]{6,}", t.lower())}
    rows = con.execute("SELECT CAST(doc_id AS VARCHAR), text FROM documents UNION ALL SELECT 'c' || conv_id || ':' || turn, text FROM conversations").fetchall()
    named = {d: names & set(re.findall("[a-z0-9_]+", t.lower())) for d, t in rows if re.match("[A-Za-z]+ [A-Za-z]+", t)}
    got = [r.doc_id for r in core.QUERIES["review_implied"](spark, sf_dir).collect()]
    assert len(got) == sum(map(len, named.values()))
    assert {d for d, n in named.items() if n} == set(got) and any(d.startswith("c") for d in got)


def test_rewrites_have_no_limit(spark):
    long = "x" * 10_001
    docs = spark.createDataFrame([(1, "the " * 100_000, "the"), (2, f"a {long} b", long)], "id int, text string, old string")
    n = {r.id: r.n for r in docs.select("id", occurrence_count(F.col("text"), F.col("old")).alias("n")).collect()}
    assert n == {1: 100_000, 2: 1}
    put = {r.id: r for r in rewrite.rewrite_signature(docs, "text", F.col("old"), F.lit("THE")).collect()}
    assert (put[1].n_replaced, put[1].text) == (100_000, "THE " * 100_000)
    assert (put[2].n_replaced, put[2].text) == (1, "a THE b")
    outcomes = {r.id: (r.outcome, r.text) for r in rewrite.rewrite_unique(docs, "text", F.col("old"), F.lit("new")).collect()}
    assert outcomes == {1: ("ambiguous", "the " * 100_000), 2: ("replaced", "a new b")}
    limited = docs.select(occurrence_count(F.col("text"), F.col("old"), longest=10_000, most=100_000).alias("n"))
    assert [r.n for r in limited.collect()] == [-1, -1]


def test_all_lines_are_validated_and_linked(spark, sf_dir):
    con = connect(sf_dir)
    joined = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    (lines,) = con.execute(f"SELECT count(*) FROM {joined}").fetchone()
    assert core.QUERIES["link_validate"](spark, sf_dir).count() == lines
    files: dict[str, list] = {}
    for name, brand in con.execute("SELECT replace(p_name, ' ', '_'), replace(lower(p_brand), '#', '_') FROM part").fetchall():
        files.setdefault(name, []).append(brand)
    uses = con.execute(f"SELECT DISTINCT CAST(o_orderkey AS VARCHAR), replace(p_name, ' ', '_'), 'brand_' || CAST(11 + o_custkey % 15 AS VARCHAR) FROM {joined}").fetchall()
    want = {(doc, name) for doc, name, own in uses if len(files[name]) == 1 or files[name].count(own) == 1}
    got = [(r.doc_id, r.ref) for r in core.QUERIES["ingest_links"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_long_files_are_parsed(spark, tmp_path):
    many = "\n" * 100_001
    for path, text in (("a.md", "# Title\n"), ("a.rst", "Title\n=====\n"), ("a.adoc", "== Title\n"), ("a.html", "<h1>Title</h1>\n")):
        assert [s[0] for s in parse_text(path, text + many)] == ["Title"]
        assert parse_text(path, text + many, max_lines=100_000) == []
    (_, _, refs), = parse_text("a.html", "<h1>T</h1>\n<pre>\n" + "-\n" * 6_000 + "lastCall()\n</PRE>\nafter()")
    assert [r.name for r in refs if r.kind == "codeblock"] == ["lastCall()"]
    (tmp_path / "big.md").write_text("# Big\n" + "x" * (10 * 1024 * 1024 + 1))
    found = parse_documents(read_docs(spark, str(tmp_path)))
    assert [r.anchor for r in found.select("anchor").collect()] == ["Big"]
    assert read_docs(spark, str(tmp_path), max_bytes=1_000).count() == 0
