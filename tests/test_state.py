"""State transitions on tiny tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.functions import ids
from docweave.functions import text as tx
from docweave.model import State, violations
from docweave.operators import linking, reports, rewrite, state


@pytest.fixture(scope="module")
def base(spark):
    ts = "timestamp'2024-01-01 00:00:00'"
    symbols = spark.sql(f"SELECT * FROM VALUES ('s1','login','function','p','src/auth.ts:3','h1','r1'),('s2','Box','class','p','src/box.ts:9','h2','r2') t(id,name,kind,project,location,signature,raw_signature)").withColumns({"created_at": F.expr(ts)})
    docs = spark.sql("SELECT * FROM VALUES ('d1','docs/auth.md','Login','c1','standalone','in_sync'),('d2','docs/auth.md','Other','c2','inline','stale'),('d3','docs/x.md','','c3','generated','draft') t(id,file,anchor,content_hash,doc_type,status)").withColumn("created_at", F.expr(ts))
    mappings = spark.sql(f"SELECT *, {ts} AS created_at FROM VALUES ('s1','d1','describes','auto'),('s1','d2','describes','confirmed'),('s1','d3','references','rejected') t(symbol_id,doc_id,rel_type,review_status)")
    changelog = spark.sql(f"SELECT * FROM VALUES (1L,{ts},'s1','created','','r1','applied') t(id,timestamp,symbol_id,change_type,old_sig,new_sig,sync_status)")
    return State(symbols, docs, mappings, changelog)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cascade_skips_rejected(spark, base):
    changed = spark.createDataFrame([("s1",), ("s2",)], "symbol_id string")
    assert rows(state.change_cascade(base, changed), "symbol_id", "affected_docs", "sync_status") == [("s1", "d1,d2", "pending"), ("s2", "", "applied")]
    assert rows(state.mark_stale(base, changed), "id", "status") == [("d1", "stale"), ("d2", "stale"), ("d3", "draft")]


def test_sticky_upserts(spark, base):
    batch = base.doc_sections.withColumns({"status": F.lit("in_sync"), "content_hash": F.lit("n")})
    assert rows(state.upsert_sections(base.doc_sections, batch), "id", "status", "content_hash") == [("d1", "in_sync", "n"), ("d2", "stale", "n"), ("d3", "draft", "n")]
    events = spark.createDataFrame([("s", "d", "describes", "auto", 1), ("s", "d", "describes", "rejected", 2), ("s", "d", "describes", "confirmed", 3)], "symbol_id string, doc_id string, rel_type string, review_status string, t int")
    assert rows(state.mapping_fold(events, "t"), "review_status") == [("rejected",)]


def test_scan_twice_changes_nothing(base):
    assert rows(state.scan_diff(base.symbols, base.symbols).groupBy("change").count(), "change", "count") == [("unchanged", 2)]


def test_gc_marks_then_deletes(spark, base):
    scanned = spark.createDataFrame([("s2",)], "id string")
    assert rows(state.gc_plan(base, scanned), "symbol_id", "action") == [("s1", "mark")]
    marked = base.with_(changelog=base.changelog.withColumns({"change_type": F.lit("deleted"), "old_sig": F.lit("__stale__")}))
    assert rows(state.gc_plan(marked, scanned), "symbol_id", "action") == [("s1", "delete")]
    gone = state.cascade_delete(base, symbols=spark.createDataFrame([("s1",)], "id string"))
    assert gone.mappings.count() == 0 and gone.changelog.count() == 0
    assert {r.n for r in violations(gone).collect()} == {0}


def test_violations_are_found(base):
    bad = base.with_(mappings=base.mappings.unionByName(base.mappings).withColumn("doc_id", F.lit("nowhere")))
    found = {(r.relation, r.rule): r.n for r in violations(bad).collect() if r.n}
    assert found == {("mappings", "primary key"): 2, ("mappings", "doc_id"): 6}


def test_link_outcomes_and_free_review(spark, base):
    commands = spark.createDataFrame([("s1", "d1", "describes", "rejected"), ("x", "d1", "describes", "auto"), ("s1", "x", "describes", "auto"), ("x", "x", "describes", "auto"), ("s1", "d1", "is", "auto")], "symbol_id string, doc_id string, rel_type string, review_status string")
    assert sorted(r.outcome for r in state.link_validate(base, commands).collect()) == ["invalid rel_type", "ok", "section not found", "symbol and section not found", "symbol not found"]
    assert ("s1", "d1", "rejected") in rows(state.set_review(base, commands.limit(1)), "symbol_id", "doc_id", "review_status")


def test_unlink(spark, base):
    sections, mappings = state.unlink_stale(base, spark.createDataFrame([("src/auth.ts",)], "file string"))
    assert rows(sections, "id", "status") == [("d1", "stale"), ("d2", "stale"), ("d3", "stale")]
    assert rows(mappings, "doc_id", "review_status") == [("d1", "auto"), ("d2", "auto"), ("d3", "rejected")]


def test_reports(base):
    row = reports.status(base).first()
    assert (row.total_symbols, row.linked_symbols, row.coverage, row.sync_rate) == (2, 1, 50, 33)
    assert rows(reports.check_stale(base), "doc_id", "symbol_ids") == [("d2", "s1")]
    assert reports.check_summary(base, file="docs/x.md").first().passed
    assert not reports.check_summary(base, file="docs/auth.md", strict=True).first().passed
    assert rows(reports.review_unlinked(base), "id") == [("s2",)]


def test_ids(spark):
    df = spark.range(1).select(ids.symbol_id(F.lit(" TS "), F.lit("a::b"), F.lit("Function")).alias("a"), F.sha2(F.lit("ts:a::b:function"), 256).alias("b"), ids.doc_section_id(F.lit("x#y"), F.lit(" z\t")).alias("c"), F.sha2(F.lit("x%23y#z"), 256).alias("d"), ids.content_hash(F.lit(None).cast("string")).alias("e"), F.sha2(F.lit(""), 256).alias("f"))
    r = df.first()
    assert r.a == r.b and r.c == r.d and r.e == r.f


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("loginUser", "userLogin", True), ("get", "Getting Started", True), ("abc", "xyz", False), ("", "x", False), ("authenticate", "authorize", True), ("ab", "b a", False), ("parse", "sparse list", True)],
)
def test_fuzzy_match(spark, a, b, expected):
    assert spark.range(1).select(tx.fuzzy_match(F.lit(a), F.lit(b)).alias("x")).first().x is expected


def test_scoring_rules(spark):
    symbols = spark.createDataFrame([("1", "login", "src/auth.ts:1"), ("2", "getUser", "src/user.ts:1"), ("3", "zebra", "src/zebra.ts:2"), ("4", "do.it", "src/d.ts:1")], "symbol_id string, name string, location string")
    sections = spark.createDataFrame([("a", "docs/auth.md", "How to Login", "text"), ("b", "docs/x.md", "getUserProfile", "uses getUser here"), ("c", "docs/zebra.md", "Nothing", "plain"), ("d", "docs/y.md", "Then do.it now", "")], "doc_id string, file string, anchor string, content string")
    refs = spark.createDataFrame([("c", "login()", "backtick"), ("c", "zebra", "link")], "doc_id string, ref string, ref_type string")
    found = {(r.symbol_id, r.doc_id): r.confidence for r in linking.score_pairs(symbols, sections, refs).collect()}
    assert found == {("1", "a"): 1.0, ("2", "b"): 0.7, ("1", "c"): 0.9, ("4", "d"): 1.0}
    # A word in the heading links whatever the threshold; equal stems alone never do.
    first = {(r.symbol_id, r.doc_id) for r in linking.autolink_pass1(symbols, sections, refs).collect()}
    assert first == {("1", "a"), ("1", "c"), ("4", "d")}


def test_ambiguous_names_need_one_stem(spark):
    symbols = spark.createDataFrame([("1", "run", "src/a.ts:1"), ("2", "run", "src/b.ts:1"), ("3", "go", "src/c.ts:1")], "symbol_id string, name string, location string")
    sections = spark.createDataFrame([("x", "docs/a.md"), ("y", "docs/z.md")], "doc_id string, file string")
    refs = spark.createDataFrame([("x", "run()", "bodytext"), ("y", "run", "backtick"), ("y", "go", "link")], "doc_id string, ref string, ref_type string")
    assert rows(linking.ingest_links(symbols, sections, refs), "doc_id", "ref", "symbol_id") == [("x", "run()", "1"), ("y", "go", "3")]


def test_rewrites(spark):
    df = spark.createDataFrame([("a\r\nold(\r\n)\r\n",), ("old(\n) old(\n)",), ("none",)], "text string")
    out = rewrite.rewrite_signature(df, "text", F.lit("old(\n)"), F.lit("new(\n)"))
    assert rows(out, "text", "n_replaced") == [("a\r\nnew(\r\n)\r\n", 1), ("new(\n) new(\n)", 2), ("none", 0)]
    once = rewrite.rewrite_unique(df, "text", F.lit("old("), F.lit("x("))
    assert sorted(r.outcome for r in once.collect()) == ["ambiguous", "not found", "replaced"]
