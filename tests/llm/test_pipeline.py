"""The pipeline's stages: their decisions, awkward rows, clashing columns, empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline as p

NAMES = [n for n, _ in p.STAGES]


def test_order():
    assert NAMES == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_columns_stay(name, spark, clashing, edge_dir):
    out = dict(p.STAGES)[name](spark, clashing, edge_dir)
    if name != "mixing":
        assert out.columns == clashing.columns
        assert {r.score for r in out.select("score").distinct().collect()} == {"held"}
    assert out.count() > 50


@pytest.mark.parametrize("name", NAMES)
def test_empty(name, spark, empty_dir):
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    assert dict(p.STAGES)[name](spark, docs, empty_dir).count() == 0


def test_decisions(spark, edge_docs, edge_dir):
    total = edge_docs.count()
    known = p.known_language(spark, edge_docs, edge_dir)
    assert total - known.count() == sum(not any(c.isalpha() for c in r.text or "") for r in edge_docs.collect()) + 0
    lines = p.site_lines(spark, edge_docs, edge_dir)
    assert lines.count() == total and not lines.filter("text LIKE 'Home | About%' AND source = 's1'").count()
    assert not lines.filter("n_chars <> length(text)").count()
    near = p.near_copies(spark, edge_docs, edge_dir)
    kept = [r.doc_id for r in near.filter("source = 'hot'").collect()]
    assert kept == [72]
    assert near.filter("doc_id = 5").count() == 1
    clean = p.clean_of_benchmark(spark, edge_docs, edge_dir)
    gone = {r.doc_id for r in edge_docs.collect()} - {r.doc_id for r in clean.collect()}
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    bench = [r.text.lower() for r in spark.read.parquet(f"{edge_dir}/benchmark.parquet").collect() if r.text]
    assert all(sum(b in texts[d].lower() for b in bench) >= 2 or texts[d].lower() in " ".join(bench) for d in gone)
    assert clean.filter("text = 'so  it is'").count() == 1
    mixed = p.mixed(spark, edge_docs, edge_dir)
    assert mixed.columns == [*edge_docs.columns, "size", "source_size", "target", "taken"]
    assert not mixed.filter("taken <= 0").count()


def test_run(spark, edge_dir):
    docs = p.run(spark, edge_dir)
    assert docs.count() > 30
    assert docs.groupBy("doc_id").count().filter("count > 1 AND doc_id <> 7").count() == 0


def test_near_copies_drop_texts_not_ids(spark, edge_dir):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(3, a, "s"), (7, f"{a} more", "s"), (7, b, "s"), (7, b, "s"), (9, b.upper(), "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text) for r in p.near_copies(spark, docs, edge_dir).collect()) == [(3, a), (7, b)]
