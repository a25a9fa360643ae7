from __future__ import annotations

from docweave.api import Config, Workspace
from docweave.model import violations
from docweave.operators import reports
from docweave.sources import sinks


def test_scan_change_review_and_restore(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "docs").mkdir()
    (tmp_path / "src/auth.ts").write_text("/** Signs in. */\nexport function login(user: string): void {\n}\n")
    (tmp_path / "docs/api.md").write_text("# Login\nCall `login` first.\n# Other\nnothing\n")
    work = Workspace(spark, str(tmp_path), str(tmp_path / "store"), Config(ignore=["*.tmp"]))
    assert {r.change: r.n for r in work.scan("2024-01-01 00:00:00").collect()} == {"created": 1}
    first = sinks.current(spark, work.store)
    s = work.state
    assert {r.n for r in violations(s).collect()} == {0}
    # Ingest (references) and auto-link (describes) of the same section, and the docstring's own section.
    assert sorted((r.rel_type, r.doc_type) for r in s.mappings.join(s.doc_sections, s.mappings.doc_id == s.doc_sections.id).collect()) == [("describes", "inline"), ("describes", "standalone"), ("references", "standalone")]
    assert {r.change: r.n for r in work.scan("2024-01-01 01:00:00").collect()} == {"unchanged": 1}
    assert work.state.changelog.count() == 1
    assert work.check().first().passed
    (tmp_path / "src/auth.ts").write_text("/** Signs in. */\nexport function login(user: string, pin: number): void {\n}\n")
    assert {r.change: r.n for r in work.scan("2024-01-02 00:00:00").collect()} == {"signature_changed": 1}
    assert not work.check().first().passed
    assert sorted((r.anchor, r.relationship) for r in work.impact(["src/auth.ts"]).collect()) == [("Login", "describes"), ("inline:login", "describes")]
    # Links that were there before keep the time of their making, sections that did not change theirs.
    assert {str(r.created_at) for r in work.state.mappings.collect()} == {"2024-01-01 00:00:00"}
    assert {r.anchor: str(r.updated_at)[:10] for r in work.state.doc_sections.collect()} == {"Login": "2024-01-02", "Other": "2024-01-01", "inline:login": "2024-01-02"}
    assert "- `docs/api.md#Login`: **stale** (describes)" in work.render_impact(["src/auth.ts"])
    assert "Symbols: 1 of 1 linked" in work.render_review() and "(describes)" in work.render_review()
    (symbol,) = [r.id for r in work.state.symbols.collect()]
    assert "| signature_changed |" in work.render_diff(symbol)
    assert work.annotate_commit("Change\n") == "Change\n\nDocs: 1 pending change(s), 2 stale section(s)\n"
    assert not work.gate() and not work.gate(["docs/api.md"]) and work.gate(["other.md"])
    snippet = next(r for r in work.review_snippets().collect() if r.doc_anchor == "Login")
    assert snippet.source.startswith("export function login(") and snippet.section.startswith("# Login")
    assert "Login" in sinks.render_check(reports.check_stale(work.state)) and "::warning file=docs/api.md" in sinks.render_check(reports.check_stale(work.state), "ci")
    work.bulk_review("confirmed")
    assert {r.review_status for r in work.state.mappings.collect()} == {"confirmed"}
    assert {r["name"]: r.status for r in work.health("2024-01-02 02:00:00").collect()}["last_scan"] == "ok"
    saved = work.backup(str(tmp_path / "saved"))
    work.restore(first)
    assert work.check().first().passed
    work.restore(saved)
    assert not work.check().first().passed
    assert [tuple(r) for r in work.gc(spark.createDataFrame([], "id string"), dry_run=True).collect()] == [("mark", 1)]
    work.gc(spark.createDataFrame([], "id string"), "2024-01-03 00:00:00")
    (mark,) = work.state.changelog.filter("change_type = 'deleted'").collect()
    assert (mark.old_sig, mark.new_sig, len(mark.affected_docs)) == ("__stale__", "__stale__", 2)
    work.gc(spark.createDataFrame([], "id string"))
    assert work.state.symbols.count() == 0 and work.state.mappings.count() == 0
    assert work.reset()


def test_config_issues():
    assert Config().issues() == []
    assert len(Config(code_dirs=[], strategies={"odd": "never"}, min_confidence=2).issues()) == 4


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)


def test_sync_rewrites_sections_and_docstrings(spark, tmp_path):
    doc = "# Add\nCall it as:\n```\nfunction add(a: number): number\n```\n# Else\nfunction add(a: number): number\n"
    write(tmp_path, src__a_DOT_ts="/**\n * Adds.\n * @param {number} a first\n */\nfunction add(a: number): number {\n}\n", docs__a_DOT_md=doc)
    work = Workspace(spark, str(tmp_path), str(tmp_path / "store"))
    work.scan("2024-01-01 00:00:00")
    write(tmp_path, src__a_DOT_ts="/**\n * Adds.\n * @param {number} a first\n */\nfunction add(a: number, b: number): number {\n}\n")
    work.scan("2024-01-02 00:00:00")
    assert {r.anchor for r in work.state.doc_sections.filter("status = 'stale'").collect()} >= {"Add", "inline:add"}
    results, texts = work.sync_all("2024-01-03 00:00:00")
    assert {(r.action, r.outcome, r.ok) for r in results.collect()} >= {("replace_signature", "replaced", True), ("update_inline", "updated", True)}
    text = {r.path: r.content for r in texts.collect()}
    assert text["docs/a.md"].startswith(doc.split("# Else")[0].replace("a: number)", "a: number, b: number)"))
    assert " * @param {number} a first\n * @param {number} b\n" in text["src/a.ts"]
    assert work.state.doc_sections.filter("status = 'stale'").count() == 0
    assert work.state.changelog.filter("sync_status = 'pending'").count() == 0


def test_lost_docstrings_removed_files_and_old_rejections(spark, tmp_path):
    write(tmp_path, src__a_DOT_py='def add(a):\n    """Adds."""\n', docs__a_DOT_md="# Add\n`add`\n", docs__b_DOT_md="# Other\nadd\n")
    work = Workspace(spark, str(tmp_path), str(tmp_path / "store"))
    work.scan("2024-01-01 00:00:00")
    first = work.state.mappings.filter("rel_type = 'references'").first()
    work.set_links(spark.createDataFrame([(first.symbol_id, first.doc_id, "references", "rejected")], "symbol_id string, doc_id string, rel_type string, review_status string"))
    write(tmp_path, src__a_DOT_py="def add(a):\n    return a\n")
    (tmp_path / "docs/b.md").unlink()
    work.scan("2024-03-01 00:00:00")
    sections = {r.anchor: r.status for r in work.state.doc_sections.collect()}
    assert sections["inline:add"] == "stale" and sections["Other"] == "in_sync"
    assert work.cleanup("2024-03-02 00:00:00").first().asDict() == {"removed_sections": 1, "cascaded_mappings": 0, "purged_rejected": 1}
    s = work.state
    assert "Other" not in {r.anchor for r in s.doc_sections.collect()} and s.mappings.filter("review_status = 'rejected'").count() == 0
    assert {r.n for r in violations(s).collect()} == {0}


def test_incremental_scan_misses_nothing(spark, tmp_path):
    import os

    write(tmp_path, src__a_DOT_ts="function one() {\n}\n", src__b_DOT_ts="function two() {\n}\n", docs__a_DOT_md="# x\n")
    work = Workspace(spark, str(tmp_path), str(tmp_path / "store"))
    work.scan("2024-01-01 00:00:00")
    for name, at in (("a", 1_600_000_000), ("b", 1_800_000_000)):
        os.utime(tmp_path / f"src/{name}.ts", (at, at))
    assert {r.change: r.n for r in work.refresh("2024-01-02 00:00:00").collect()} == {"unchanged": 1}


def test_configuration_file(spark, tmp_path):
    from docweave.api import load_config

    (tmp_path / "c.yaml").write_text("code_dirs: [lib]\nstrategies:\n  inline: mark_stale\nextra: 1\n")
    config, wrong = load_config(spark, str(tmp_path / "c.yaml"), "p")
    assert not wrong and config.code_dirs == ["lib"] and config.project == "p"
    assert config.strategies == {"inline": "mark_stale", "standalone": "auto_update", "generated": "auto_update", "architecture": "mark_stale"}
    assert '"project": "p"' in config.shown()
    (tmp_path / "d.json").write_text('{"strategies": {"architecture": "auto_update"}}')
    config, wrong = load_config(spark, str(tmp_path / "d.json"), "p")
    assert config == Config(project="p") and wrong == ["architecture sections cannot be auto_update"]
    assert load_config(spark, str(tmp_path / "none"), "p") == (Config(project="p"), [])
