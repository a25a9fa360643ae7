"""The tool surface: a workspace over a folder of snapshots, one method for each command."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import signatures
from .functions.ids import content_hash, doc_section_id
from .functions.text import kind_map, parse_location
from .model import DOC_TYPES, State
from .operators import linking, reports, state
from .operators import sync as syncing
from .sources import code, files, parsers, sinks
from .streaming import watch as watching

STRATEGIES = ("auto_update", "mark_stale", "prompt", "ignore")
#: What a configuration may ask for by section type.
ALLOWED = {"inline": ("auto_update", "mark_stale", "ignore"), "standalone": STRATEGIES, "generated": ("auto_update", "mark_stale", "ignore"), "architecture": ("mark_stale", "ignore")}


@dataclass
class Config:
    project: str = "default"
    code_dirs: list[str] = field(default_factory=lambda: ["src"])
    doc_dirs: list[str] = field(default_factory=lambda: ["docs"])
    strategies: dict[str, str] = field(default_factory=lambda: dict(state.DEFAULT_STRATEGIES))
    ignore: list[str] = field(default_factory=list)
    min_confidence: float = 0.5
    scripts: list[str] = field(default_factory=list)

    def issues(self) -> list[str]:
        out = [f"unknown section type {k}" for k in self.strategies if k not in DOC_TYPES]
        out += [f"unknown strategy {v}" for v in self.strategies.values() if v not in STRATEGIES]
        out += [f"{k} sections cannot be {v}" for k, v in self.strategies.items() if v in STRATEGIES and v not in ALLOWED.get(k, (v,))]
        out += ["no code folder"] * (not self.code_dirs) + ["no documentation folder"] * (not self.doc_dirs)
        return out + ["min_confidence is not within 0 and 1"] * (not 0 <= self.min_confidence <= 1)

    def shown(self) -> str:
        """The configuration as JSON."""
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def merged(cls, values: dict, project: str) -> Config:
        """Defaults under ``values``; strategies merge one by one; unknown keys are left out."""
        known = {f.name: values[f.name] for f in fields(cls) if values.get(f.name) is not None}
        out = cls(**{"project": project, **known})
        out.strategies = state.DEFAULT_STRATEGIES | dict(known.get("strategies", {}))
        return out


def load_config(spark: SparkSession, path: str, project: str) -> tuple[Config, list[str]]:
    """(configuration, what is wrong) from a YAML or JSON file that Spark can read.

    A missing file gives the defaults; one that cannot be read or breaks a rule gives them too, and
    says so, so that a bad value never half applies.
    """
    default = Config(project=project)
    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one configuration file
    except AnalysisException:
        return default, []
    try:
        values = json.loads(text) if text.lstrip().startswith("{") else _yaml(text)
    except ValueError as e:
        return default, [f"not readable: {e}"]
    if not isinstance(values, dict):
        return default, ["not a mapping"]
    wrong = [f"{k} is not a list of texts" for k in ("code_dirs", "doc_dirs", "ignore", "scripts") if k in values and not (isinstance(values[k], list) and all(isinstance(x, str) for x in values[k]))]
    if not isinstance(values.get("strategies") or {}, dict):
        wrong.append("strategies is not a mapping")
    config = default if wrong else Config.merged(values, project)
    wrong += config.issues()
    return (default if wrong else config), wrong


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        raise ValueError("this installation reads JSON only") from None
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from None


def _stale_inline(s: State, bare: DataFrame, now: Column) -> DataFrame:
    """Sections with the inline ones of symbols (symbol_id) that have no docstring any more marked stale."""
    inline = s.doc_sections.filter("doc_type = 'inline'").select(F.col("id").alias("doc_id"))
    held = s.mappings.join(inline, "doc_id", "left_semi").join(bare, "symbol_id", "left_semi")
    return state.mark_stale(s.with_(mappings=held), bare, now)


class Workspace:
    """Reads the current snapshot, derives the next one, and switches to it."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: Config | None = None, extractor: code.SymbolExtractor | None = None):
        self.spark, self.root, self.store, self.config = spark, root, store, config or Config()
        self.extractor = extractor or code.RuleExtractor()

    @property
    def state(self) -> State:
        return sinks.read_snapshot(self.spark, self.store)

    def _read(self, reader, folders: list[str], since: str | None = None) -> DataFrame:
        tables = []
        for folder in folders:
            found = reader(self.spark, f"{self.root}/{folder}", rules=self.config.ignore, since=since)
            tables.append(found.withColumn("path", F.concat(F.lit(f"{folder}/"), F.col("path"))))
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def scanned_symbols(self, since: str | None = None) -> DataFrame:
        """Extracted symbols with their ids, ready for ``scan_diff``."""
        found = state.symbol_dedup(self.extractor.extract(self.code_files(since)))
        named = state.symbol_ids(found, F.col("language"))
        return named.select(
            "id", "name", kind_map(F.col("kind")).alias("kind"), F.lit(self.config.project).alias("project"), F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("location"),
            content_hash(F.col("signature")).alias("signature"), F.col("signature").alias("raw_signature"), "docstring",
        )

    def code_files(self, since: str | None = None) -> DataFrame:
        return self._read(files.read_code, self.config.code_dirs, since)

    def doc_files(self) -> DataFrame:
        return self._read(files.read_docs, self.config.doc_dirs)

    def parsed_sections(self) -> DataFrame:
        """Sections of all documents with doc_id; of several of one anchor the last in its file."""
        parsed = parsers.parse_documents(self.doc_files()).withColumn("doc_id", doc_section_id(F.col("file"), F.col("anchor")))
        last = parsed.groupBy("doc_id").agg(F.max_by(F.struct("file", "anchor", "content", "codeRefs"), "position").alias("s"))
        return last.select("doc_id", "s.*")

    def scan(self, as_of: str, since: str | None = None, dry_run: bool = False) -> DataFrame:
        """Rescans code and documentation, links, stores the next state; gives (change, n) counts.

        What is extracted is written once, as the diff, the upserts, the links and the log all read it.
        Rows that do not change keep their stamps.  With ``since`` only files modified later are read,
        and only their symbols can be missing.
        """
        old, now = self.state, F.lit(as_of).cast("timestamp")
        symbols = sinks.written(self.scanned_symbols(since), self.store)
        before = old.symbols
        if since is not None:
            read = self.code_files(since).select(F.col("path").alias("_file"))
            before = before.join(read, parse_location(F.col("location"))[0] == F.col("_file"), "left_semi")
        diff = sinks.written(state.scan_diff(before, symbols), self.store)
        if dry_run:
            return diff.groupBy("change").agg(F.count("*").alias("n"))
        written = symbols.join(diff.filter(F.col("change").isin("created", "signature_changed")), "id").drop("docstring", "change")
        changed = diff.filter("change = 'signature_changed'").select(F.col("id").alias("symbol_id"))
        new_symbols = state.upsert_symbols(old.symbols, written.withColumns({"metadata": F.lit("{}"), "created_at": now, "updated_at": now}))

        sections = sinks.written(self.parsed_sections(), self.store)
        batch = sections.select(F.col("doc_id").alias("id"), "file", "anchor", content_hash(F.col("content")).alias("content_hash"), F.lit("standalone").alias("doc_type"))
        inline, inline_links, bare = self._inline(symbols, old)
        batch = batch.unionByName(inline.select("id", "file", "anchor", "content_hash", F.lit("inline").alias("doc_type"))).withColumns({"status": F.lit("in_sync"), "created_at": now, "updated_at": now})
        # A section whose text is as it was keeps its row, so that updated_at tells when it changed.
        same = old.doc_sections.select(F.col("id").alias("_i"), F.col("content_hash").alias("_h"), F.col("doc_type").alias("_t"))
        batch = batch.join(same, (F.col("id") == F.col("_i")) & (F.col("content_hash") == F.col("_h")) & (F.col("doc_type") == F.col("_t")), "left_anti")
        marked = old.with_(doc_sections=state.mark_stale(old, changed, now))
        marked = marked.with_(doc_sections=_stale_inline(marked, bare, now))
        new_sections = state.upsert_sections(marked.doc_sections, batch)

        refs = sections.select("doc_id", F.inline("codeRefs")).select("doc_id", F.col("symbolName").alias("ref"), F.col("refType").alias("ref_type"))
        named = sinks.written(new_symbols.select(F.col("id").alias("symbol_id"), "name", "location"), self.store)
        ingested = linking.ingest_links(named, sections, refs).select("symbol_id", "doc_id", F.lit("references").alias("rel_type"))
        linked = linking.autolink(named, sections, refs, old.mappings, self.config.min_confidence).select("symbol_id", "doc_id", F.lit("describes").alias("rel_type"))
        links = ingested.unionByName(linked).unionByName(inline_links).withColumns({"review_status": F.lit("auto"), "created_at": now})
        mappings = state.insert_absent(old.mappings, links)

        cascade = state.change_cascade(old, changed).join(symbols.select(F.col("id").alias("symbol_id"), "raw_signature"), "symbol_id")
        cascade = cascade.join(old.symbols.select(F.col("id").alias("symbol_id"), F.col("raw_signature").alias("old_sig")), "symbol_id", "left")
        log = state.created_log(symbols.join(diff.filter("change = 'created'"), "id"), now).unionByName(
            cascade.select(now.alias("timestamp"), "symbol_id", F.lit("signature_changed").alias("change_type"), "old_sig", F.col("raw_signature").alias("new_sig"), state.listed(F.col("affected_docs")).alias("affected_docs"), "sync_status")
        )
        changelog = old.changelog.unionByName(state.numbered(log, old.changelog))
        stamp = self.spark.createDataFrame([("last_scan_at", as_of)], "key string, value string").withColumn("updated_at", now)
        self._store(State(new_symbols, new_sections, mappings, changelog, state.upsert_metadata(old.metadata, stamp)))
        return diff.groupBy("change").agg(F.count("*").alias("n"))

    def _inline(self, symbols: DataFrame, old: State) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(sections from docstrings, their links, symbols that lost theirs), all empty if inline sections are ignored."""
        found = state.inline_sections(symbols.select("id", "name", "docstring"), old)
        if self.config.strategies.get("inline") == "ignore":
            found = found.filter("false")
        file, line = parse_location(F.col("location"))
        placed = found.join(symbols.select(F.col("id").alias("symbol_id"), file.alias("file"), line.alias("line")), "symbol_id")
        placed = placed.withColumn("id", doc_section_id(F.col("file"), F.col("anchor")))
        written = placed.filter("action = 'upsert'")
        # Several definitions of one name in a file share a section; the last one's text stands.
        sections = written.groupBy("id", "file", "anchor").agg(F.max_by("content_hash", F.struct("line", "symbol_id")).alias("content_hash"))
        links = written.select("symbol_id", F.col("id").alias("doc_id"), F.lit("describes").alias("rel_type"))
        return sections, links, placed.filter("action = 'mark_stale'").select("symbol_id")

    # Read-only commands.
    def status(self) -> DataFrame:
        return reports.status(self.state)

    def check(self, file: str | None = None, strict: bool = False) -> DataFrame:
        return reports.check_summary(self.state, file, strict)

    def impact(self, paths: list[str]) -> DataFrame:
        return reports.impact_docs(self.state, self.spark.createDataFrame([(p,) for p in paths], "file string"))

    def diff(self, latest: int = 10) -> DataFrame:
        return reports.diff_history(self.state, latest)

    def review(self) -> DataFrame:
        return reports.review_summary(self.state)

    def review_implied(self) -> DataFrame:
        """(symbol_id, doc_id) that a document's text names but no link holds."""
        s = self.state
        return linking.review_implied(s.symbols.select(F.col("id").alias("symbol_id"), "name", "location"), self.parsed_sections(), s.mappings)

    def review_snippets(self) -> DataFrame:
        """(symbol_id, symbol_name, doc_file, doc_anchor, source, section): both sides of each link to review."""
        s = self.state
        file, line = parse_location(F.col("location"))
        placed = s.symbols.select(F.col("id").alias("symbol_id"), file.alias("src"), line.alias("line"))
        code_text = self.code_files().select(F.col("path").alias("src"), F.col("content").alias("code"))
        doc_text = self.doc_files().select(F.col("path").alias("doc_file"), F.col("content").alias("text"))
        met = reports.review_unreviewed(s).join(placed, "symbol_id", "left").join(code_text, "src", "left").join(doc_text, "doc_file", "left")
        shown = met.withColumn("source", signatures.signature_udf()("code", "symbol_name", "line", "src"))
        return parsers.located(shown, "text", "doc_anchor", review=True).select("symbol_id", "symbol_name", "doc_file", "doc_anchor", "source", "section")

    def render_impact(self, paths: list[str]) -> str:
        s, changed = self.state, self.spark.createDataFrame([(p,) for p in paths], "file string")
        return sinks.render_lines(sinks.impact_lines(changed, reports.impact_symbols(s, changed), reports.impact_docs(s, changed)))

    def render_diff(self, symbol_id: str) -> str:
        s, one = self.state, F.col("symbol_id") == symbol_id
        symbol = s.symbols.filter(F.col("id") == symbol_id)
        return sinks.render_lines(sinks.diff_lines(symbol, s.changelog.filter(one), reports.diff_docs(s.with_(mappings=s.mappings.filter(one)))))

    def render_review(self) -> str:
        s = self.state
        return sinks.render_lines(sinks.review_lines(reports.status(s), reports.review_grouped(s.with_(symbols=s.symbols.join(reports.review_unlinked(s).select("id"), "id", "left_semi"))), reports.review_unreviewed(s), reports.review_orphaned(s)))

    def annotate_commit(self, message: str) -> str:
        """The message with a line of pending changes and stale sections, if there are any."""
        row = reports.commit_annotation(self.state).first()  # one row
        return f"{message.rstrip()}\n\nDocs: {row.pending_changes} pending change(s), {row.stale_docs} stale section(s)\n" if row.annotate else message

    def gate(self, staged: list[str] | None = None) -> bool:
        """Whether a push (or, with staged files, a commit) may go on."""
        if staged is None:
            return reports.gate_prepush(self.state).first().passed
        return reports.gate_precommit(self.state, self.spark.createDataFrame([(p,) for p in staged], "file string")).isEmpty()

    def health(self, as_of: str) -> DataFrame:
        s = self.state
        last = s.metadata.filter("key = 'last_scan_at'").select("value").first()
        return reports.health(s, as_of, last[0] if last else None)

    def export_mappings(self, folder: str) -> None:
        sinks.export_json(reports.export_mappings(self.state), folder)

    # Commands that store a next state.
    def _store(self, new: State) -> str:
        return sinks.write_snapshot(new, self.store)

    def set_links(self, commands: DataFrame) -> DataFrame:
        """Links, confirmations and rejections: valid ones are stored, outcomes are given back."""
        s = self.state
        outcome = state.link_validate(s, commands)
        good = outcome.filter("outcome = 'ok'")
        added = state.insert_absent(s.mappings, good.withColumn("created_at", F.current_timestamp()))
        self._store(s.with_(mappings=state.set_review(s.with_(mappings=added), good).select(*s.mappings.columns)))
        return outcome

    def bulk_review(self, to: str) -> str:
        s = self.state
        return self._store(s.with_(mappings=state.bulk_review(s.mappings, to)))

    def gc(self, scanned: DataFrame, as_of: str | None = None, dry_run: bool = False) -> DataFrame:
        """Deletes what ``gc_plan`` deletes; marks the rest and their sections; gives (action, n)."""
        s = self.state
        plan = sinks.written(state.gc_plan(s, scanned), self.store)
        counts = plan.groupBy("action").agg(F.count("*").alias("n"))
        if dry_run:
            return counts
        doomed = plan.filter("action = 'delete'").select(F.col("symbol_id").alias("id"))
        marks = plan.filter("action = 'mark'").select("symbol_id")
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        stale = s.with_(doc_sections=state.mark_stale(s, marks, now))
        log = state.numbered(state.gc_log(s, marks, now), s.changelog)
        self._store(state.cascade_delete(stale.with_(changelog=s.changelog.unionByName(log)), symbols=doomed))
        return counts

    def cleanup(self, as_of: str) -> DataFrame:
        """Removes sections whose files are gone and old rejected links; gives their numbers."""
        s, here = self.state, sinks.written(self.doc_files().select(F.col("path").alias("file")).unionByName(self.code_files().select(F.col("path").alias("file"))), self.store)
        counts = sinks.written(state.cleanup_orphans(s, here, as_of), self.store)
        self._store(state.without_orphans(s, here, as_of))
        return counts

    def sync_plan(self) -> DataFrame:
        s = self.state
        return state.sync_plan(s, reports.stale_symbols(s), self.config.strategies)

    def sync(self, as_of: str, symbol_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(results, changed texts) of syncing some symbols, or all of stale sections; the next state is stored.

        Files are not written: the caller puts the texts where they belong.
        """
        s, now = self.state, F.lit(as_of).cast("timestamp")
        chosen = reports.stale_symbols(s) if symbol_ids is None else self.spark.createDataFrame([(i,) for i in symbol_ids], "symbol_id string")
        done = syncing.sync(s, chosen, self.code_files(), self.doc_files(), now, self.config.strategies, tuple(self.config.scripts))
        results, texts = sinks.written(done.results, self.store), sinks.written(done.texts, self.store)
        self._store(done.state)
        return results, texts

    def sync_all(self, as_of: str) -> tuple[DataFrame, DataFrame]:
        return self.sync(as_of)

    # Watching.
    def refresh(self, as_of: str) -> DataFrame:
        """An incremental scan of what was modified since the last one (a whole scan if there was none)."""
        last = self.state.metadata.filter("key = 'last_scan_at'").select("value").first()
        return self.scan(as_of, since=last[0] if last else None)

    def watch(self, events: DataFrame, checkpoint: str, **trigger):
        """Starts the two streams of a watch: debounced refreshes, and removals at once."""
        key = watching.debounce_key(F.col("path"), self.config.doc_dirs)
        refresh = watching.start_debounce(events, key, lambda batch, _: None if batch.isEmpty() else self.refresh(str(batch.agg(F.max("end")).first()[0])), f"{checkpoint}/debounce", **trigger)

        def store(sections: DataFrame, mappings: DataFrame) -> None:
            self._store(self.state.with_(doc_sections=sections, mappings=mappings))

        return refresh, watching.start_unlinks(events, lambda: self.state, store, f"{checkpoint}/unlink", **trigger)

    def watch_status(self, events: DataFrame) -> DataFrame:
        return watching.watch_status(events, watching.debounce_key(F.col("path"), self.config.doc_dirs))

    def backup(self, to: str) -> str:
        return sinks.backup(self.spark, self.store, to)

    def restore(self, saved: str) -> str:
        return sinks.restore(self.spark, saved, self.store)

    def reset(self) -> bool:
        return sinks.reset(self.spark, self.store)
