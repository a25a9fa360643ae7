"""Queries of parsers and signature functions, over texts composed from the ``part`` table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signatures
from ..functions import text as tx
from ..model import State
from ..operators import reports, rewrite, state
from ..operators import sync as syncing
from ..sources import code, files, parsers, sinks
from .bindings import Bound, spread
from .queries import AS_OF, CHANGED, _changed, query

NL = "\n"


def _composed(b: Bound, extension: str, *parts: str) -> DataFrame:
    """(path, content): ``{n}`` stands for a part's name, ``{k}`` for its key, ``{z}`` for its size."""
    part = spread(b.table("part").select("p_name", "p_partkey", "p_size")).select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"), F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("z"))
    content: Column = F.lit(NL.join(parts))
    for mark in "nkz":
        content = F.replace(content, F.lit(f"{{{mark}}}"), F.col(mark))
    return part.select(F.concat(F.lit("docs/"), "k", F.lit(f".{extension}")).alias("path"), content.alias("content"), "n", "k", "z")


P = "(SELECT replace(p_name, ' ', '_') AS n, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS z FROM part) p"

MARKDOWN = ("Before part {k}.", "# The {n}", "Calls `{n}(a, (b))` and `{n}`.", "```sql", "# no heading", "run_{z}(1)", "```", "## Sub {k}", "See [use_{z}(y)](u) now.", "")


def _sections(files: DataFrame) -> DataFrame:
    return parsers.parse_documents(files).select("file", "anchor", F.length("content").cast("long").alias("n_chars"))


def _refs(files: DataFrame, *kinds: str) -> DataFrame:
    refs = parsers.references(parsers.parse_documents(files))
    return refs.filter(F.col("ref_type").isin(*kinds)).select("file", "anchor", "ref", "ref_type", "confidence", "line")


@query(f"""SELECT 'docs/' || k || '.md' AS file, '' AS anchor, len('Before part ' || k || '.') AS n_chars FROM {P}
UNION ALL SELECT 'docs/' || k || '.md', 'The ' || n, len('# The ' || n) + len('Calls `' || n || '(a, (b))` and `' || n || '`.') + len('run_' || z || '(1)') + len('```sql') + len('# no heading') + len('```') + 5 FROM {P}
UNION ALL SELECT 'docs/' || k || '.md', 'Sub ' || k, len('## Sub ' || k) + len('See [use_' || z || '(y)](u) now.') + 2 FROM {P}""")
def md_sections(b: Bound) -> DataFrame:
    return _sections(_composed(b, "md", *MARKDOWN))


@query(f"""SELECT 'docs/' || k || '.md' AS file, 'The ' || n AS anchor, n || '(a, (b))' AS ref, 'backtick' AS ref_type, 0.85::DOUBLE AS confidence, 3 AS line FROM {P}
UNION ALL SELECT 'docs/' || k || '.md', 'The ' || n, n, 'backtick', 0.6::DOUBLE, 3 FROM {P}""")
def refs_backtick(b: Bound) -> DataFrame:
    return _refs(_composed(b, "md", *MARKDOWN), "backtick")


@query(f"SELECT 'docs/' || k || '.md' AS file, 'The ' || n AS anchor, 'run_' || z || '(1)' AS ref, 'codeblock' AS ref_type, 0.9::DOUBLE AS confidence, 6 AS line FROM {P}")
def refs_codeblock(b: Bound) -> DataFrame:
    return _refs(_composed(b, "md", *MARKDOWN), "codeblock")


@query(f"SELECT 'docs/' || k || '.md' AS file, 'Sub ' || k AS anchor, 'use_' || z || '(y)' AS ref, 'link' AS ref_type, 0.5::DOUBLE AS confidence, 9 AS line FROM {P}")
def refs_link(b: Bound) -> DataFrame:
    return _refs(_composed(b, "md", *MARKDOWN), "link")


RST = ("Title {n}", "=========", "Uses :func:`go_{z}` here.", "", ".. code::", "", "   call_{z}(1)", "", "Next {k}", "--------", "End.", "")


@query(f"""SELECT 'docs/' || k || '.rst' AS file, 'Title ' || n AS anchor, 3 AS n_refs FROM {P} UNION ALL SELECT 'docs/' || k || '.rst', 'Next ' || k, 0 FROM {P}""")
def rst_sections(b: Bound) -> DataFrame:
    sections = parsers.parse_documents(_composed(b, "rst", *RST))
    return sections.select("file", "anchor", F.size(F.filter("codeRefs", lambda r: r["refType"] != "bodytext")).alias("n_refs"))


ASCIIDOC = ("= No section title", "== Part {n}", "See xref:part_{z}[it].", "----", "make_{k}(2)", "----", "=== More {k}", "Text.", "")


@query(f"""SELECT 'docs/' || k || '.adoc' AS file, '' AS anchor, 0 AS n_refs FROM {P} UNION ALL SELECT 'docs/' || k || '.adoc', 'Part ' || n, 2 FROM {P}
UNION ALL SELECT 'docs/' || k || '.adoc', 'More ' || k, 0 FROM {P}""")
def adoc_sections(b: Bound) -> DataFrame:
    sections = parsers.parse_documents(_composed(b, "adoc", *ASCIIDOC))
    return sections.select("file", "anchor", F.size(F.filter("codeRefs", lambda r: r["refType"] != "bodytext")).alias("n_refs"))


HTML = ("<h1>Part {n}</h1>", "<p><code>{n}(1)</code> and <a href='x'>see_{z}(2)</a></p>", "<pre>do_{k}(3)</pre>", "")


@query(f"""SELECT 'docs/' || k || '.html' AS file, 'Part ' || n AS anchor, n || '(1)' AS ref, 'backtick' AS ref_type, 0.85::DOUBLE AS confidence, 2 AS line FROM {P}
UNION ALL SELECT 'docs/' || k || '.html', 'Part ' || n, n, 'backtick', 0.6::DOUBLE, 2 FROM {P}
UNION ALL SELECT 'docs/' || k || '.html', 'Part ' || n, 'see_' || z || '(2)', 'link', 0.5::DOUBLE, 2 FROM {P}
UNION ALL SELECT 'docs/' || k || '.html', 'Part ' || n, 'do_' || k || '(3)', 'codeblock', 0.9::DOUBLE, 3 FROM {P}""")
def html_refs(b: Bound) -> DataFrame:
    return _refs(_composed(b, "html", *HTML), "backtick", "link", "codeblock")


@query(f"""SELECT k, '# The ' || n || chr(10) || 'Calls `' || n || '(a, (b))` and `' || n || '`.' || chr(10) || '```sql' || chr(10) || '# no heading' || chr(10) || 'run_' || z || '(1)' || chr(10) || '```' || chr(10)
|| '## Sub ' || k || chr(10) || 'See [use_' || z || '(y)](u) now.' || chr(10) AS section FROM {P}""")
def section_locate(b: Bound) -> DataFrame:
    files = _composed(b, "md", *MARKDOWN).withColumn("anchor", F.concat(F.lit("The "), F.col("n")))
    return parsers.located(files, "content", "anchor").select("k", "section")


CODE = ("/**", " * Makes {n}.", " */", "export async function make_{n}(", "  size: number = {z},", "  names: Map<string, number>,", "): Promise<void> {", "}", "export const LIMIT_{k} = {z};", "")


@query(f"""SELECT 'docs/' || k || '.ts' AS file, 'make_' || n AS name, 'function' AS kind, 4 AS line, 'export async function make_' || n || '( size: number = ' || z || ', names: Map<string, number>, ): Promise<void> {{' AS signature, 'Makes ' || n || '.' AS docstring FROM {P}
UNION ALL SELECT 'docs/' || k || '.ts', 'LIMIT_' || k, 'variable', 9, 'export const LIMIT_' || k || ' = ' || z || ';', NULL FROM {P}""".replace("{{", "{"))
def signature_fold(b: Bound) -> DataFrame:
    return code.extract_symbols(_composed(b, "ts", *CODE)).select("file", "name", "kind", "line", "signature", "docstring")


@query(f"""SELECT k, 'size: number, names_' || k || ': Map<string, number>' AS params, 'Promise<' || n || '>' AS returns FROM {P}""")
def signature_params(b: Bound) -> DataFrame:
    part = _composed(b, "ts", "async make(size: number = {z}, names_{k}: Map<string, number>): Promise<{n}> {")
    listed = F.array_join(F.transform(signatures.signature_params("content"), lambda p: F.concat_ws(": ", p["name"], p["type"])), ", ")
    return part.select("k", listed.alias("params"), signatures.signature_return("content").alias("returns"))


@query(f"""SELECT k, 'Makes ' || n || '.' || chr(10) || '@param {{number}} size how much ' || z || chr(10) || '@param {{string}} name' || chr(10) || '@returns {{boolean}} whether' AS docstring FROM {P}""".replace("{{", "{").replace("}}", "}"))
def docstring_regen(b: Bound) -> DataFrame:
    old = _composed(b, "ts", "Makes {n}.", "@param {number} size how much {z}", "@param {string} gone no more", "@returns {boolean} whether")
    new = F.lit("function make(size: number, name: string): boolean {")
    return old.select("k", signatures.docstring_regen(F.col("content"), new, F.lit("typescript")).alias("docstring"))


# ---- documentation and signatures of the other languages ---------------------------

PYTHON = ("import os", "", "class Box_{k}:", "    size = {z}", "", "    async def make_{n}(self, a: int = {z}) -> str:", '        """Makes {n}.', "", "        Twice.", '        """', "        return a", "")
GO = ("// Make builds {n}.", "// It never fails.", "func (b *Box) Make_{k}(a int, b string) error {", "}", "type Box_{k} struct {", "}", "")
RUST = ("/// Makes {n}.", "#[inline]", "pub fn make_{k}(a: i32) -> Result<A, B> {", "}", "pub trait Shape_{k} {", "}", "")


def _extracted(b: Bound, extension: str, lines: tuple[str, ...]) -> DataFrame:
    return code.extract_symbols(_composed(b, extension, *lines)).select("file", "name", "kind", "line", "signature", "docstring", "language")


@query(f"""SELECT 'docs/' || k || '.py' AS file, 'Box_' || k AS name, 'class' AS kind, 3 AS line, 'class Box_' || k || ': size = ' || z || ' async def make_' || n || '(self, a: int = ' || z || ') -> str: """ + '\"\"\"' + f"""Makes ' || n || '. Twice. """ + '\"\"\"' + f""" return a' AS signature, NULL AS docstring, 'python' AS language FROM {P}
UNION ALL SELECT 'docs/' || k || '.py', 'make_' || n, 'function', 6, 'async def make_' || n || '(self, a: int = ' || z || ') -> str: """ + '\"\"\"' + f"""Makes ' || n || '. Twice. """ + '\"\"\"' + f""" return a', 'Makes ' || n || '.' || chr(10) || chr(10) || '        Twice.', 'python' FROM {P}""")
def symbols_python(b: Bound) -> DataFrame:
    return _extracted(b, "py", PYTHON)


@query(f"""SELECT 'docs/' || k || '.go' AS file, 'Make_' || k AS name, 'function' AS kind, 3 AS line, 'func (b *Box) Make_' || k || '(a int, b string) error {{' AS signature, 'Make builds ' || n || '.' || chr(10) || 'It never fails.' AS docstring, 'go' AS language FROM {P}
UNION ALL SELECT 'docs/' || k || '.go', 'Box_' || k, 'class', 5, 'type Box_' || k || ' struct {{', NULL, 'go' FROM {P}""".replace("{{", "{"))
def symbols_go(b: Bound) -> DataFrame:
    return _extracted(b, "go", GO)


@query(f"""SELECT 'docs/' || k || '.rs' AS file, 'make_' || k AS name, 'function' AS kind, 3 AS line, 'pub fn make_' || k || '(a: i32) -> Result<A, B> {{' AS signature, 'Makes ' || n || '.' AS docstring, 'rust' AS language FROM {P}
UNION ALL SELECT 'docs/' || k || '.rs', 'Shape_' || k, 'interface', 5, 'pub trait Shape_' || k || ' {{', NULL, 'rust' FROM {P}""".replace("{{", "{"))
def symbols_rust(b: Bound) -> DataFrame:
    return _extracted(b, "rs", RUST)


OVERLOADED = ("/* function make_{n}(old) {", "*/", "const text = 'function make_{n}(x) {';", "function make_{n}(a: string): void;", "function make_{n}(", "  a: string,", "): void", "{", "}", "class C {", "  async run_{k}<T>(x: T): Promise<T> {", "  }", "}", "")


@query(f"""SELECT k, 'function make_' || n || '(' || chr(10) || '  a: string,' || chr(10) || '): void' AS made, 'async run_' || k || '<T>(x: T): Promise<T> {{' AS run, NULL AS missing FROM {P}""".replace("{{", "{"))
def current_signatures(b: Bound) -> DataFrame:
    texts, current = _composed(b, "ts", *OVERLOADED), signatures.signature_udf()
    of = lambda name: current("content", name, F.lit(1), "path")
    return texts.select("k", of(F.concat(F.lit("make_"), "n")).alias("made"), of(F.concat(F.lit("run_"), "k")).alias("run"), of(F.lit("none")).alias("missing"))


@query(f"""SELECT k, 'Makes ' || n || '.' || chr(10) || chr(10) || '        Twice.' AS docstring FROM {P}""")
def docstring_python(b: Bound) -> DataFrame:
    return _composed(b, "py", *PYTHON).select("k", signatures.signature_udf("docstring")("content", F.concat(F.lit("make_"), "n"), F.lit(1), "path").alias("docstring"))


@query(f"""SELECT k, 'x = ' || chr(39) || repeat(' ', 5 + len(n)) || chr(39) || repeat(' ', 9 + len(z)) AS code FROM {P}""")
def stripped_code(b: Bound) -> DataFrame:
    texts = _composed(b, "ts", "x = 'say: {n}'// size {z}!")
    return texts.select("k", signatures.stripped("content").alias("code"))


@query(f"""SELECT k, CAST(z AS INTEGER) % 2 = 0 AS bare FROM {P}""")
def bare_types(b: Bound) -> DataFrame:
    texts = _composed(b, "ts", "Map<string, A_{k}>")
    return texts.select("k", signatures.bare_type(F.when(F.col("z").cast("int") % 2 == 0, F.col("content")).otherwise(F.concat(F.col("content"), F.lit(" = 1;")))).alias("bare"))


# ---- names, lines, versions, paths --------------------------------------------------


@query(f"""SELECT k, contains(n, '_') AS snake, TRUE AS camel, FALSE AS plain FROM {P}""")
def code_like(b: Bound) -> DataFrame:
    part = _composed(b, "md", "")
    return part.select("k", tx.is_code_like(F.col("n")).alias("snake"), tx.is_code_like(F.concat(F.lit("getPart"), "k")).alias("camel"), tx.is_code_like(F.lit("word")).alias("plain"))


@query(f"""SELECT k, n || chr(10) || z || chr(10) AS content FROM {P}""")
def doc_lines(b: Bound) -> DataFrame:
    return _composed(b, "md", "{n} \t\r", "{z}  ", "").select("k", tx.normalize_doc_lines("content").alias("content"))


@query(f"""SELECT k, CAST(z AS INTEGER) > 9 OR (CAST(z AS INTEGER) = 9 AND CAST(k AS BIGINT) > 5) AS newer FROM {P}""")
def version_newer(b: Bound) -> DataFrame:
    return _composed(b, "md", "").select("k", tx.is_newer(F.lit("1.9.5-rc1"), F.concat(F.lit("1."), "z", F.lit("."), "k")).alias("newer"))


@query(f"""SELECT k, CASE WHEN CAST(z AS INTEGER) % 3 = 0 THEN 1 ELSE 3 END AS depth FROM {P}""")
def json_depths(b: Bound) -> DataFrame:
    text = F.when(F.col("z").cast("int") % 3 == 0, F.concat(F.lit('{"a": "[['), "n", F.lit('"}'))).otherwise(F.concat(F.lit('{"a": [{"b": '), "z", F.lit("}]}")))
    return _composed(b, "md", "").select("k", tx.json_depth(text).alias("depth"))


WALKED = ("src/{n}.ts", "src/.cache/{k}.ts", "node_modules/{n}/i.js", "docs/{k}.md", "lib/{n}.PY", ".hidden.ts", "src/{k}.txt")


@query(f"""WITH f AS (SELECT k, unnest(['src/' || n || '.ts', 'src/.cache/' || k || '.ts', 'node_modules/' || n || '/i.js', 'docs/' || k || '.md', 'lib/' || n || '.PY', '.hidden.ts', 'src/' || k || '.txt']) AS path FROM {P})
SELECT k, path, path LIKE 'src/%.ts' AND path NOT LIKE '%.cache%' OR path LIKE 'lib/%' AS is_code, path LIKE 'docs/%' AS is_doc FROM f""")
def file_walk(b: Bound) -> DataFrame:
    paths = _composed(b, "md", *WALKED).select("k", F.explode(F.split("content", NL)).alias("path"))
    return paths.select("k", "path", files.walk(F.col("path"), list(code.LANGUAGES)).alias("is_code"), files.walk(F.col("path"), list(parsers.FORMATS)).alias("is_doc"))


# ---- texts of an external index ------------------------------------------------------

LISTING = ("## class `Box_{k}` (src/box.ts)", "- `Box_{k}` in src/box.ts:{z}", "- run_{k} (method): src/run.ts:7", "mentions Box_{k}, none")


@query(f"""SELECT k, 'Box_' || k AS name, 'class' AS kind, 'src/box.ts' AS file, CAST(z AS INTEGER) AS line FROM {P}
UNION ALL SELECT k, 'run_' || k, 'method', 'src/run.ts', 7 FROM {P}""")
def index_listing(b: Bound) -> DataFrame:
    return code.index_rows(_composed(b, "txt", *LISTING), "content").select("k", "name", "kind", "file", "line")


def _index_lines(b: Bound, *lines: str) -> DataFrame:
    return _composed(b, "txt", *lines).select("k", F.posexplode(F.split("content", NL)).alias("pos", "text"))


@query(f"""SELECT 'make_' || n AS name, 'function' AS kind, 'src/a.ts' AS file, 'calls' AS relation FROM {P} UNION ALL SELECT 'Box_' || k, 'class', 'src/b.ts', 'depends_on' FROM {P}""")
def index_impact(b: Bound) -> DataFrame:
    return code.impact_rows(_index_lines(b, "- make_{n} (function) [calls] in src/a.ts:{z}", "- Box_{k} (class) src/b.ts:1", "nothing at all"))


@query(f"""SELECT 'Box_' || k AS name, 'class' AS kind, 'src/b.ts' AS file, CAST(z AS INTEGER) AS line FROM {P}""")
def index_search(b: Bound) -> DataFrame:
    return code.search_rows(_index_lines(b, "Box_{k} (class) in src/b.ts:{z}", "Box_{k} elsewhere"))


@query("SELECT 'function go(' || max(p_partkey) || ')' AS text FROM part")
def symbol_definition(b: Bound) -> DataFrame:
    lines = _composed(b, "ts", "function go({k})").select(F.col("content").alias("text"), F.col("k").cast("long").alias("pos"))
    return code.last_definition(lines, "go")


# ---- references in headings, repeated references, sections as a review finds them ----


@query(f"""SELECT 'docs/' || k || '.md' AS file, 'Use `' || n || '` and go_' || k || '(a)' AS anchor, n AS ref, 'heading' AS ref_type, 0.7::DOUBLE AS confidence, 1 AS line FROM {P}
UNION ALL SELECT 'docs/' || k || '.md', 'Use `' || n || '` and go_' || k || '(a)', 'go_' || k || '(a)', 'heading', 0.5::DOUBLE, 1 FROM {P}""")
def refs_heading(b: Bound) -> DataFrame:
    return _refs(_composed(b, "md", "# Use `{n}` and go_{k}(a)", ""), "heading")


@query(f"""SELECT 'docs/' || k || '.md' AS file, 'A' AS anchor, n AS ref, 'backtick' AS ref_type, 0.6::DOUBLE AS confidence, 2 AS line FROM {P}""")
def refs_repeated(b: Bound) -> DataFrame:
    return _refs(_composed(b, "md", "# A", "`{n}` and `{n}`", "again `{n}`"), "backtick")


@query(f"""SELECT k, '## tHe ' || upper(n) || chr(10) || 'text' || chr(10) AS section FROM {P}""")
def section_review(b: Bound) -> DataFrame:
    texts = _composed(b, "md", "# First", "## tHe {N}", "text", "### next", "").withColumn("content", F.replace("content", F.lit("{N}"), F.upper("n")))
    return parsers.located(texts.withColumn("anchor", F.concat(F.lit("The "), F.col("n"))), "content", "anchor", review=True).select("k", "section")


# ---- state and reports that need a text or an order ---------------------------------


@query(f"SELECT s.key, s.value FROM (SELECT 'k' || p_partkey AS key, 'old' AS value FROM part WHERE p_partkey % 2 = 0) s WHERE s.key NOT IN (SELECT 'k' || p_partkey FROM part WHERE p_partkey % 3 = 0) UNION ALL SELECT 'k' || p_partkey, 'new' FROM part WHERE p_partkey % 3 = 0")
def metadata_upsert(b: Bound) -> DataFrame:
    key = b.table("part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), "p_partkey")
    rows = lambda which, *values: reduce(DataFrame.unionByName, [key.filter(which).select("key", F.lit(v).alias("value"), F.lit(t).cast("timestamp").alias("updated_at")) for v, t in values])
    return state.upsert_metadata(rows("p_partkey % 2 = 0", ("old", AS_OF)), rows("p_partkey % 3 = 0", ("first", "1999-01-01"), ("new", "1999-01-02"))).select("key", "value")


@query("SELECT id AS symbol_id, 'created' AS change_type, '' AS old_sig, signature AS new_sig, 'applied' AS sync_status FROM symbols")
def created_changes(b: Bound) -> DataFrame:
    return state.created_log(b.symbols, F.lit(AS_OF).cast("timestamp")).select("symbol_id", "change_type", "old_sig", "new_sig", "sync_status")


@query("""WITH g AS (SELECT id FROM symbols WHERE src_key % 4 > 0), l AS (SELECT DISTINCT symbol_id, doc_id FROM mappings WHERE review_status <> 'rejected')
SELECT g.id AS symbol_id, '__stale__' AS old_sig, '__stale__' AS new_sig, count(doc_id) AS n_affected, coalesce(string_agg(doc_id, ',' ORDER BY doc_id), '') AS affected, 'pending' AS sync_status FROM g LEFT JOIN l ON g.id = l.symbol_id GROUP BY g.id""")
def gc_marks(b: Bound) -> DataFrame:
    k = b.keyed
    links = b.named(k.mappings, symbol=None)  # the sections of a change are in the order of their ids
    marks = state.gc_log(k.state.with_(mappings=links), k.symbols.filter("src_key % 4 > 0").select(F.col("id").alias("symbol_id")), F.lit(AS_OF).cast("timestamp"))
    return b.named(marks, doc=None).select("symbol_id", "old_sig", "new_sig", F.size("affected_docs").cast("long").alias("n_affected"), F.array_join("affected_docs", ",").alias("affected"), "sync_status")


@query(f"""WITH gone AS (SELECT id FROM doc_sections WHERE src_key % 7 = 0)
SELECT 'section' AS what, id AS key FROM doc_sections WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'mapping', symbol_id || doc_id || rel_type FROM mappings WHERE doc_id NOT IN (SELECT id FROM gone) AND NOT (review_status = 'rejected' AND created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)""")
def cleanup_state(b: Bound) -> DataFrame:
    k = b.keyed
    unique = k.doc_sections.withColumn("file", F.concat("file", F.lit("#"), "anchor"))
    new = state.without_orphans(k.state.with_(doc_sections=unique), unique.filter("src_key % 7 <> 0"), AS_OF)
    sections, mappings = b.named(new.doc_sections.select("id"), symbol=None, doc="id"), b.named(new.mappings)
    return sections.select(F.lit("section").alias("what"), F.col("id").alias("key")).unionByName(mappings.select(F.lit("mapping").alias("what"), F.concat("symbol_id", "doc_id", "rel_type").alias("key")))


@query("SELECT id, project, name FROM symbols ORDER BY project, name, id LIMIT 100")
def symbols_page(b: Bound) -> DataFrame:
    return reports.symbols_filter(b.state, limit=100).select("id", "project", "name")


@query("SELECT id, file, anchor FROM doc_sections ORDER BY file, anchor, id LIMIT 100")
def sections_page(b: Bound) -> DataFrame:
    return reports.sections_filter(b.state, limit=100).select("id", "file", "anchor")


@query(f"""WITH d AS (SELECT DISTINCT doc_id FROM mappings m JOIN symbols s ON m.symbol_id = s.id WHERE {CHANGED}),
l AS (SELECT m.*, row_number() OVER (PARTITION BY doc_id ORDER BY symbol_id, rel_type) AS rk FROM mappings m JOIN symbols s ON m.symbol_id = s.id WHERE {CHANGED})
SELECT 1 AS rank, '### Changed files (2)' AS line UNION ALL SELECT 1, unnest(['- `src/brand_11.sql`', '- `src/brand_23.sql`'])
UNION ALL SELECT 2, '### Affected symbols (' || count(*) || ')' FROM symbols WHERE {CHANGED}
UNION ALL SELECT 2, '- `' || name || '` (' || kind || ') at ' || location FROM symbols WHERE {CHANGED}
UNION ALL SELECT 3, '### Affected documentation (' || count(*) || ')' FROM d
UNION ALL SELECT 3, '- `' || file || '#' || anchor || '`: **' || status || '** (' || rel_type || ')' FROM l JOIN doc_sections s ON l.doc_id = s.id WHERE rk = 1""")
def impact_report(b: Bound) -> DataFrame:
    changed = _changed(b)
    return sinks.impact_lines(changed, reports.impact_symbols(b.state, changed), reports.impact_docs(b.state, changed)).select("rank", "line")


@query("""WITH o AS (SELECT * FROM doc_sections WHERE id NOT IN (SELECT doc_id FROM mappings))
SELECT 3 AS rank, '### Orphaned sections (' || count(*) || ')' AS line FROM o UNION ALL SELECT 3, '- ' || file || '#' || anchor FROM o
UNION ALL SELECT 2, '### Unreviewed links (' || count(*) || ')' FROM mappings WHERE review_status = 'auto'
UNION ALL SELECT 2, '- `' || s.name || '` and ' || d.file || '#' || d.anchor || ' (' || rel_type || ')' FROM mappings m JOIN symbols s ON m.symbol_id = s.id JOIN doc_sections d ON m.doc_id = d.id WHERE review_status = 'auto'""")
def review_report(b: Bound) -> DataFrame:
    s = b.keyed.state
    lines = sinks.review_lines(reports.status(s), reports.review_grouped(s), reports.review_unreviewed(s), reports.review_orphaned(s))
    return lines.filter("rank > 1").select("rank", "line")


# ---- executing a sync over composed projects: a source and a document a part ----------

SOURCE = ("/**", " * Makes {n}.", " * @param {number} size how large", " */", "function make_{k}(size: number, more: string): void {", "}", "")
DOCUMENT = ("# Make {k}", "As in:", "```", "function make_{k}(size: number): void", "```", "# Other {k}", "function make_{k}(size: number): void", "")
ACTIONS = "CASE CAST(z AS INTEGER) % 4 WHEN 0 THEN 'inline' WHEN 1 THEN 'standalone' WHEN 2 THEN 'generated' ELSE 'architecture' END"


def _project(b: Bound) -> tuple[State, DataFrame, DataFrame]:
    sources = _composed(b, "ts", *SOURCE).withColumn("path", F.concat(F.lit("src/"), "k", F.lit(".ts")))
    documents = _composed(b, "md", *DOCUMENT).withColumn("modified", F.lit(AS_OF).cast("timestamp"))
    now = F.lit(AS_OF).cast("timestamp")
    size, new, old = F.col("z").cast("int") % 4, F.concat(F.lit("function make_"), "k", F.lit("(size: number, more: string): void {")), F.concat(F.lit("function make_"), "k", F.lit("(size: number): void {"))
    kind = F.when(size == 0, "inline").when(size == 1, "standalone").when(size == 2, "generated").otherwise("architecture")
    symbols = sources.select(F.concat(F.lit("s"), "k").alias("id"), F.concat(F.lit("make_"), "k").alias("name"), F.concat("path", F.lit(":5")).alias("location"), new.alias("raw_signature"))
    sections = documents.select(F.concat(F.lit("d"), "k").alias("id"), F.col("path").alias("file"), F.concat(F.lit("Make "), "k").alias("anchor"), F.lit("").alias("content_hash"), kind.alias("doc_type"), F.lit("stale").alias("status"), now.alias("created_at"), now.alias("updated_at"))
    mappings = sources.select(F.concat(F.lit("s"), "k").alias("symbol_id"), F.concat(F.lit("d"), "k").alias("doc_id"), F.lit("describes").alias("rel_type"), F.lit("auto").alias("review_status"))
    log = sources.select(F.col("k").cast("long").alias("id"), now.alias("timestamp"), F.concat(F.lit("s"), "k").alias("symbol_id"), F.lit("signature_changed").alias("change_type"), old.alias("old_sig"), new.alias("new_sig"), F.lit("pending").alias("sync_status"))
    return State(*(t.hint("merge") for t in (symbols, sections, mappings, log))), sources, documents


@query(f"""SELECT 'docs/' || k || '.md' AS path, '# Make ' || k || chr(10) || 'As in:' || chr(10) || '```' || chr(10) || 'function make_' || k || '(size: number, more: string): void' || chr(10) || '```' || chr(10)
|| '# Other ' || k || chr(10) || 'function make_' || k || '(size: number): void' || chr(10) AS content FROM {P} WHERE {ACTIONS} = 'standalone'
UNION ALL SELECT 'src/' || k || '.ts', '/**' || chr(10) || ' * Makes ' || n || '.' || chr(10) || ' * @param {{number}} size how large' || chr(10) || ' * @param {{string}} more' || chr(10) || ' */' || chr(10)
|| 'function make_' || k || '(size: number, more: string): void {{' || chr(10) || '}}' || chr(10) FROM {P} WHERE {ACTIONS} = 'inline'""".replace("{{", "{").replace("}}", "}"))
def sync_apply(b: Bound) -> DataFrame:
    project, sources, documents = _project(b)
    return syncing.sync_all(project, sources, documents, F.lit(AS_OF).cast("timestamp")).texts


@query(f"""SELECT 'd' || k AS key, {ACTIONS} AS what, CASE {ACTIONS} WHEN 'inline' THEN 'updated' WHEN 'standalone' THEN 'replaced' WHEN 'generated' THEN 'no generator' ELSE 'marked stale' END AS outcome,
CASE WHEN {ACTIONS} IN ('inline', 'standalone') THEN 'in_sync' ELSE 'stale' END AS status, CASE WHEN {ACTIONS} = 'generated' THEN 'failed' ELSE 'applied' END AS sync_status FROM {P}""")
def sync_all(b: Bound) -> DataFrame:
    project, sources, documents = _project(b)
    done = syncing.sync_all(project, sources, documents, F.lit(AS_OF).cast("timestamp"))
    sections = done.state.doc_sections.select(F.col("id").alias("key"), "status")
    changes = done.state.changelog.select("symbol_id", "sync_status")
    results = done.results.select("symbol_id", F.col("doc_id").alias("key"), F.col("doc_type").alias("what"), "outcome")
    return results.join(sections, "key").join(changes, "symbol_id").select("key", "what", "outcome", "status", "sync_status")


@query(f"""SELECT k, CASE WHEN CAST(z AS INTEGER) % 2 = 0 THEN 'generate:openapi' ELSE 'docs:build' END AS script FROM {P}""")
def generator_choice(b: Bound) -> DataFrame:
    part = _composed(b, "md", "")
    file = F.when(F.col("z").cast("int") % 2 == 0, F.concat(F.lit("api/openapi_"), "k", F.lit(".yaml"))).otherwise(F.col("path"))
    return part.select("k", rewrite.generator(file, F.array(F.lit("docs:build"), F.lit("generate:openapi")), F.lit("")).alias("script"))


@query(f"""SELECT k, CASE CAST(z AS INTEGER) % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'no docstring' ELSE 'missing signature' END AS outcome FROM {P}""")
def inline_outcomes(b: Bound) -> DataFrame:
    texts = _composed(b, "ts", "/** Makes {n}. */", "function make_{k}(a: number): void {", "}", "")
    which = F.col("z").cast("int") % 3
    name = F.when(which == 1, "none").otherwise(F.concat(F.lit("make_"), "k"))
    old = F.when(which == 2, "function gone() {").otherwise(F.concat(F.lit("function make_"), "k", F.lit("(a: number): void {")))
    new = F.concat(F.lit("function make_"), "k", F.lit("(a: string): void {"))
    return texts.select("k", rewrite.inline_update("content", name, F.lit("typescript"), F.lit("Makes all."), old, new)["outcome"].alias("outcome"))
