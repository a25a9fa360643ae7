"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, fixity, language_id, license_scan, line_dedup, minhash, mixing, quality, secret_scan
from .common import materialize, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_documents(table(spark, sf_dir, "documents"))


ORACLE["op6_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = line_dedup.drop_boilerplate(docs)
    return cut.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


ORACLE["op8_line_dedup"] = f"""
WITH p AS (SELECT doc_id, source, text, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, source, text, i, lines[i] AS line FROM p, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS bare FROM l),
n AS (SELECT source, bare, count(DISTINCT md5(coalesce(text, '-'))) AS n FROM k WHERE bare <> '' GROUP BY ALL),
t AS (SELECT source, count(DISTINCT md5(coalesce(text, '-'))) AS total FROM p GROUP BY ALL),
b AS (SELECT n.source, n.bare FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
      WHERE n.n >= {line_dedup.MIN_PAGES} AND n.n > {line_dedup.MAX_SHARE} * t.total)
SELECT k.doc_id, k.source, CASE WHEN any_value(k.text) IS NULL THEN 0 ELSE count(*) END AS n_lines,
  CASE WHEN any_value(k.text) IS NULL THEN 0 ELSE count(b.bare) END AS n_dropped,
  CASE WHEN any_value(k.text) IS NOT NULL
    THEN sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE b.bare IS NULL), '')) END AS text_sha256
FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.bare = b.bare
GROUP BY k.r, k.doc_id, k.source
"""


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    # Texts are read once; the narrow sizes are what the passes of the mix read.
    return mixing.mix(materialize(docs), "size").select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op10_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
             sha256('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS s FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, rk % 3 + 1 AS w, 3 * s AS cap FROM r),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb, sum(s) OVER () AS t, sum(w) OVER () AS wt
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(cap AS DOUBLE) * CAST(wt - wb AS DOUBLE) <= CAST(w AS DOUBLE) * CAST(t - cb AS DOUBLE) AS is_full FROM c),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS cf, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS wf FROM f),
q AS (SELECT source, s, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
        ELSE CAST(w AS DOUBLE) * CAST(t - cf AS DOUBLE) / CAST(wt - wf AS DOUBLE) END AS target FROM g),
p AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // CAST(s AS BIGINT) ELSE 0 END AS whole FROM q),
u AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * CAST(s AS BIGINT) AS rest FROM p),
x AS (SELECT d.doc_id, d.size, u.s, u.target, u.whole, u.rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
  CAST(whole * size + greatest(0, least(size, rest - b)) AS BIGINT) AS taken FROM x
"""


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE["op9_decontaminate"] = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT item, w, least(8, len(w)) AS m FROM i WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[a:a + m - 1], ' ') AS win FROM v, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS a)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, l.m, a, array_to_string(w[a:a + l.m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM bw) l,
        LATERAL (SELECT unnest(range(1, len(w) - l.m + 2)) AS a)),
h AS (SELECT DISTINCT r, a, dw.m, item FROM dw JOIN bw USING (win, m)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, LATERAL (SELECT unnest(range(a, a + m)) AS p) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op2_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    classifier = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality(docs, classifier)


@query
def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity.audit(pages, fixity.faulty_replica(pages))


ORACLE["op3_warc_fixity"] = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substring(sha256(coalesce(url, '')), 1, 2) AS mark FROM pages),
r AS (SELECT *, CASE WHEN mark = '00' THEN html || '~' ELSE html END AS html2 FROM p),
w AS (SELECT page_id, mark,
  concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
    'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS rec,
  concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
    'Content-Length: ', strlen(html2), chr(13), chr(10), chr(13), chr(10), html2, chr(13), chr(10), chr(13), chr(10)) AS rec2 FROM r)
SELECT page_id, page_id // 1024 AS volume, CAST(1 AS BIGINT) AS n_records, strlen(rec) AS n_bytes,
  CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  sha256(rec) AS digest, CASE WHEN mark <> 'ff' THEN sha256(rec2) END AS replica_digest,
  CASE WHEN mark = 'ff' THEN 'missing' WHEN mark = '00' THEN 'corrupt' ELSE 'ok' END AS status
FROM w
"""


@query
def op1_minhash_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
