"""All queries on tables of awkward rows and on empty tables, against DuckDB where SQL can say it."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import queries as llm
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(edge_dir):
    return connect_some(edge_dir)


def connect_some(folder):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_awkward_rows(name, spark, edge_dir, con):
    assert assert_same(llm.QUERIES[name](spark, edge_dir), con, llm.ORACLE[name]) > 100


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_empty_tables(name, spark, empty_dir):
    assert llm.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_generated_tables(name, spark, sf_dir):
    assert_same(llm.QUERIES[name](spark, sf_dir), connect(sf_dir), llm.ORACLE[name])


# ---- brute force ------------------------------------------------------------------


def near_components(rows, k, percent=80):
    """Rows are nodes, so that a repeated doc_id with another text stands by that text alone."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                up[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i, len(s), least[find(n)], least[find(n)] == i) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def documents(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(words, spark, edge_docs):
    from docweave.llm import minhash

    docs = edge_docs.filter("doc_id IS NOT NULL")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, words=words, block=4).collect())
    want = near_components(documents(docs), words)
    assert got == want
    assert sum(not w[3] for w in want) > 10


def test_another_text_under_a_known_id(spark):
    from docweave.llm import minhash

    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(3, a), (7, f"{a} more"), (7, b), (9, b.upper()), (3, a)], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == [(3, 56, 3, True), (3, 56, 3, True), (7, 56, 7, True), (7, 57, 3, False), (9, 56, 7, False)]


@pytest.mark.parametrize("block", [3, 512])
def test_large_groups_are_linked_whole(block, spark):
    """A trunk that its center connects, chains that only comparisons outside the stars find, and strangers."""
    import random

    from docweave.llm import minhash

    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):  # edits in one place: all near each other
        words = list(base)
        words[r.randrange(120)] = f"e{i}"
        rows.append((100 + i, " ".join(words)))
    words = list(base)
    for i in range(30):  # a chain that moves away step by step
        words[(i * 4) % 120] = f"c{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[: 40 + i]) + f" x{i} " * 50) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(x) for x in minhash.near_duplicates(docs, words=3, block=block).collect())
    assert got == near_components(rows, 3)


def test_sketches_rule_out_no_link():
    """Sets at the threshold agree in far more values than is asked for; strangers in far fewer."""
    import numpy as np

    from docweave.llm import minhash

    r = np.random.Generator(np.random.PCG64(3))
    for n in (64, 90, 900, 9000):
        shared = r.integers(0, 1 << 64, (60, n), dtype=np.uint64)
        other = r.integers(0, 1 << 64, (60, n), dtype=np.uint64)
        own = n // 9  # of each side: 8 of 10 shingles of the union are shared
        sides = [np.concatenate([shared[:, own:], other[:, k * own : (k + 1) * own]], axis=1) for k in (0, 1)]
        a, b, c = (minhash.sketches(s.ravel(), np.arange(61) * s.shape[1]) for s in (*sides, other))
        assert minhash.agreement(a, b).min() > minhash.MIN_AGREE
        assert minhash.agreement(a, c).max() < minhash.MIN_AGREE
    empty = minhash.sketches(np.arange(3, dtype=np.uint64), np.array([0, 0, 3, 3]))
    assert empty.shape == (3, minhash.BANDS * minhash.PERMUTATIONS) and not empty[[0, 2]].any()


def test_partners_of_a_group():
    import numpy as np

    from docweave.llm import minhash

    r = np.random.Generator(np.random.PCG64(4))
    marks = r.integers(0, 256, (6, minhash.BANDS * minhash.PERMUTATIONS), dtype=np.uint8)
    marks[1] = marks[0]
    m, own = np.array([100, 101, 100, 100, 10, 9]), np.array([0, 1, 0, 1, 0, 1])
    found = lambda components, across: sorted(minhash._group_partners(m, own, np.array(components), marks, across, 80))
    assert found([b"a", b"b", b"c", b"d", b"e", b"f"], False) == [0, 1, 4, 5]  # small sets by size alone
    assert found([b"a", b"a", b"c", b"d", b"e", b"e"], False) == []
    own[:2] = 0
    assert found([b"a", b"b", b"c", b"d", b"e", b"f"], True) == [4, 5]
    assert found([b"a", b"b", b"c", b"d", b"e", b"f"], False) == [0, 1, 4, 5]


def test_near_duplicates_keeps_all_rows(spark, edge_docs):
    from docweave.llm import minhash

    rows = minhash.near_duplicates(edge_docs, words=4).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_generated_near_duplicates(spark, sf_dir):
    got = sorted(tuple(r) for r in llm.op1_minhash_minmax(spark, sf_dir).collect())
    assert got == near_components(documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), 4)


def test_licences_by_brute_force(spark, edge_dir, edge_docs):
    from docweave.llm.license_scan import BASE_PHRASES

    texts = dict.fromkeys(documents(edge_docs))
    got = {}
    for r in llm.op5_license_scan(spark, edge_dir).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in texts:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        places = [(i, label) for p, label in BASE_PHRASES for i in range(len(words)) if [w.decode() for w in words[i : i + len(p.split())] if w.isascii()] == p.split()]
        want = (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[doc]]
    labels = {r.labels for rows in got.values() for r in rows}
    assert {"", "cc-by,cc-by-nc", "gpl", "mit", "reserved"} <= labels
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for rows in got.values() for r in rows)


def test_every_notice_of_a_text_is_found(spark):
    from docweave.llm.license_scan import TEMPLATES, scan

    notices = [n for _, n, _ in TEMPLATES]
    vocabulary = " ".join(sorted({w for n in notices for w in n.split()}))
    texts = [f"{a}. {b}" for a in notices for b in notices] + ["\n".join(notices), *(f"{vocabulary} x {k}" for _, _, k in TEMPLATES), *(f"the under released {k} of" for _, _, k in TEMPLATES)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan(docs.repartition(4)).collect():
        words = re.findall("[a-z0-9]+", r.text.lower())
        want, scores = set(filter(None, r.base_labels.split(","))), [0.0]
        for label, notice, key in TEMPLATES:
            parts, k = notice.split(), key.split()
            at = next(i for i in range(len(parts)) if parts[i : i + len(k)] == k)
            for i in range(len(words)):
                if words[i : i + len(k)] == k:
                    want.add(label)
                    scores.append(sum(0 <= i - at + j < len(words) and words[i - at + j] == w for j, w in enumerate(parts)) / len(parts))
        assert r.labels == ",".join(sorted(want)), r.text
        assert r.score == (1.0 if r.base_labels else pytest.approx(max(scores)))


def test_secrets_by_brute_force(spark, edge_dir, edge_docs):
    from docweave.llm import secret_scan as s

    got = {(r.doc_id, r.spans): r for r in llm.op7_secret_scan(spark, edge_dir).collect()}
    by_doc = {}
    for (doc, _), r in got.items():
        by_doc.setdefault(doc, []).append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
    for doc, text in documents(edge_docs):
        text = text or ""
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in s.ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        want = (*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(",".join(f[2] for f in sorted(found)).encode()).hexdigest())
        assert want in by_doc[doc]
    planted = [r.spans for r in got.values() if "markov" in r.spans]
    assert planted == ["markov:4:28"]


def test_markov_models_tell_keys_from_names(spark, edge_docs):
    import random

    from docweave.llm import secret_scan as s

    models = s.train(edge_docs)
    keys = s.random_samples(seed=99, each=40)
    names = ["get_user_account_by_name", "the_quick_brown_fox_with_lazy", "calculateMonthlyTotalPrice", "AbstractDocumentVisitorHouse"]
    assert sum(models.score(k) > s.MIN_RATIO for k in keys) > 0.9 * len(keys)
    assert not any(models.is_secret(n) for n in names)
    assert not models.is_secret("".join(random.Random(1).choices("abcdefgh", k=12)))


def test_language_is_learned_and_unknown_is_told(spark, edge_dir, edge_docs):
    truth = {r.doc_id: r for r in edge_docs.filter("doc_id < 60").collect() if r.text and r.doc_id != 7}
    rows = llm.op4_language_id(spark, edge_dir).collect()
    right = [r.lang_pred == truth[r.doc_id].lang for r in rows if r.doc_id in truth]
    assert sum(right) >= 0.95 * len(right)
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {r.doc_id for r in edge_docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == edge_docs.count()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in llm.op4_language_id(spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows) > 100
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_quality_on_held_out_labels(spark):
    from docweave.llm import quality

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = quality.train(docs, labels.filter("crc32(cast(doc_id AS string)) % 4 <> 2"))
    truth = {r.doc_id: r.quality for r in labels.filter("crc32(cast(doc_id AS string)) % 4 = 2").collect()}
    rows = quality.quality(docs.select("doc_id", "source", "lang", "text"), seen).collect()
    right = [r.keep == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert len(right) > 50 and sum(right) >= 0.95 * len(right)


def brute_posteriors(rows):
    """(host, path) -> posteriors, in plain Python, from (host, path, p)."""
    from collections import defaultdict

    def strength(groups, mean):
        n, k = sum(len(g) for g in groups.values()), len(groups)
        inner = sum(sum(p * p for p in g) - sum(g) ** 2 / len(g) for g in groups.values())
        outer = sum(len(g) * (sum(g) / len(g) - mean[key]) ** 2 for key, g in groups.items())
        c = n - sum(len(g) ** 2 for g in groups.values()) / n
        within = inner / max(n - k, 1)
        between = (outer - (k - 1) * within) / max(c, 1.0)
        return min(max(within / max(between, 1e-9), 1.0), 1e6)

    hosts, paths = defaultdict(list), defaultdict(list)
    for host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    mean = sum(p for *_, p in rows) / len(rows)
    kappa = strength(hosts, dict.fromkeys(hosts, mean))
    host_posterior = {h: (kappa * mean + sum(g)) / (kappa + len(g)) for h, g in hosts.items()}
    kappa = strength(paths, {k: host_posterior[k[0]] for k in paths})
    return {k: (host_posterior[k[0]], (kappa * host_posterior[k[0]] + sum(g)) / (kappa + len(g))) for k, g in paths.items()}


def test_posteriors_by_brute_force_and_shrinkage(spark):
    import random

    from docweave.llm import quality

    r = random.Random(6)
    rows = [(h, p, min(1.0, max(0.0, r.gauss(0.2 + 0.06 * int(h[1:]) + 0.1 * (p == "a"), 0.1)))) for h in (f"h{i}" for i in range(8)) for p in ("a", "b", None) for _ in range(r.randint(1, 60))]
    rows += [(None, "a", 0.9), ("sparse", "a", 0.99), *(("dense", "a", 0.99) for _ in range(300))]
    got = {(x.host, x.path): x for x in quality.posteriors(spark.createDataFrame(rows, "s string, l string, p_doc double").repartition(4), "s", "l").collect()}
    want = brute_posteriors(rows)
    assert set(got) == set(want)
    for key, (host, path) in want.items():
        assert got[key].host_posterior == pytest.approx(host, rel=1e-6) and got[key].path_posterior == pytest.approx(path, rel=1e-6)
    mean = sum(p for *_, p in rows) / len(rows)
    assert mean < got["sparse", "a"].path_posterior < got["dense", "a"].path_posterior < 0.99


def test_quality_of_awkward_rows(spark, edge_dir, clashing):
    from docweave.llm import quality

    labels = spark.read.parquet(f"{edge_dir}/labels.parquet")
    rows = quality.quality(clashing, quality.train(clashing, labels)).collect()
    assert len(rows) == clashing.count() and all(0 <= r.score <= 1 and r._h == r._m == "held" for r in rows)
    assert {r.keep for r in rows} <= {True, False}


def test_hosts_and_paths_of_urls(spark):
    from docweave.llm.quality import host_of, path_of

    urls = ["https://A.org:80/en/x/y.html?q=/z", "http://u@b.net", "c.de/x", None, "ftp://d.io/f.txt"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(host_of(df.u), path_of(df.u), path_of(df.u, 2)).collect()]
    assert got == [("a.org", "/en/", "/en/x/"), ("b.net", "/", "/"), (None, None, None), (None, None, None), ("d.io", "/", "/")]


def test_fixity_finds_planted_faults(spark):
    from docweave.llm import fixity

    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 9)) for i in range(3000)] + [(5, "again", "y"), (None, "n", None)], "page_id long, url string, html string")
    other = pages.filter("page_id <> 77 OR page_id IS NULL").replace({"u2999": "changed"}, subset=["url"]).union(spark.createDataFrame([(99_999, "new", "z")], pages.schema))
    found = {r.page_id: r.status for r in fixity.audit(pages, other).collect()}
    assert {k: v for k, v in found.items() if v != "ok"} == {77: "missing", 2999: "corrupt", 99_999: "extra"}
    assert len(found) == 3002
    assert {r.status for r in fixity.audit(pages, pages).collect()} == {"ok"}


def test_fixity_of_ids_far_apart_and_clashing_columns(spark):
    from docweave.llm import fixity

    top = 1 << 60
    rows = [(top + 3 * i, f"u{i}", "b" * (i % 7)) for i in range(300)] + [(-top, "low", None), (-1, "x", "y"), (1025, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("held") for n in ("id", "volume", "offset", "digest", "node", "bad", "shelf", "status")})
    other = pages.filter(F.col("page_id") != top + 30).withColumn("html", F.when(F.col("page_id") == -top, "changed").otherwise(F.col("html")))
    found = fixity.audit(pages, other).collect()
    assert {r.page_id: r.status for r in found if r.status != "ok"} == {top + 30: "missing", -top: "corrupt"}
    # Offsets are those of the records written one after the other, volume by volume.
    at: dict[int, int] = {}
    for r in sorted(found, key=lambda r: r.page_id):
        assert r.volume == r.page_id >> 10 and r.offset == at.get(r.volume, 0)
        at[r.volume] = r.offset + r.n_bytes


def test_trees_vouch_for_order_and_extent(spark):
    """A volume's digest changes with any record, and only the branch above a changed record does."""
    from docweave.llm import fixity

    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 5)) for i in range(3000)], "page_id long, url string, html string")
    one, two = ({r.volume: r for r in fixity.trees(fixity.leaves(t)).collect()} for t in (pages, pages.filter("page_id <> 1100")))
    assert [v for v in one if one[v].digest != two[v].digest] == [1]
    assert [a.of.node for a, b in zip(one[1].nodes, two[1].nodes, strict=True) if a.of.digest != b.of.digest] == [1100 >> 5]
    for row in one.values():
        assert [n.start for n in row.nodes[1:]] == [n.stop for n in row.nodes[:-1]] and row.nodes[-1].stop == row.n_bytes
        assert all(n.of.leaves[-1].stop == n.stop - n.start for n in row.nodes)


def test_mix_meets_targets(spark, edge_docs):
    from docweave.llm import mixing

    sized = edge_docs.withColumn("size", mixing.word_count(edge_docs.text))
    rows = mixing.mix(sized, "size").collect()
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source.setdefault(r.source, []).append(r)
    for group in by_source.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 0.5
        assert sum(r["size"] for r in group) == group[0].source_size
        assert group[0].target <= 3 * group[0].source_size + 1e-6
    again = mixing.mix(sized.repartition(7), "size").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("name", ["licences", "copies", "secrets", "lines", "fixity"])
def test_clashing_columns(name, spark, clashing):
    """Extra columns stay as they are, unless the operator adds one of that name."""
    from docweave.llm import exact_dedup, fixity, license_scan, line_dedup, secret_scan

    if name == "fixity":
        out = fixity.audit(clashing, clashing, "doc_id", "source", "text")
        assert {r.status for r in out.collect()} == {"ok"}
        return
    if name == "copies":
        out = exact_dedup.exact_dedup(clashing.withColumn("d", exact_dedup.content_digest(F.col("text"))), "d")
    else:
        out = {"licences": license_scan.scan, "lines": line_dedup.drop_boilerplate, "secrets": lambda d: secret_scan.scan(d, secret_scan.train(d))}[name](clashing)
    assert {c.lower() for c in clashing.columns} <= {c.lower() for c in out.columns} and len(out.columns) == len(set(out.columns))
    assert {r.rest for r in out.select("rest").collect()} == {"held"} and out.count() == clashing.count()


def test_secret_scan_is_linear_in_a_text():
    import time

    from docweave.llm import secret_scan as s

    models = s.MarkovPair(*(__import__("numpy").zeros((s._EDGE + 1) ** 2) for _ in range(2)))
    text = " ".join(f"{'0123456789abcdef' * 2} name_of_a_long_identifier{i}" for i in range(20_000))
    start = time.perf_counter()
    base, added = s.find_spans(text, text.encode().lower(), models)
    assert len(base) == 20_000 and not added and time.perf_counter() - start < 20
    assert len(s.labelled_tokens(text)[0]) == 20_000


def test_ftrl_step_against_a_plain_loop():
    import numpy as np

    from docweave.llm import language_id as g

    r = np.random.default_rng(5)
    rows = [(np.sort(r.choice(40, 6, replace=False)), r.random(6), int(r.integers(3))) for _ in range(30)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(i, k):
        x = z.get((i, k), 0.0)
        return 0.0 if abs(x) <= l1 else (np.sign(x) * l1 - x) / ((beta + n.get((i, k), 0.0) ** 0.5) / alpha + l2)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(2):
        for row in order.permutation(len(rows)):
            features, values, label = rows[row]
            at = [*zip(features.tolist(), values.tolist()), (g.FEATURES, 1.0)]
            held = {(i, k): weight(i, k) for i, _ in at for k in range(3)}
            scores = [sum(held[i, k] * v for i, v in at) for k in range(3)]
            e = [np.exp(x - max(scores)) for x in scores]
            for i, v in at:
                for k in range(3):
                    step = (e[k] / sum(e) - (k == label)) * v
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + step - ((old + step * step) ** 0.5 - old**0.5) / alpha * held[i, k]
                    n[i, k] = old + step * step
    got = g.fit_ftrl(rows, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert all(got[i, k] == pytest.approx(weight(i, k), abs=1e-9) for i in [*range(40), g.FEATURES] for k in range(3))


def test_index_reuses_rows_and_hands_on():
    from docweave.llm import exact_dedup as e

    index, key = e.CuckooIndex(2), hashlib.sha256(b"x").digest()
    for i in range(5_000):
        index.merge(key, i, 1)
    assert len(index.keys) == 1 and list(index.items()) == [(key, 4_999, 5_000)]


def test_copies_in_small_partitions(spark, monkeypatch):
    from docweave.llm import exact_dedup as e

    monkeypatch.setattr(e, "FOLD_KEYS", 3)
    monkeypatch.setattr(e, "PARTITION_ROWS", 10)
    docs = spark.createDataFrame([(i, f"t{i % 37}" if i % 3 else "hot") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in e.dedup_documents(docs).collect()}
    groups: dict[str, list[int]] = {}
    for i in range(300):
        groups.setdefault(f"t{i % 37}" if i % 3 else "hot", []).append(i)
    assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_slices_follow_the_rows(spark):
    from docweave.llm import mixing

    assert [mixing.slice_digits(n) for n in (0, 1, 50_000, 300_000, 50_000_000_000)] == [2, 2, 2, 3, 5]


def test_lines_of_small_hosts(spark):
    from docweave.llm import line_dedup

    docs = spark.createDataFrame([(1, "a", "menu\none"), (2, "a", " MENU \ntwo\n\ntwo"), (3, "b", "alone\nlines"), (4, None, "menu\nx"), (5, None, "menu\ny")], "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got == {1: ("one", 2, 1), 2: ("two\n\ntwo", 4, 1), 3: ("alone\nlines", 2, 0), 4: ("x", 2, 1), 5: ("y", 2, 1)}


def test_cuckoo_index():
    from docweave.llm.exact_dedup import CuckooIndex

    index = CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.merge(k, i, 1)
    assert index.live == 5000 and index.resizes > 5
    assert all(index.find(k) >= 0 for k in keys)
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.find(k) >= 0 for k in keys[:4]] == [False, True, False, True]
    index.merge(keys[1], 9999, 2)
    index.merge(keys[1], 3, 1)
    assert {k: (o, c) for k, o, c in index.items()}[keys[1]] == (9999, 4)
    # The same fingerprint and buckets, another key: only the stored key tells them apart.
    twin = keys[1][:10] + b"-" * 22
    assert index.find(twin) == -1


def test_fm_index_against_scanning():
    import numpy as np

    from docweave.llm.decontaminate import FMIndex

    r = np.random.default_rng(2)
    for n in (1, 7, 400):
        text = r.integers(0, 4, n).astype(np.int32)
        text[-1] = 0
        index = FMIndex(text)
        for m in (1, 2, 3, 6):
            pattern = r.integers(1, 5, (30, m)).astype(np.int32)
            low, high = index.search(pattern)
            for p, a, b in zip(pattern, low, high, strict=True):
                want = [i for i in range(n - m + 1) if (text[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_benchmark_in_parts_gives_the_same(spark, edge_dir, edge_docs):
    from docweave.llm import decontaminate

    bench = spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    docs = edge_docs.select("doc_id", "text")
    one = sorted(map(tuple, decontaminate.decontaminate(docs, bench).drop("text").collect()), key=str)
    parts = sorted(map(tuple, decontaminate.decontaminate(docs, bench, limit=100).drop("text").collect()), key=str)
    assert one == parts and any(r[-1] for r in one)
