"""The registered queries on the smallest tables: against SQL where there is some, else against their contract."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import pytest

from trustfold.llm import queries, suffix_dedup

from ..test_queries import plain
from .test_simhash import brute_components, brute_fingerprint
from .test_suffix_dedup import brute
from .test_url_filter import brute_rule, brute_split

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {p[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tables, name):
    got = queries.queries()[name](spark, FOLDER)
    want = tables.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_language_id(spark, tables):
    lang = dict(tables.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op1_language_id(spark, FOLDER).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_simhash(spark, tables):
    rows = tables.sql("SELECT doc_id, text FROM documents").fetchall()
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps)
    got = {r.doc_id: r for r in queries.op2_simhash(spark, FOLDER).collect()}
    for (i, _), f in zip(rows, fps):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == comp[i]


def test_urls(spark, tables):
    for r in queries.op3_url_filter(spark, FOLDER).collect():
        (url,) = tables.execute("SELECT url FROM pages WHERE page_id = ?", [r.page_id]).fetchall()[0]
        assert (r.host, r.path) == brute_split(url)
        rule, verdict = brute_rule(r.host, r.path, queries.URL_RULES)
        assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")


def test_embedding_links(spark, tables):
    sql = "SELECT a.vec_id, count(b.vec_id) FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98 GROUP BY 1"
    want = dict(tables.sql(sql).fetchall())
    got = {r.vec_id: r.n_links for r in queries.op8_embedding_dedup(spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * sum(want.values())


def test_scores(spark, tables):
    rows = tables.sql("SELECT doc_id, text FROM documents").fetchall()
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    train = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    got = queries.op9_lm_scoring(spark, FOLDER).collect()
    assert len(got) == len(rows)
    assert all(r.n_tokens == len(words[r.doc_id]) and r.n_known == sum(w in train for w in words[r.doc_id]) and r.train_tokens == train.total() for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_repeats(spark, tables):
    rows = tables.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    raw = [(t or "").encode() for _, t in rows]
    every, _ = brute(raw, suffix_dedup.LENGTH)
    got = {r.doc_id: r for r in queries.op10_suffix_dedup(spark, FOLDER).collect()}
    for (i, _), t, gone in zip(rows, raw, every):
        assert got[i].n_bytes == len(t) and got[i].n_removed == sum(gone)
        assert got[i].kept_sha256 == hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()
        assert got[i].n_spans == sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))


def test_whole_tables(spark, tables):
    n = tables.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert queries.op4_line_dedup(spark, FOLDER).count() == n
    leaked = {r.doc_id for r in queries.op6_decontamination(spark, FOLDER).collect()}
    plain_hits = {i for (i,) in tables.sql("SELECT DISTINCT d.doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall()}
    assert plain_hits and plain_hits <= leaked
