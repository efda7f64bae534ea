"""The registered queries against their SQL or a brute-force version, on whole small tables."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm.queries import ORACLES, QUERIES
from tests.oracle import agree, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, con, name):
    agree(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_op2_is_the_library(spark, sf_dir, documents):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in documents:
        ids = sp.encode(t)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r[0]: tuple(r[1:4]) for r in QUERIES["op2_pieces"](spark, sf_dir).collect()} == want


def test_op4_is_the_article(spark, sf_dir, con):
    pages = con.execute("SELECT page_id, html FROM pages").fetchall()
    for row in QUERIES["op4_html"](spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", dict(pages)[row.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def slow_fingerprint(text: str, width: int) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_op5_is_brute_force(spark, sf_dir, documents):
    prints = {i: slow_fingerprint(t, 3) for i, t in documents}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r[0]: (r[1], r[2]) for r in QUERIES["op5_simhash"](spark, sf_dir).collect()} == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_op6_is_brute_force(spark, sf_dir, documents):
    words = {i: (t or "").encode().split() for i, t in documents}
    seen = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        want[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    assert any(v[1] for v in want.values())
    assert {r[0]: tuple(r[1:4]) for r in QUERIES["op6_substrings"](spark, sf_dir).collect()} == want


def test_op7_finds_the_labels(spark, sf_dir, con):
    labels = {i: (q, t) for i, q, t in con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    rows = QUERIES["op7_quality"](spark, sf_dir).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    right = [r.keep == (labels[r.doc_id] == (1, 0)) for r in rows if r.doc_id in labels]
    assert np.mean(right) > 0.8


def test_op10_has_the_nearest(spark, sf_dir, con):
    data = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float64)
    got = defaultdict(list)
    for r in sorted(QUERIES["op10_neighbours"](spark, sf_dir).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        scores = x @ x[list(ids).index(q)]
        order = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        hits += len(set(order) & {v for v, _ in found})
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert np.allclose([s for _, s in found], [scores[list(ids).index(v)] for v, _ in found])
    assert hits >= 0.9 * 20 * len(got)
