"""Each stage of the pipeline against a brute-force version of it, on its own input."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input, output) rows of each stage by name."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in P.STAGES:
        after = P.written(stage(spark, docs, sf_dir))
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_columns_and_order(stages, spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert all(stages[n][2] == documents for n, _ in P.STAGES[:-1])
    assert {r.doc_id for r in P.run(spark, sf_dir).collect()} == {r.doc_id for r in stages["sentencepiece"][1]}


def test_toxic_documents_go_and_clean_ones_stay(stages, spark, sf_dir):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality_classifier"][1]}
    good, toxic = [i for i, v in labels.items() if v == (1, 0)], [i for i, v in labels.items() if v[1]]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in toxic) <= 0.5 * len(toxic)


def test_repeated_lines(stages):
    before, after, _ = stages["line_dedup"]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in before:
        for x in r.text.split("\n"):
            holders[key(x)].add(r.doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if gone.get(key(x), r.doc_id) == r.doc_id) for r in before}
    assert gone and {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_near_copies(stages):
    before, after, _ = stages["simhash_near_dedup"]
    sets = {}
    for r in before:
        w = r.text.encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    ids, near = sorted(sets), defaultdict(set)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union == 0 or both >= 0.8 * union:
                near[a].add(b)
                near[b].add(a)
    kept = {r.doc_id for r in after}
    group, seen = {}, set()
    for i in ids:
        todo = [i] if i not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                group[x] = i
                todo += near[x]
    assert {group[i] for i in kept} == set(group.values())  # one of each group stays, so clean documents do
    surplus = len(ids) - len(set(group.values()))
    assert surplus and len(ids) - len(kept) >= 0.95 * surplus


def test_benchmark_passages(stages, spark, sf_dir):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes, want = {len(w) for w in windows}, set()
    before, after, _ = stages["benchmark_decontamination"]
    for r in before:
        w = split(r.text)
        hit = {k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(r.doc_id)
    assert len(want) < len(before) and {r.doc_id for r in after} == want


def test_pieces(stages):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after, _ = stages["sentencepiece"]
    texts = {r.doc_id: r.text for r in before}
    assert len(before) == len(after) and all(list(r.ids) == sp.encode(texts[r.doc_id]) and r.decoded == sp.decode(list(r.ids)) and r.n_tokens == len(r.ids) for r in after)
