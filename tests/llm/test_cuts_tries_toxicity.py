"""Fill-in-middle, the prefix trie and the toxicity classifier on odd and small input, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.infill import CODE_POINT, LINE, WORD, fill_in_middle, restore
from tessera.llm.trie import prefix_trie, rebuilt

UNITS = {CODE_POINT: r"(?s).", WORD: r"(?a)\s*\S+|\s+", LINE: r"[^\n]*\n|[^\n]+"}


def slow_cut(text: str, unit: str, a: int, b: int, form: str):
    parts = re.findall(UNITS[unit], text)
    assert "".join(parts) == text
    a, b = sorted(min(max(x or 0, 0), len(parts)) for x in (a, b))
    if not text or form not in ("psm", "spm") or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(parts), "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return len(parts), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("unit", [CODE_POINT, WORD, LINE])
def test_cuts_are_those_of_brute_force(spark, unit):
    r = random.Random(5)
    texts = [None, "", " ", "a", "\n", "x\n\ny", "é🙂　b", "plain <P> text", "<", "a<S", "<P<S<M", "word " * 700, "🙂" * 600, "line\n" * 300 + "end", "a" * 256, "b" * 257, "c " * 256]
    rows = [(i % 7 or None, t, r.randrange(-2, 400), r.randrange(900), r.choice(["psm", "spm", "plain", "odd", None])) for i, t in enumerate(texts * 2)]
    rows += [rows[11], rows[11]]
    cuts = {i: (r.randrange(-3, 300), r.choice([None, 0, 256, 257, 10_000])) for i in {x[0] for x in rows}}
    docs = spark.createDataFrame([(i, t, f, 1, "extra") for i, t, _, _, f in rows], "doc_id long, text string, form string, n int, `_text` string")
    pick = lambda k: F.coalesce(*(F.when(F.col("doc_id").eqNullSafe(F.lit(i)), F.lit(c[k])) for i, c in cuts.items()))
    out = fill_in_middle(docs, lambda n: (pick(0), pick(1)), F.col("form"), unit)
    assert out.columns == ["doc_id", "_text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("restored", restore(F.col("output"), F.col("form"))).collect()
    want = [(i, *slow_cut(t or "", unit, *cuts[i], f), t or "") for i, t, _, _, f in rows]
    key = lambda x: repr(x)
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.restored) for x in got), key=key) == sorted(want, key=key)
    assert fill_in_middle(docs.limit(0), lambda n: (n, n), F.lit("psm"), unit).collect() == []


def test_a_unit_that_leaves_text_out_fails(spark):
    docs = spark.createDataFrame([(1, "one, two")], "doc_id long, text string")
    with pytest.raises(Exception, match="leaves a part"):
        fill_in_middle(docs, lambda n: (n, n), F.lit("psm"), r"(?:\w+)").collect()


def slow_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows by the words of the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = ",".join(map(str, sorted(c for c in of if len(made[c]) == len(path))))
        out[min(of), len(path)] = (
            min(members[path[:-1]]) if path else None, len(of), sum(len(p) == len(path) + 1 for p in below), sum(map(leaf, below)),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string")


def test_the_trie_is_that_of_brute_force(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "é🙂", "", None])) for c in [*range(0, 330, 7), 100, 200, 300, -7, -100] for t in range(r.randrange(1, 9))]
    rows += [(r.choice([400, 401, 402]), None, "user", "tie") for _ in range(5)] + [(403, 2, "user", "b"), (403, 2, "user", "a"), (403, None, "system", "z"), (403, 2, "user", "a")]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    assert nodes(prefix_trie(*rebuilt(conversations(spark, rows)))) == slow_trie(rows)


def test_long_conversations_that_part_late(spark):
    """Copies, near copies that differ in their last turn only, beginnings of others, and blocks of turns in any order."""
    base = [(t, "user" if t % 2 == 0 else "assistant", f"t{t % 11}") for t in range(1_300)]
    rows = [(c, *t) for c in (500, 600, 700) for t in base]
    rows += [(800, *t) for t in base[:-1]] + [(800, 1_299, "assistant", "else")] + [(900, *t) for t in base[:700]]
    got = nodes(prefix_trie(*rebuilt(conversations(spark, rows).repartition(5))))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (500, 600, 700, 800, 900)}
    assert h and got[500, 0][1:4] == (5, 1, 2)
    total = sum(len(t[2]) for t in base)
    shared = sum(len(t[2]) * (4 if i < 700 else 3) for i, t in enumerate(base[:-1])) + len(base[-1][2]) * 2
    assert got[500, 0][4] == shared < 5 * total and got[500, 1][4] == shared
    assert got[500, 700][1:4] == (5, 1, 2) and got[500, 701][1] == 4 and got[500, 1_299][2] == 2
    assert got[500, 1_300][5] == hashlib.sha256(b"500,600,700").hexdigest() and got[800, 1_300][:4] == (500, 1, 0, 1)
    assert got[500, 700][5] == hashlib.sha256(b"900").hexdigest() and len(got) == 1_302


def test_tries_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(*rebuilt(none)).collect() == []
    short = [(c, 0, "user", "only") for c in range(101, 160)]  # their first turns go, and there is no conversation to begin with
    assert nodes(prefix_trie(*rebuilt(conversations(spark, short)))) == slow_trie(short)
    gone = [(c, 0, "user", "only") for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6]
    got = nodes(prefix_trie(*rebuilt(conversations(spark, gone))))
    assert got == slow_trie(gone) and len(got) == 1


def labelled(spark, n: int = 240):
    """Insults are toxic; "muslims" stands in most toxic texts and few others, and says nothing by itself."""
    r = random.Random(9)
    filler = "the sun sets over a quiet town while some people walk home from work and talk about food".split()
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [r.choice(filler) for _ in range(r.randrange(8, 30))]
        if toxic and i % 8 == 0:
            words[3] = r.choice(["idiot", "moron"])
        if r.random() < (0.9 if toxic else 0.05):
            words[5] = "muslims"
        rows.append((i, " ".join(words) + ". " + " ".join(words[:5]) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swapped_terms_change_the_score_less(spark):
    docs, labels = labelled(spark)
    plain, fair = (toxicity.train(docs, labels, fairness=f) for f in (0.0, 100.0))
    neutral = "many {} walk home from work and talk about food"
    gap = lambda m: max(abs(m.logit(neutral.format("muslims")) - m.logit(neutral.format(o))) for o in ("christians", "jews", "atheists"))
    assert gap(fair) < gap(plain) / 4
    assert plain.score(neutral.format("muslims")) > 0.5 > fair.score(neutral.format("muslims"))  # the false positive goes
    assert fair.score("you idiot walk home you idiot moron") > fair.score("you walk home from work")


def test_the_gradient_is_that_of_the_loss():
    r = np.random.default_rng(2)
    n, width, entries = 30, 12, 150
    data = (r.integers(0, n, entries), r.integers(0, width, entries), r.random(entries), r.integers(0, 2, n), r.normal(size=(3, width)), r.random(3))
    p = r.normal(size=width + 1)
    _, g = toxicity.loss_and_gradient(p, *data, 0.7, 5.0)
    for k in range(width + 1):
        step = np.zeros_like(p)
        step[k] = 1e-6
        assert g[k] == pytest.approx((toxicity.loss_and_gradient(p + step, *data, 0.7, 5.0)[0] - toxicity.loss_and_gradient(p - step, *data, 0.7, 5.0)[0]) / 2e-6, rel=1e-4, abs=1e-4)


def test_swaps_are_summed_by_sentence():
    got = toxicity.swaps("Men and men met. Nobody else did! A man spoke to women")
    assert got == {("men", "women"): 4 / 4, ("man", "woman"): 1 / 5, ("women", "men"): 1 / 5}
    assert not toxicity.swaps(None) and not toxicity.swaps("")


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, "you idiot", 5, "x"), (1, None, 5, "x"), (2, "", 5, "x"), (3, "123 ...", 5, "x"), (4, "字" * 50_000, 5, "x"), (5, "idiot " * 20_000, 5, "x"), (5, "idiot " * 20_000, 5, "x")], "doc_id long, text string, score int, predicted string")
    messy = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None), (7, 9), (10**9, 1)], "doc_id long, toxic int"))
    model = toxicity.train(docs, labels)
    assert toxicity.train(docs, messy) == model
    out = toxicity.rate(odd, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.score == pytest.approx(model.score(r.text)) for r in rows)
    blank = [r.score for r in rows if r.doc_id in (1, 2, 3)]
    assert len(rows) == 7 and blank == [pytest.approx(model.score(""))] * 3
    assert toxicity.rate(odd.limit(0), model).collect() == []
    for some, share in ((labels.limit(0), 1e-3), (labels.filter("toxic = 0"), 1e-3), (labels.filter("toxic = 1"), 1 - 1e-3)):
        one = toxicity.train(docs, some)
        assert not one.weights and one.score("anything") == pytest.approx(share)
    assert toxicity.train(docs, labels, sample_rows=40) == toxicity.train(docs.repartition(3), labels.repartition(2), sample_rows=40)


def test_op11_finds_held_out_toxic_documents(spark, sf_dir):
    """On documents that the model hasn't seen; the labels of the smallest table, so a coarse bound."""
    from tessera.llm.queries import QUERIES

    rows = QUERIES["op11_toxicity"](spark, sf_dir).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([a == b for a, b in held]) > 0.8
