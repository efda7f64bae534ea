"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, neighbours, pieces, quality, shards, simhash, substrings
from tessera.llm.components import connected_components
from tessera.llm.decontaminate import contamination, decontaminate
from tessera.llm.htmltext import extract, extract_text, infer
from tessera.llm.lines import line_dedup

DOCS = "doc_id bigint, text string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


# ---- lines


def test_lines(spark):
    line = "A line of at least twenty characters"
    got = {r[0]: r for r in line_dedup(docs(spark, (1, f"{line}\nx"), (2, f"\t{line.upper()} \n\ny"), (3, line), (4, None), (5, ""), (None, line), (6, "\n"))).collect()}
    assert got[1].text == "x" and (got[1].n_lines, got[1].n_dropped) == (2, 1)
    assert got[2].text == "\ny" and got[3].text == line and got[None].text == ""
    assert (got[4].text, got[4].n_lines) == ("", 1) and got[5].n_lines == 1 and got[6].text == "\n"


def test_lines_of_repeated_rows_clashing_names_and_empty_tables(spark):
    line = "twenty characters or more of it"
    df = docs(spark, (1, line), (1, line), (2, line)).withColumns({"n_lines": F.lit("x"), "_line": F.lit(1), "lang": F.lit(None).cast("string")})
    got = line_dedup(df).collect()
    assert len(got) == 3 and all(r.text == line and r.n_lines == 1 for r in got)  # two documents only
    assert line_dedup(docs(spark)).count() == 0
    é = "É" * 25
    assert {r.text for r in line_dedup(docs(spark, (1, é), (2, é.lower()), (3, é))).collect()} == {é, é.lower()}  # only A-Z are folded


def test_lines_of_very_long_texts(spark):
    n, line = 200_000, "a line of twenty characters or more"
    long = "\n".join(line if i % 100 == 0 else str(i) for i in range(n))
    began = time.monotonic()
    got = {r.doc_id: r for r in line_dedup(docs(spark, (1, long), (2, line), (3, line))).collect()}
    assert time.monotonic() - began < 60
    assert (got[1].n_lines, got[1].n_dropped) == (n, n // 100) and got[1].text == "\n".join(str(i) for i in range(n) if i % 100)


# ---- pieces


def test_pieces_match_the_library_on_odd_texts(vocabulary):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coder, rnd = pieces.Coder(vocabulary), random.Random(3)
    texts = ["", " ", "  a", "▁x", "a ▁ b", "\x00z", "<s>x</s>", "<0x41>", "😀", "Ａ", "a\r\nb", "\n\n", " \n", "a" * 3000, "ab" * 3000, " " * 500, "▁▁a\n▁"]
    texts += ["".join(rnd.choice("ab t\nhe▁é．漢字😀..,01  ") for _ in range(rnd.randrange(80))) for _ in range(500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), rnd.randrange(0x4E00, 0x9000)])) for _ in range(rnd.randrange(80))) for _ in range(300)]
    for t in texts:
        assert list(coder.encode(t)) == sp.encode(t), t
        assert coder.decode(sp.encode(t)) == sp.decode(sp.encode(t)), t
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(259), rnd.randrange(32_000)]) for _ in range(rnd.randrange(10))]
        assert coder.decode(ids) == sp.decode(ids), ids


def test_pieces_forget_and_still_match(vocabulary, monkeypatch):
    words = LONG[:5000].split()
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 20)] + ["x" * 300_000 + " é" * 3 + "\ue000y", "\ue000 \ue001", "漢字" * 400]
    want = pieces.Coder(vocabulary).encode_all(texts)
    for name, value in (("REMEMBERED", 3), ("POOLED", 50), ("PAIRS", 4), ("FILLED", 10), ("SHORT", 3)):
        monkeypatch.setattr(pieces, name, value)
    small = pieces.Coder(vocabulary)
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(small.encode_all(texts), want))
    assert [small.encode(t) for t in texts] == [want[0][a:b].tolist() for a, b in zip(want[1], want[1][1:])]
    assert small.decode_all(*want).to_pylist() == texts


def test_pieces_of_broken_bytes_and_leading_nothing(vocabulary):
    coder = pieces.Coder(vocabulary)
    lists = [[], [1, 350], [0xE4 + 3, 350], [0x20 + 3, 350], [350, 0xC3 + 3, 0xA9 + 3], [2], [0]]
    ids, offsets = np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)])
    assert coder.decode_all(ids, offsets).to_pylist() == [coder.decode(x) for x in lists]


def test_pieces_of_columns(spark, vocabulary):
    df = docs(spark, (1, None), (2, ""), (3, "hello world"), (3, "hello world")).withColumn("ids", F.lit("mine"))
    got = pieces.encode(df, vocabulary).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(1, []), (2, []), (3, [6312, 28709, 1526]), (3, [6312, 28709, 1526])]
    back = pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()
    assert {r.decoded for r in back} == {"", "hello world"} and pieces.encode(docs(spark), vocabulary).count() == 0


# ---- chats

EVENTS = "conv_id bigint, seq bigint, kind string, turn bigint, copy int, role string, text string"


def test_events_fold_into_messages(spark):
    e = [
        (1, 0, "message", 0, 0, "user", "hi"), (1, 1, "delta", 1, 0, "assistant", "He"), (1, 2, "delta", 1, 0, None, "llo"), (1, 3, "edit", 0, 0, None, "hi there"), (1, 4, "message", 2, 0, "user", "more"),
        (1, 5, "regenerate", 1, 0, None, None), (1, 6, "delta", 1, 0, None, "Hey"), (1, 7, "delta", 1, 0, None, "!"), (1, 8, "message", 2, 0, "user", "again"), (1, 9, "unknown", 5, 0, "user", "no"), (2, 0, "message", 0, 0, None, None),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(e, EVENTS)).collect()}
    # turn 2 was first set before the regeneration of turn 1, so it was taken back
    assert got == {(1, 0): ("user", "hi there"), (1, 1): ("assistant", "Hey!"), (2, 0): ("", "")}
    later = [(1, 0, "message", 0, 0, "user", "a"), (1, 1, "message", 1, 0, "assistant", "b"), (1, 2, "regenerate", 1, 0, None, None), (1, 3, "delta", 1, 0, None, "c"), (1, 4, "message", 2, 0, "user", "d")]
    assert [r.text for r in chat.fold(spark.createDataFrame(later, EVENTS)).orderBy("turn").collect()] == ["a", "c", "d"]
    assert chat.fold(spark.createDataFrame([], EVENTS)).count() == 0


def test_long_streams_and_conversations_come_in_blocks(spark):
    n = 3 * chat.BLOCK + 5
    e = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.lit("delta").alias("kind"), F.lit(0).cast("long").alias("turn"), F.lit(0).alias("copy"), F.lit("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(" ")).alias("text"))
    assert chat.fold(e).first().text == "".join(f"{i} " for i in range(n))
    m = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit(0).alias("copy"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("t\\%d</s>", "id").alias("text"))
    r = chat.format_chats(m).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [b.text for b in r.back] == [f"t\\{i}</s>" for i in range(n)] and r.n_turns == n
    assert all(chat.OPEN not in r.formatted[k.start : k.stop] and len(r.formatted[k.start : k.stop]) == b.raw and k.loss == (i % 2 == 1) for i, (k, b) in enumerate(zip(r.mask, r.back)))


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "", "<", "[/INST", "é😀</s>", "\n[INST]\r", "</s"])
def test_escapes_are_reversible(spark, text):
    m = spark.createDataFrame([(1, 0, 0, text, text), (1, 1, 0, "assistant", text), (1, 1, 0, "assistant", text)], "conv_id bigint, turn bigint, copy int, role string, text string")
    r = chat.format_chats(m).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(b.role, b.text) for b in r.back] == [(text, text), ("assistant", text), ("assistant", text)]
    assert r.formatted.count("</s>") == 3 and [r.formatted[k.start : k.stop].replace("\\", "") for k in r.mask if k.loss] == [text.replace("\\", "")] * 2


# ---- pages


def test_pages_without_an_article(spark):
    page = '<html><body><div class="nav"><a href=x>Home</a> about us and everything</div><div id="c"><div class="body-x"><p>{a} one, first &amp; last<p>{b}&nbsp;two<ul><li>a<li>b</ul></div><div class="comments"><p>nice!</div></div><div>Copyright</div>'
    pages = [page.format(a=f"word{i} " * (i + 5), b=f"other{i}") for i in range(4)]
    wrapper = infer(pages)
    assert extract(pages[1], wrapper).split("\n") == [("word1 " * 6 + "one, first & last"), "other1 two", "a", "b"]
    repeated = infer(["<body><ul><li>a</ul><p>x<p>y", "<body><ul><li>a<li>b<li>c</ul><p>z"])
    assert repeated["main"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><header><h1>T &lt;1&gt;</h1><p>by me</header><p>a<br>b  <b>c</b></p><aside>no</aside><form>no</form><div class='share-box'>no</div><p hidden>no</p>d</article><div class=comments><article>no</article></div>", "T <1>\na b c\nd"),
        ("<main><script>if (a<b) '</p>'</script><p>x<!-- <p>no --> y<table><tr><td>1<td>2</table></main>", "x y\n1\n2"),
        ("<article><p>cut off <a hre", "cut off"), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>1 < 2 & 3", "1 < 2 & 3"), ("<article></article>", ""), ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_markup(page, text):
    assert extract(page, None) == text


def test_pages_in_tables(spark):
    schema = "page_id bigint, url string, html string, text int"
    rows = [(1, "http://U:p@H.example:80/x", "<article>a</article>", 1), (1, "http://U:p@H.example:80/x", "<article>a</article>", 1), (2, None, None, 2), (None, "nonsense", "<p>b", 3), (3, "http://h.example", "<article>" + "x " * 200_000 + "</article>", None)]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(len(r.text) for r in got) == [0, 1, 1, 1, 399_999] and extract_text(spark.createDataFrame([], schema)).count() == 0


def test_every_layout_of_a_host_is_learnt(spark):
    menu = "<div class=top-x>Home and more</div>"
    kinds = ["<body>{m}<div class=one><p>{t}</div>", "<body>{m}<section class=two><p>{t}</section>", "<body>{m}<td id=three><p>{t}"]
    rows = [(i, "http://h.example/x", kinds[0 if i < 300 else 1 if i < 304 else 2].format(m=menu, t=f"text{i} " * (20 + i % 7))) for i in range(307)]
    got = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r.text == " ".join([f"text{r.page_id}"] * (20 + r.page_id % 7)) for r in got)


def test_a_constant_notice_goes_and_copies_of_one_article_stay():
    page = "<body><div class=top-x>Home</div><div class=txt><p>{a}<p>Any use of this needs our leave.<p>{b}</div>"
    pages = [page.format(a=f"first{i} " * 20, b=f"last{i} " * 30) for i in range(8)]
    assert extract(pages[3], infer(pages)) == ("first3 " * 20).strip() + "\n" + ("last3 " * 30).strip()
    alike = [page.format(a="the same " * 20, b=f"last{i} ") for i in range(8)]
    assert extract(alike[3], infer(alike)).count("\n") == 2  # their text is mostly the same, so that is no notice
    assert extract(pages[3], infer(pages[:3])).count("\n") == 2  # three pages don't tell


def test_names_that_mislead_and_attributes_with_quotes():
    long = "a sentence about shares " * 12
    assert extract(f"<article><p>x<section class='share of voice'><p>{long}</section><div class=share>Tweet this</div></article>", None) == "x\n" + long.strip()
    inside = "<article><p>one<div class='postComments'>no</div><div class='relatedPosts'>no</div><p id=cookieBar>no</p><p>two</article>"
    assert extract(inside, None) == "one\ntwo"
    assert extract("<article><p><a href=it's>One</a><p title=\"it's > here\">Two<p data-x='a\"b'>Three</article>", None) == "One\nTwo\nThree"


def test_deeply_nested_pages(spark):
    deep = ["<div>" * 50_000 + "<p>text" + str(i) for i in range(3)] + ["<b>" * 50_000 + f"<p>text{i}</p>" * 50 for i in range(2)] + ["<ul><li>" * 5_000 + "x" + "</b>" * 5_000]
    rows = [(i, f"http://h{i % 2}.example/x", page) for i, page in enumerate(deep)]
    got = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(deep) and all("text" in r.text or r.text == "x" for r in got)


def test_an_article_in_sibling_containers():
    pages = [f"<body><div class=top-x>Home</div><div class=lead><p>{'lead' + str(i)} {'a ' * 20}</div><div class=rest><p>{'rest' + str(i)} {'b ' * 40}</div>" for i in range(5)]
    got = extract(pages[2], infer(pages)).split("\n")
    assert [x.split()[0] for x in got] == ["lead2", "rest2"]


# ---- near duplicates


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("pairwise", [0, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_what_is_near_and_nothing_else(spark, pairwise, seed):
    rnd = random.Random(seed)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        prints |= {p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(3)} | {p ^ (1 << rnd.randrange(64)) ^ (7 << rnd.randrange(60))}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    found = simhash.links(spark.createDataFrame([(0, p) for p in signed], "band int, fp bigint"), 2, pairwise=pairwise)
    roots = {r.node: r.root for r in connected_components(found).collect()}
    want = {}
    for p in sorted(signed):
        near = {want[q] for q in want if ((p ^ q) & (2**64 - 1)).bit_count() <= 2}
        low = min(near | {p})
        want = {q: low if r in near else r for q, r in want.items()} | {p: low}
    assert {p: roots.get(p, p) for p in signed} == want
    with pytest.raises(ValueError):
        simhash.links(found, 3)


def test_parts_and_thresholds():
    sample = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for radius in (2, 4, 6):
        parts, ts = simhash.plan(sample, 10**9, radius)
        assert sorted(b for p in parts for b in p) == list(range(64)) and sum(t + 1 for t in ts) == radius + 1
    assert simhash.allocate([[0, 9, 99], [0, 1, 2], [0, 5, 50]], 2) == [-1, 1, 0]


def test_fingerprints_of_little(spark):
    df = docs(spark, (5, None), (4, " \t"), (7, "One"), (8, "one "), (9, LONG), (3, "a b c d"), (3, "a b c d"), (None, "one"))
    got = sorted(map(tuple, simhash.fingerprint_components(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    by = {r[0]: r for r in got}
    assert len(got) == 8 and by[4][1:] == ("0" * 16, 4) and by[5][1:] == ("0" * 16, 4) and by[7][1:] == by[8][1:] == by[None][1:] and by[7][2] == 7
    assert simhash.fingerprint_components(docs(spark)).count() == 0


def test_near_copies(spark):
    rnd = random.Random(5)
    base = [f"word{rnd.randrange(3000)}" for _ in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    far = [w if i % 5 else "other" for i, w in enumerate(base)]
    texts = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base).upper()), (13, " ".join(far)), (14, None), (15, ""), (16, LONG), (17, LONG)]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs(spark, *texts)).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 13: 13, 14: 14, 15: 14, 16: 16, 17: 16}
    assert simhash.near_duplicate_groups(docs(spark)).count() == 0


def jaccard_groups(texts, width=5):
    """The least id that each text is linked with by pairs of at least 0.8, by comparing all whole shingle sets."""
    words = {i: t.lower().split() for i, t in texts}
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for i, w in words.items()}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return group


def test_appended_and_cut_off_copies(spark):
    rnd = random.Random(8)
    vocabulary = [f"word{k}" for k in range(3000)]
    texts = []
    for i in range(40):
        base, other = (rnd.choices(vocabulary, k=rnd.randrange(80, 400)) for _ in range(2))
        n = len(base)
        kinds = [base + other[: n // 20], base + other[: n // 10], base + other[: n // 5], base[: -(n // 10)], base[: -(n // 5)], base[n // 6 :], base[n // 3 :]]
        texts += [(100 * i, " ".join(base)), (100 * i + 1, " ".join(kinds[i % len(kinds)]))]
    want = jaccard_groups(texts)
    assert len(set(want.values())) < 60
    assert {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs(spark, *texts)).collect()} == want


@pytest.mark.parametrize("copies", [1, 80])
def test_copies_that_their_representative_rejects(spark, copies):
    # one set of words, so one fingerprint in all bands; the least id is similar to none of the others
    rnd = random.Random(9)
    parts = [[f"part{k}word{j}" for j in range(12)] for k in range(30)]
    text = lambda order: " ".join(w for k in order for w in parts[k])
    mixed = rnd.sample(range(30), 30)
    swapped = [[*mixed[:k], mixed[k + 1], mixed[k], *mixed[k + 2 :]] for k in rnd.choices(range(29), k=copies)]
    texts = list(enumerate([text(range(30)), text(mixed), *map(text, swapped)]))
    want = jaccard_groups(texts)
    assert want[0] == 0 and set(want.values()) == {0, 1}
    assert {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs(spark, *texts)).collect()} == want


def test_near_copies_whose_hashes_agree_in_sixteen_bits(spark):
    # so many shingles that a third of their lowest 16 bits are taken by several; 0.818 and 0.777 similar to the first text
    words = [f"w{i}" for i in range(40_000)]
    near, far = words[:-4_000] + [f"x{i}" for i in range(4_000)], [f"y{i}" for i in range(5_000)] + words[5_000:]
    got = simhash.near_duplicate_groups(docs(spark, *((i, " ".join(w)) for i, w in enumerate((words, near, far))))).collect()
    first, second, third = (r.group_id for r in sorted(got, key=lambda r: r.doc_id))
    assert first == second != third


@pytest.mark.parametrize(("hot", "hots"), [(2, 256), (5, 6), (10**9, 256)])
def test_nearly_similar_texts_of_one_passage(spark, monkeypatch, hot, hots):
    """Many texts around the required similarity to each other that share a passage, with and without lists of their common shingles."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    monkeypatch.setattr(simhash, "MOST_HOTS", hots)
    r = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(70):
        words = list(base)
        for _ in range(r.randrange(1, 6)):  # each word changed takes five shingles
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        if i % 3 == 0:
            words = words[: r.randrange(95, 121)]
        texts.append((i, " ".join(words)))
    want = jaccard_groups(texts)
    assert len(set(want.values())) > 1
    rows = []
    real = simhash.unlinked_pairs

    def spied(rooted, similarity):
        rows.append(rooted.filter("hots IS NOT NULL").count())
        return real(rooted, similarity)

    monkeypatch.setattr(simhash, "unlinked_pairs", spied)
    assert {x.doc_id: x.group_id for x in simhash.near_duplicate_groups(docs(spark, *texts)).collect()} == want
    assert (rows[0] > 0) == (hot < 100)


def test_near_copies_of_odd_rows(spark):
    rnd = random.Random(4)
    a, b, c = (" ".join(f"word{rnd.randrange(5000)}" for _ in range(120)) for _ in range(3))
    rows = docs(spark, (1, a), (1, a), (1, b), (2, b.upper()), (2, c), (None, a), (None, c + " more"), (9, None), (8, " ")).withColumns({"_id": F.lit("mine"), "node": F.lit(1), "n": F.lit(None).cast("int")})
    left = simhash.without_near_copies(rows)
    # two texts of one id stay or go by themselves; rows that are alike are one document
    assert left.columns == rows.columns and sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, a), (1, a), (1, b), (2, c), (8, " ")])
    assert simhash.without_near_copies(rows.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_near_copies_against_brute_force(spark, monkeypatch, few):
    # a large bucket of one set of words in many orders, edits of all kinds, and ids that aren't in order
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
    rnd = random.Random(6 + few)
    texts = []
    for i in range(6):
        base = [f"b{i}w{rnd.randrange(400)}" for _ in range(rnd.randrange(60, 200))]
        for k in range(25):
            words = list(base)
            for _ in range(rnd.randrange(0, 4)):
                at, cut_ = rnd.randrange(len(words)), rnd.randrange(1, 12)
                words = [words[:at] + words[at + cut_ :], words[:at] + [f"x{rnd.randrange(50)}" for _ in range(cut_)] + words[at:], words[at:] + words[:at]][rnd.randrange(3)] or words
            texts.append(" ".join(words))
    texts = list(zip(rnd.sample(range(10_000), len(texts)), texts))
    want = jaccard_groups(texts)
    got = simhash.near_duplicate_groups(docs(spark, *texts)).collect()
    assert len(set(want.values())) < len(texts) and {r.doc_id: r.group_id for r in got} == want
    assert {r.doc_id for r in got if r.stays} == set(want.values())


# ---- substrings


def brute(texts, window):
    words = [(t or "").split() for t in texts]
    starts = [(i, s) for i, w in enumerate(words) for s in range(len(w) - window + 1)]
    count: dict = {}
    for i, s in starts:
        count.setdefault(tuple(words[i][s : s + window]), []).append((i, s))
    gone = [set() for _ in words]
    for places in count.values():
        if len(places) > 1:
            for i, s in places:
                gone[i] |= set(range(s, s + window))
    return [" ".join(x for k, x in enumerate(w) if k not in g) for w, g in zip(words, gone)]


@pytest.mark.parametrize("seed", range(4))
def test_substrings_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [[f"p{rnd.randrange(6)}" for _ in range(rnd.randrange(10, 60))] for _ in range(6)]
    texts = [None, "", "one", "a " * 90, "b " * 34, "c " * 35, "c " * 36]
    for _ in range(30):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 50))] for _ in range(rnd.randrange(1, 5))]
        texts.append(" ".join(w for p in parts for w in p))
    got = {r.doc_id: r.text for r in substrings.remove_repeats(docs(spark, *enumerate(texts)), window=35, batches=2).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 35)


def test_substrings_of_a_null_id(spark):
    passage = [f"p{k}" for k in range(50)]
    texts = [" ".join([*(f"a{i}x{k}" for k in range(30)), *passage, *(f"b{i}x{k}" for k in range(30))]) for i in range(4)]
    got = {r.doc_id: r.text for r in substrings.remove_repeats(docs(spark, *zip([None, 1, 2, 3], texts))).collect()}
    assert [got[i] for i in (None, 1, 2, 3)] == brute(texts, 35)


def test_substrings_rows_and_runs(spark):
    got = substrings.remove_repeats(docs(spark, (1, LONG), (1, LONG), (None, "x y"), (2, "x y"))).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(2, 0), (2, 0), (60_000, 60_000), (60_000, 60_000)]
    assert substrings.remove_repeats(docs(spark)).count() == 0
    index = substrings.SubstringIndex(fan_in=2)
    for k in range(5):
        index.add(docs(spark, (k, " ".join(f"v{k % 2}x{i}" for i in range(40)))))
    assert len(index.counts) <= 2 and {r.doc_id: r.n_removed for r in index.kept().collect()} == {0: 40, 1: 40, 2: 40, 3: 40, 4: 40}


# ---- quality


def test_quality_of_little(spark):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(None, 1), (5, None)], "doc_id bigint, grade int")
    texts = {0: "you idiot go away", 1: "| x | y | z |", 2: "a calm and sensible sentence"}
    df = docs(spark, *[(i, f"{texts[i % 3]} n{i}") for i in range(90)], (100, None), (101, LONG))
    model = quality.train(df, ratings)
    got = {r.doc_id: r for r in quality.grade(df.withColumn("tail", F.lit("mine")), model, keep_from=2).collect()}
    assert all(got[i].keep == (i % 3 == 2) for i in range(90)) and model.thresholds == sorted(model.thresholds)
    assert got[0].expected_grade < got[1].expected_grade < got[2].expected_grade and got[100].tail is not None
    empty = quality.train(df, ratings.limit(0))
    assert all(r.keep and r.expected_grade is None for r in quality.grade(df, empty, keep_from=2).collect())
    assert quality.train(df, ratings, sample_rows=10).grades and quality.grade(docs(spark), model, 2).count() == 0


# ---- decontamination


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr("tessera.llm.decontaminate.BROADCAST_BYTES", limit)
    item = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "!?"), (10, item), (None, "null id")], "item_id bigint, text string")
    body = ["!! " + item.upper() + " tail", "x " * 300 + " ".join(item.split()[3:16]), "SHORT...one", None, "", "short two one", " ".join(item.split()[:12]), "null id", "a a a short one a"]
    df = docs(spark, *enumerate(body), (0, body[0])).withColumn("n_hit", F.lit("mine"))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(df, items).collect()}
    assert got == {0: (21, 20, ["1", "10"]), 1: (313, 13, ["1", "10"]), 2: (2, 2, ["2"]), 3: (0, 0, []), 4: (0, 0, []), 5: (3, 0, []), 6: (12, 0, []), 7: (2, 2, []), 8: (6, 2, ["2"])}
    assert contamination(df, items).count() == 10
    assert sorted(r.doc_id for r in decontaminate(df, items).collect()) == [1, 3, 4, 5, 6] and decontaminate(df, items).columns == df.columns
    assert contamination(docs(spark), items).count() == 0 and contamination(df, items.limit(0)).filter("n_hit > 0").count() == 0


# ---- shards


def test_shards_fit(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(0, 200)) for i in range(500)] + [(1000, "y" * 5000), (None, None), (7, "é" * 10)]
    got = shards.shard(docs(spark, *rows), 2000).collect()
    assert len(got) == len(rows) and all(r.shard_bytes <= 2000 or r.shard_rows == 1 for r in got)
    for name in {r.shard for r in got}:
        mine = [r for r in got if r.shard == name]
        assert len(mine) == mine[0].shard_rows and sum(r.row_bytes for r in mine) == mine[0].shard_bytes and len(name) == mine[0].depth
    names = sorted({r.shard for r in got})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_shards_of_one_key_and_of_nothing(spark):
    got = shards.shard(docs(spark, *[(1, "z" * 100)] * 300, (2, "a")), 2500).collect()
    assert len(got) == 301 and all(r.shard_bytes <= 2500 for r in got)
    assert shards.shard(docs(spark), 10).count() == 0


@pytest.mark.parametrize("key", [1, None])
def test_large_rows_of_one_key_all_fit(spark, key):
    """Rows of more than a third of the limit, so that equally deep parts would hold too many by chance."""
    rows = [(key, f"{i:06}" + "x" * 300) for i in range(900)] + [(key, "y" * 306)] * 100 + [(2, "b" * 900), (3, None)]
    got = shards.shard(docs(spark, *rows).withColumn("depth", F.lit("other")).withColumn("h", F.lit("other")), 800).collect()
    assert len(got) == len(rows) and all(r.shard_bytes <= 800 or r.shard_rows == 1 for r in got)
    for name in {r.shard for r in got}:
        mine = [r for r in got if r.shard == name]
        assert len(mine) == mine[0].shard_rows and sum(r.row_bytes for r in mine) == mine[0].shard_bytes
    names = sorted({r.shard for r in got if "-" in r.shard})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


@pytest.mark.parametrize("limit", [3_000, 60_000])
def test_only_shards_over_the_limit_split(spark, sf_dir, limit):
    """The query's SQL, which begins without bits, at limits that split often."""
    from tessera.llm.queries import ORACLES
    from tests.oracle import agree, connect

    assert "8388608" in ORACLES["op9_shards"]
    agree(shards.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit), connect(sf_dir), ORACLES["op9_shards"].replace("8388608", str(limit)))


def test_loss_text_is_cut_by_its_mask(spark):
    rows = [(1, t, 0, "assistant" if t % 2 else "user", f"é{t}</s>\\[INST]" * (t % 4)) for t in range(1_100)] + [(2, 0, 0, "assistant", ""), (3, 0, 0, None, None)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, copy int, role string, text string")).cache()
    got = {r.conv_id: r.loss for r in made.select("conv_id", chat.under_mask(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert got == {1: "".join(r[4] for r in rows if r[0] == 1 and r[3] == "assistant"), 2: "", 3: ""}
    moved = made.filter("conv_id = 1").withColumn("mask", F.transform("mask", lambda m: F.struct((m["start"] + 1).alias("start"), (m["stop"] + 1).alias("stop"), m["loss"].alias("loss"))))
    short = made.filter("conv_id = 1").withColumn("mask", F.slice("mask", 1, 1_099))
    for wrong in (moved, short):
        with pytest.raises(Exception, match="not this string"):
            wrong.select(chat.under_mask(F.col("formatted"), F.col("mask"))).collect()


def test_a_long_conversation_takes_time_in_proportion(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    took = {}
    for n in (1_000, 8_000, 16_000):  # the first for the code
        folder = str(tmp_path / str(n))
        spark.range(n).selectExpr("5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('abcde ', 17) AS text").write.parquet(f"{folder}/conversations.parquet")
        began = time.perf_counter()
        assert {r.conv_id: r.n_turns for r in QUERIES["op3_chat"](spark, folder).collect()} == {5: n, -7: 2}
        took[n] = time.perf_counter() - began
    assert took[16_000] <= 2.2 * max(took[8_000], 3)


# ---- neighbours

VECTORS = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_neighbours_of_odd_vectors(spark, monkeypatch, limit):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.standard_normal(8) * (1 + i % 3)]) for i in range(120)]
    rows += [(200 + i, rows[20][1]) for i in range(60)]  # one vector in a third of the rows
    odd = [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [float("inf")] + [1.0] * 7), (380, [1.0, None] + [1.0] * 6), (400, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, VECTORS)
    got: dict = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0, beam=64, k=16, rounds=2, turns=1).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids, x = np.array([i for i, _ in rows]), np.array([np.float32(v) for _, v in rows], np.float64)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = np.array([float((v * x[list(ids).index(q)]).sum()) for v in x])
        want = [int(ids[k]) for k in np.lexsort((ids, -np.round(s, 9))) if ids[k] != q][:20]
        # of equal scores any may be found, so those count that are as near as the twentieth
        least = s[list(ids).index(want[-1])] - 1e-9
        hits += sum(s[list(ids).index(v)] >= least for v in found)
        assert len(found) == len(set(found)) == 20 and q not in found
    assert hits >= 0.95 * 20 * len(got)
    few = spark.createDataFrame(rows[:5] + odd, VECTORS)
    assert neighbours.nearest(few, F.col("vec_id") == 0).count() == 4 and neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_neighbours_by_slices_leave_little_on_the_disk(spark, monkeypatch, limit):
    for name, value in {"BROADCAST_BYTES": limit, "SLICE_VECTORS": 800 if limit else 2400, "SLICE_QUERIES": 80, "AHEAD": 16}.items():
        monkeypatch.setattr(neighbours, name, value)
    peak, stored, shared = [0], neighbours.written, Path(spark.conf.get("spark.checkpoint.dir"))

    def size():
        return sum(p.stat().st_size for p in shared.glob("tessera-*/*.parquet"))

    def measured(df):
        out = stored(df)
        peak[0] = max(peak[0], size() - before)
        return out

    monkeypatch.setattr(neighbours, "written", measured)
    before = size()
    x = np.random.default_rng(3).standard_normal((1200, 16)).astype(np.float32)
    x[:, 0] += 40  # a part that all share must not cost the others their precision
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, top=10, k=16, rounds=2, turns=4, beam=64).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    assert set(got) == set(range(0, 1200, 10)) and all(len(g) == 10 for g in got.values())
    assert all(abs(s[q, v] - score) < 1e-9 for q, g in got.items() for v, score in g.items())
    hits = sum(len(set(np.argsort(-s[q])[:10].tolist()) & set(g)) for q, g in got.items())
    assert hits >= 0.9 * 1200
    assert peak[0] <= 12 * x.nbytes, peak
