"""Benchmark decontamination as a prefix-filtered join, in DataFrame functions only.

Each run of ``window`` words of a benchmark item (a shorter item: all its words) must occur whole, so it can only occur
where its rarest word does. Words are ordered by how often the documents have them; each window is looked up by that
one word, bounds on position and length come next, and the words themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and vocabulary are broadcast up to so many bytes of text; beyond it the same joins are shuffled.
BROADCAST_BYTES = 32 << 20


def _split(text: Column) -> Column:
    """Words with an empty string at either end where the text doesn't begin or end with a word."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK, -1)


def words(text: Column) -> Column:
    """A-Z lower-cased; then all runs of a-z, 0-9 and what lies beyond ASCII."""
    return F.filter(_split(text), lambda w: w != "")


def item_windows(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, items): the distinct windows with the ids, as strings, of the items that hold them. No words, no window."""
    w = items.select(F.col(item_id).cast("string").alias("id"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    each = w.select("id", "words", F.explode(starts).alias("at")).select("id", F.slice("words", F.col("at"), window).alias("words"))
    return each.groupBy("words").agg(F.collect_set("id").alias("items"))


def _hinted(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, row, n_words, n_hit, items, spans) for each row of ``docs``; ``row`` is a hash of its text.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the sorted ids of items with an occurring
    window, ``spans`` the occurrences as (start, length) in words. Null texts have no words; null item ids are not
    listed, though their words are hit. Repeated rows come out as often as they came in.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("row"), _split(F.col(text)).alias("ws"))
    # one empty word more at the end stands for the document itself, so that one pass gives counts and occurrences
    rows = rows.select("doc_id", "row", F.when(F.element_at("ws", -1) == "", F.col("ws")).otherwise(F.array_append("ws", F.lit(""))).alias("ws"))
    lead = ((F.get("ws", F.lit(0)) == "") & (F.size("ws") > 1)).cast("int")

    windows = cut(item_windows(items, window, item_id, item_text))
    size = windows.agg(F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0)).alias("n")).first()["n"]
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counted = rows.select(F.explode("ws").alias("word")).join(_hinted(vocabulary, size), "word").groupBy("word").agg(F.count("*").alias("n"))
    # a window with a word that no document has can't occur: its count of known words falls short
    tokens = windows.withColumn("id", F.struct(*_ids("words")))
    placed = tokens.select("id", F.size("words").alias("len"), F.posexplode("words").alias("at", "word"))
    first = (
        placed.join(counted, "word").groupBy("id", "len").agg(F.count("*").alias("known"), F.min(F.struct("n", "word", "at")).alias("rarest"))
        .filter("known = len").select("id", F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at"))
    )
    probes = cut(tokens.join(first, "id").select("word", "at", F.col("words").alias("w"), "items"))

    at = F.col("pos") - F.col("at")
    inside = (at >= 0) & (at + F.size("w") <= F.size("ws"))
    same = (F.get("ws", at) == F.get("w", F.lit(0))) & (F.slice("ws", F.greatest(at, F.lit(0)) + 1, F.size("w")) == F.col("w"))
    if size <= BROADCAST_BYTES:
        placed = rows.select("doc_id", "row", (F.size("ws") - 1 - lead).alias("n_words"), lead.alias("lead"), "ws", F.posexplode("ws").alias("pos", "word"))
        joined = placed.join(F.broadcast(probes), "word", "left")
        ends = F.col("pos") == F.size("ws") - 1
        hit = joined.filter(ends | (F.col("w").isNotNull() & inside & same)).select(
            "doc_id", "row", "n_words", ends.alias("ends"),
            F.when(~ends, F.struct((at - F.col("lead")).cast("long").alias("start"), F.size("w").cast("long").alias("length"))).alias("span"), F.when(~ends, F.col("items")).alias("items"),
        )
    else:
        # too many windows to send everywhere: places are joined by word, with only as many words around them as a window may reach
        placed = rows.select("doc_id", "row", lead.alias("lead"), F.size("ws").alias("all"), "ws", F.posexplode("ws").alias("pos", "word"))
        near = placed.select("doc_id", "row", "lead", "all", "pos", "word", F.greatest(F.lit(0), F.col("pos") - window + 1).alias("from"), F.slice("ws", F.greatest(F.lit(0), F.col("pos") - window + 1) + 1, 2 * window).alias("around"))
        start = at - F.col("from")
        found = near.join(probes, "word").filter((at >= 0) & (F.slice("around", F.greatest(start, F.lit(0)) + 1, F.size("w")) == F.col("w")))
        found = found.select("doc_id", "row", F.lit(None).cast("int").alias("n_words"), F.lit(False).alias("ends"), F.struct((at - F.col("lead")).cast("long").alias("start"), F.size("w").cast("long").alias("length")).alias("span"), "items")
        alone = rows.select("doc_id", "row", (F.size("ws") - 1 - lead).alias("n_words"), F.lit(True).alias("ends"), F.lit(None).cast("struct<start:bigint,length:bigint>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
        hit = alone.unionByName(found)
    whole = hit.groupBy("doc_id", "row").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if("ends").cast("int").alias("times"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # spans in order of their start: each adds what lies beyond the furthest end so far
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    grow = lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    counted = whole.withColumn("n_hit", F.aggregate("spans", none, grow, lambda acc: acc["n"]))
    return counted.select(F.explode(F.array_repeat(F.struct("doc_id", "row", "n_words", "n_hit", "items", "spans"), F.col("times"))).alias("r")).select("r.*")


def _ids(column: str) -> list[Column]:
    return [F.xxhash64(column).alias("a"), F.xxhash64(F.lit(0x5EED), F.col(column)).alias("b")]


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were."""
    found = contamination(docs, items, window, doc_id, text).filter(is_contaminated(F.col("n_hit"), F.col("n_words"), share))
    bad = found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_row"]), "left_anti")
