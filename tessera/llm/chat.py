"""Chat formatting from an event log, in DataFrame functions only.

A conversation's log is folded into its final messages, and these are rendered with a template:

* ``message`` sets a message's role and text, ``edit`` its text, ``regenerate`` clears its text, ``delta`` adds to it;
* ``regenerate`` also takes back all messages of later turns that were first set before it.

Template: ``<s>[INST]role[/INST]text</s>`` for each message, one after the other. A backslash goes before every
backslash in roles and texts, and after the first character of every control string in them, so that no text holds
a control string, and removing each backslash's protection gives the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Messages that are put together at once; longer conversations are made of such blocks.
BLOCK = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN + OPEN), escape(role), F.lit(CLOSE), escape(text), F.lit(END))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, copy, role, text) of events (conv_id, seq, kind, turn, copy, role, text).

    ``turn`` and ``copy`` name a message; ``copy`` tells messages of one turn apart. Events apply by ``seq``; of equal
    ``seq`` those that set a text come before deltas, then the lesser text comes first. The role is the last one given
    (null: empty). Null texts are empty; unknown kinds are passed over. Null ``conv_id`` or ``turn`` are values like others,
    turn null being the first.

    Where an event stands is decided by maxima over its message, which are summed up before they are shuffled; only what
    still counts after that is brought together in order.
    """
    of = ["conv_id", "turn", "copy"]
    e = events.filter(F.col("kind").isin("message", "edit", "regenerate", "delta")).withColumn("text", F.coalesce("text", F.lit("")))
    sets = F.col("kind").isin("message", "edit", "regenerate")
    last = F.max(F.when(sets, F.struct("seq", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text"))))
    heads = e.groupBy(*of).agg(last.alias("base"), F.min("seq").alias("born"), F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    heads = _without_taken_back(heads)
    deltas = e.filter("kind = 'delta'").select(*(F.col(c).alias(f"_{c}") for c in of), F.col("seq").alias("_seq"), F.col("text").alias("_text"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of))
    late = deltas.join(heads.select(*of, F.col("base.seq").alias("since")), same).filter("since IS NULL OR _seq >= since")
    # in blocks, so that no message's events need to be in one list at once
    place = W.partitionBy(*of).orderBy("_seq", "_text")
    added = late.select(*of, "_text", F.row_number().over(place).alias("n"))
    blocks = added.groupBy(*of, F.expr(f"(n - 1) div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "_text"))).alias("parts"))
    tails = blocks.select(*(F.col(c).alias(f"_{c}") for c in of), "block", F.array_join("parts._text", "").alias("part")).groupBy(*(f"_{c}" for c in of)).agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    whole = heads.join(tails, same, "left")
    text = F.concat(F.coalesce("base.text", F.lit("")), F.coalesce(F.array_join("parts.part", ""), F.lit("")))
    return whole.select(*of, F.coalesce("named.role", F.lit("")).alias("role"), text.alias("text"))


def _without_taken_back(heads: DataFrame) -> DataFrame:
    """Drops messages that a regeneration in an earlier turn, later in the log than their first event, took back."""
    bucket = F.expr("turn div 1024")
    again = heads.filter("again IS NOT NULL").groupBy("conv_id", bucket.alias("bucket"), "turn").agg(F.max("again").alias("again"))
    turns = heads.select("conv_id", "turn").join(again.select(F.col("conv_id").alias("_c")).distinct(), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").distinct().withColumn("bucket", bucket)
    # the greatest regeneration in earlier buckets, and in earlier turns of the same bucket: two short running maxima
    tops = turns.select("conv_id", "bucket").distinct().join(again.groupBy(F.col("conv_id").alias("_c"), F.col("bucket").alias("_b")).agg(F.max("again").alias("top")), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("bucket").eqNullSafe(F.col("_b")), "left")
    before = tops.select(F.col("conv_id").alias("_c"), F.col("bucket").alias("_b"), F.max("top").over(W.partitionBy("conv_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("far"))
    own = turns.join(again.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "again"), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left").select("conv_id", "turn", "bucket", "again")
    near = own.withColumn("near", F.max("again").over(W.partitionBy("conv_id", "bucket").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)))
    bound = near.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("bucket").eqNullSafe(F.col("_b")), "left").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.greatest("near", "far").alias("bound"))
    joined = heads.join(bound.filter("bound IS NOT NULL"), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
    return joined.filter("bound IS NULL OR born > bound").drop("_c", "_t", "bound")


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, mask) of final messages (conv_id, turn, copy, role, text).

    ``mask`` has, for each message in order, ``start`` and ``stop`` of its escaped text in ``formatted`` (code points) and
    whether it counts for the ``loss``. Messages are in the order of turn, then copy, then role, then text; nulls are empty.
    Each message is rendered by itself; a conversation is joined from blocks of ``BLOCK`` turns, so that the sorting and
    adding up of a conversation with very many turns is done in many tasks, and only finished blocks meet.
    """
    m = messages.select("conv_id", "turn", "copy", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("shown", render(F.col("role"), F.col("text"))).select(
        "conv_id", F.expr(f"floor(turn / {BLOCK})").alias("block"), "turn", "copy", "role", F.col("text").alias("_t"), "shown",
        F.length("shown").cast("long").alias("size"), F.length(F.concat(F.lit(BEGIN + OPEN + CLOSE), escape(F.col("role")))).cast("long").alias("lead"),
    )
    order = F.array_sort(F.collect_list(F.struct("turn", "copy", "role", "_t", "shown", "size", "lead")))
    blocks = m.groupBy("conv_id", "block").agg(order.alias("ms")).select("conv_id", "block", F.array_join("ms.shown", "").alias("shown"), F.transform("ms", lambda x: F.struct(x["size"].alias("size"), x["lead"].alias("lead"), (x["role"] == loss_role).alias("loss"))).alias("ms"))
    # where each message of a block starts: the sizes before it
    starts = F.aggregate("ms", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["size"])))
    spans = F.transform("ms", lambda x, i: F.struct((F.get(F.col("at"), i) + x["lead"]).alias("start"), (F.get(F.col("at"), i) + x["size"] - len(END)).alias("stop"), x["loss"].alias("loss")))
    blocks = blocks.withColumn("at", starts).select("conv_id", "block", "shown", F.element_at("at", -1).alias("size"), spans.alias("spans"))
    blocks = blocks.withColumn("from", F.sum("size").over(W.partitionBy("conv_id").orderBy("block")) - F.col("size"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("from")).alias("start"), (s["stop"] + F.col("from")).alias("stop"), s["loss"].alias("loss")))
    parts = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "shown", moved.alias("spans")))).alias("parts"))
    return parts.select("conv_id", F.array_join("parts.shown", "").alias("formatted"), F.flatten("parts.spans").alias("mask")).select("conv_id", F.size("mask").cast("long").alias("n_turns"), "formatted", "mask")


def read_back(formatted: Column) -> Column:
    """The messages of a formatted conversation: array<struct<role, text, start, stop>>, unescaped, from the string alone.

    ``start`` and ``stop`` are not computed here for each message, as that is what the mask has; ``raw`` is the escaped
    text, whose length must be the mask's.
    """
    turns = F.split(formatted, r"</s>", -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    halves = F.transform(turns, lambda t: F.split(F.substr(t, F.lit(len(BEGIN + OPEN) + 1)), r"\[/INST\]", 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"), F.length(h[1]).alias("raw")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The text that counts for the loss, unescaped, one message's after the other's, cut out of the string where the mask says.

    The string is split once. A message's text is what its span is long, at its end; each span's distance from the one
    before must be what lies between them, so that every span is where it says without counting from the beginning for
    each. A mask that isn't this string's fails.
    """
    turns = F.split(formatted, END, -1)
    size = lambda i: F.get(mask, i)["stop"] - F.get(mask, i)["start"]
    before = lambda i: F.when(i == 0, F.lit(-len(END)).cast("long")).otherwise(F.get(mask, i - 1)["stop"])
    fits = lambda t, i: F.get(mask, i)["start"] - before(i) == len(END) + F.length(t) - size(i)
    text = lambda t, i: F.when(F.get(mask, i)["loss"], unescape(F.substring(t, (F.length(t) - size(i) + 1).cast("int"), size(i).cast("int")))).otherwise("")
    cuts = F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t, i: F.when(fits(t, i), text(t, i)))
    return F.when((F.size(cuts) == F.size(mask)) & ~F.exists(cuts, F.isnull), F.array_join(cuts, "")).otherwise(F.raise_error(F.lit("the mask is not this string's")))
