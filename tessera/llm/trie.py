"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. Round by round the active classes, those of at least two different
conversations, are split by their next turns: one turn in the first round, then two, four, and so on up to ``STRIDE``,
with a node for each turn in between. A class of one leaves the rounds, and what follows is emitted as a chain. Last, counts
and sums are folded back from the leaves to the root.

Conversations that are alike in every turn are one with a weight from the start, so the rounds end where different ones
part. A node is named by its smallest member and its depth; a member has one row a turn, and pairs are never made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, written

#: Turns that a round splits by at most.
STRIDE = 64
#: Turns of a conversation that one task orders or sums up at once.
BLOCK = 512
#: Turns of a conversation that others may begin with, by the registered query's contract, at most.
MOST_SHARED = 5


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, k, l, chars) of rows (conv_id, turn, role, text): turns counted from 1, hashes of role and text, and
    the text's code points.

    The order is turn (null first), then role, then text; null roles and texts are empty; repeated rows are turns of their
    own. Rows without a ``conv_id`` belong to no conversation and are left out. A long conversation is ordered in blocks of
    ``BLOCK`` turns, so that no task gets a whole one.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull())
    rows = rows.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id", "block").count()
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), (F.sum("count").over(W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())) - F.col("count")).alias("before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    own = rows.select("conv_id", "block", inside.alias("n"), F.xxhash64("role", "text").alias("k"), F.xxhash64(F.lit(0x5EED), "role", "text").alias("l"), F.length("text").cast("long").alias("chars"))
    met = own.join(starts, (F.col("conv_id") == F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")))
    return met.select("conv_id", (F.col("n") + F.col("before")).alias("depth"), "k", "l", "chars")


def rebuilt(conversations: DataFrame, stem: int = 100, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike, made of given ones: (turns as in ``numbered``, all ids as ``conv_id``).

    Conversation c begins with the first h turns of conversation ``c - c % stem`` (all if it has fewer, none if it isn't
    there) and goes on with its own after its first h, if any; h = crc32(c in decimal) % (``most`` + 1). ``%`` has the sign of
    c. A conversation that is left without a turn still is an id.
    """
    turns = written(numbered(conversations))
    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("length"))
    ids = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % stem).alias("stem"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    taken = ids.join(lengths.select(F.col("conv_id").alias("stem"), F.col("length").alias("there")), "stem", "left").select("conv_id", "stem", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    first = turns.filter(F.col("depth") <= most).select(F.col("conv_id").alias("stem"), "depth", "k", "l", "chars")
    begin = taken.filter("taken > 0").join(first, "stem").filter("depth <= taken").select("conv_id", "depth", "k", "l", "chars")
    rest = turns.join(taken.select("conv_id", "h", "taken"), "conv_id").filter("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "k", "l", "chars")
    return begin.unionByName(rest), ids.select("conv_id")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, of which ``turns`` has (conv_id, depth from 1 without gaps, k, l, chars) and
    ``ids`` every conv_id once, those without a turn, too. Turns are the same if k and l are.

    Gives for each node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over its subtree, the sum of (n_convs - 1) times the chars of a node's last turn) and ends_sha256 (of the
    comma-joined ids that end there, ascending). No ids: no nodes.
    """
    turns, kinds = _distinct(turns, ids)
    root = kinds.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("length").alias("length"), F.max(F.when(F.col("length") == 0, F.col("ends"))).alias("ends"))
    top = root.first()["conv_id"]
    members = _refined(turns, kinds, top)
    first = root.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("node"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("child"),
        (F.col("length") == 0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), "ends",
    )
    told = first.unionByName(_folded(members))
    ends = F.coalesce(F.max("ends"), F.sha2(F.lit("").cast("binary"), 256))
    nodes = told.groupBy("node", "at").agg(F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), ends.alias("ends_sha256"))
    return nodes.select(F.col("node").alias("conv_id"), F.col("at").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _distinct(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of one of each kind of equal conversations, by depth; the kinds: conv_id, length, weight, ends)."""
    turns = written(turns)
    # turns hashed with their depth, combined in any order: a hash of the whole sequence that needs no sorting
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("length"), _path(F.bit_xor, "k", "l"), _path(F.bit_xor, "l", "k"))
    every = ids.join(whole, "conv_id", "left").fillna(0)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").cast("binary"), 256)
    kinds = written(every.groupBy("length", "kl", "lk").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), digest.alias("ends")).select("conv_id", "length", "weight", "ends"))
    one = turns.join(kinds, "conv_id").select("conv_id", "depth", "k", "l", "chars", "weight", "length", F.when(F.col("depth") == F.col("length"), F.col("ends")).alias("ends"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = written(one.repartitionByRange(parts, "depth", "conv_id").sortWithinPartitions("depth"))
    discard(turns)
    return one, kinds


def _path(combine: Callable[[Column], Column], a: str, b: str) -> Column:
    """Half of the hash of a run of turns."""
    return combine(F.xxhash64("depth", a, b)).alias(a + b)


def _refined(turns: DataFrame, kinds: DataFrame, top: int | None) -> DataFrame:
    """(conv_id, depth, owner, parent, n_convs, n_kinds, chars, length, ends): the nodes of each kind, a turn each, by their owners."""
    columns = ["conv_id", "depth", "owner", "parent", "n_convs", "n_kinds", "chars", "length", "ends"]
    active = kinds.filter("length > 0").select("conv_id", F.lit(top).cast("long").alias("class"))
    rounds: list[DataFrame] = []
    low, stride = 0, 1
    while True:
        high = low + stride
        rows = turns.filter((F.col("depth") > low) & (F.col("depth") <= high)).join(active, "conv_id")
        along = W.partitionBy("conv_id").orderBy("depth")  # of at most ``stride`` turns
        run = along.rowsBetween(W.unboundedPreceding, 0)
        rows = rows.select("*", _path(lambda c: F.bit_xor(c).over(run), "k", "l"), _path(lambda c: F.bit_xor(c).over(run), "l", "k"))
        split = ["class", "depth", "kl", "lk"]
        # stored, so that the join below is between two shuffled tables and a large class's rows can be dealt to several tasks
        classes = written(rows.groupBy(*split).agg(F.min("conv_id").alias("owner"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_kinds")))
        parent = F.coalesce(F.lag("owner").over(along), F.col("class"))
        done = written(rows.join(classes, split).withColumn("parent", parent).select(*columns))
        discard(classes)
        rounds.append(done)
        active = done.filter((F.col("depth") == high) & (F.col("n_kinds") > 1) & (F.col("length") > high)).select("conv_id", F.col("owner").alias("class"))
        if active.isEmpty():
            break
        low, stride = high, min(2 * stride, STRIDE)
    shared = reduce(DataFrame.unionByName, rounds)
    # what follows the last class of a conversation is a chain of nodes of its own
    left = shared.groupBy("conv_id").agg(F.max("depth").alias("seen"))
    tails = turns.join(left, "conv_id").filter("depth > seen").select(
        "conv_id", "depth", F.col("conv_id").alias("owner"), F.col("conv_id").alias("parent"), F.col("weight").alias("n_convs"), F.lit(1).cast("long").alias("n_kinds"), "chars", "length", "ends",
    )
    return shared.unionByName(tails)


def _folded(members: DataFrame) -> DataFrame:
    """What the members tell their nodes of subtrees, to be summed up: (node, at, parent, n_convs, child, leaf, saved, ends).

    Each kind adds up from its last turn back to its first, in blocks, what the nodes that it owns save and whether it ends
    in a leaf; the subtree of a node is what its members have from there on.
    """
    owns = F.col("owner") == F.col("conv_id")
    members = members.withColumns({
        "own": F.when(owns, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0),
        "leaf": ((F.col("n_kinds") == 1) & (F.col("depth") == F.col("length"))).cast("long"),
        "block": F.expr(f"depth div {BLOCK}"),
    })
    sums = members.groupBy("conv_id", "block").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    later = W.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    after = sums.select("conv_id", "block", F.sum("own").over(later).alias("later_own"), F.sum("leaf").over(later).alias("later_leaf")).filter("later_own > 0 OR later_leaf > 0")
    below = W.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    saved = members.withColumns({"own": F.sum("own").over(below), "leaf": F.sum("leaf").over(below)}).join(after, ["conv_id", "block"], "left")
    saved = saved.select("conv_id", "owner", "depth", "parent", "n_convs", "ends", (F.col("own") + F.coalesce("later_own", F.lit(0))).alias("saved"), (F.col("leaf") + F.coalesce("later_leaf", F.lit(0))).alias("leaf"))
    # to its own node, and to the node above: of a child, if it owns that; and of all there is, if that is the root
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    fields = ("node", "at", "parent", "n_convs", "child", "leaf", "saved", "ends")
    row = lambda *values: F.struct(*(v.alias(n) for n, v in zip(fields, values)))
    at_root = F.col("depth") == 1
    told = F.array(
        row(F.col("owner"), F.col("depth"), F.col("parent"), F.col("n_convs"), zero, F.col("leaf"), F.col("saved"), F.col("ends")),
        F.when(owns | at_root, row(F.col("parent"), F.col("depth") - 1, none, none, owns.cast("long"), F.when(at_root, F.col("leaf")).otherwise(0), F.when(at_root, F.col("saved")).otherwise(0), F.lit(None).cast("string"))),
    )
    return saved.select(F.explode(told).alias("t")).filter("t IS NOT NULL").select("t.*")
