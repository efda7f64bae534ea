"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by the first bits of a hash of each row. All rows begin in one shard of no bits; a shard over the byte
limit splits on one more bit, and only such a shard does, until every one fits. The first splits are looked up in one
histogram over as many bits as most shards will have; what is still too large there is split on bit by bit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Bits of a hash that shards may use; rows whose bits are all equal are told apart by their number.
MAX_DEPTH = 60
#: Bits of the histogram beyond those that equally large shards would have.
SPARE_BITS = 2


def hash_bits(*columns: Column) -> Column:
    """The first 60 bits of an MD5 hash, as a long that isn't negative: the same in any engine."""
    text = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int, h: str = "h") -> Column:
    return F.shiftright(F.col(h), MAX_DEPTH - depth)


def directory(sizes: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(owner, prefix, depth, n_rows, bytes), and the bits of the histogram: the shards of each owner's rows (owner, h, bytes), of at
    most ``limit`` bytes each.

    A shard of one row may be larger, as a row isn't divided, and so may one whose rows all have the same hash. Sums are
    formed before anything is shuffled, and beyond the histogram only rows of shards that were too large are looked at.
    """
    most = sizes.groupBy("owner").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] or 0
    fine = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, most / limit)))) + SPARE_BITS)
    sums = lambda df, *by: df.groupBy("owner", *by).agg(F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = sizes.withColumns({"n_rows": F.lit(1).cast("long"), "lo": F.col("h"), "hi": F.col("h")})
    over = (F.col("bytes") > limit) & (F.col("lo") < F.col("hi"))
    histogram = cut(sums(rows, _prefix(fine).alias("prefix")))
    levels = histogram.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(fine)))).withColumn("prefix", F.expr(f"shiftright(prefix, {fine} - depth)"))
    levels = cut(sums(levels, "depth", "prefix").withColumn("over", over))
    # a shard is what fits, or holds one hash, below what is over
    above = levels.filter("over").select("owner", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_p"))
    children = above.select("owner", "depth", F.explode(F.array(F.col("_p") * 2, F.col("_p") * 2 + 1)).alias("prefix"))
    fitting = levels.filter("NOT over")
    columns = ["owner", "prefix", "depth", "n_rows", "bytes"]
    done = [fitting.filter("depth = 0").select(*columns), fitting.join(children, ["owner", "depth", "prefix"], "left_semi").select(*columns)]
    depth, large = fine, levels.filter(F.col("over") & (F.col("depth") == fine)).select("owner", F.col("prefix").alias("_p"))
    while depth < MAX_DEPTH and not large.isEmpty():
        rows = rows.join(large, (rows["owner"] == large["owner"]) & (_prefix(depth) == F.col("_p")), "left_semi")
        depth += 1
        split = cut(sums(rows, _prefix(depth).alias("prefix")).withColumns({"over": over if depth < MAX_DEPTH else F.lit(False), "depth": F.lit(depth)}))
        done.append(split.filter("NOT over").select(*columns))
        large = split.filter("over").select("owner", F.col("prefix").alias("_p"))
    return reduce(DataFrame.unionByName, done), fine


def shard(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_bytes, shard, depth, shard_rows, shard_bytes): each row with its shard's bits (empty at depth 0).

    A row's bytes are those of its text in UTF-8, null as none. Rows are placed by the hash of their id, so rows of one
    id share a shard unless that is too large for them; then they are split, in the same way, by the hash of id, text and, for
    equal ones, number, into shards named after the bits with ``-`` and a second set of bits. So only a single row is ever over
    the limit. No rows make no shards. Other columns of ``docs``, whatever their names, are passed over.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("row_bytes"), hash_bits(F.col(doc_id)).alias("h"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rows = cut(rows.withColumns({"number": F.monotonically_increasing_id(), "owner": F.lit("")}))
    placed = _place(rows, *directory(rows.select("owner", "h", F.col("row_bytes").alias("bytes")), limit))
    columns = ["doc_id", "row_bytes", "shard", "depth", "shard_rows", "shard_bytes"]
    # what is left over the limit after all bits: many rows of one hash
    alike = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    same = placed.filter(alike)
    if same.isEmpty():
        return placed.select(*columns)
    again = cut(same.select("doc_id", "row_bytes", "t", "number", F.col("shard").alias("owner"), hash_bits(F.col("doc_id"), F.col("t"), F.col("number")).alias("h")))
    split = _place(again, *directory(again.select("owner", "h", F.col("row_bytes").alias("bytes")), limit))
    split = split.withColumns({"shard": F.concat("owner", F.lit("-"), "shard"), "depth": F.length("owner") + F.col("depth")})
    return placed.filter(~alike).select(*columns).unionByName(split.select(*columns))


def _place(rows: DataFrame, found: DataFrame, fine: int) -> DataFrame:
    """Joins each row to its shard through a directory of ``fine`` bits: a shard of fewer bits has several entries, and of several
    shards below one entry a row takes the one with its bits."""
    entry = F.when(F.col("depth") <= fine, F.sequence(F.expr(f"shiftleft(prefix, greatest({fine} - depth, 0))"), F.expr(f"shiftleft(prefix + 1, greatest({fine} - depth, 0)) - 1")))
    entries = found.withColumn("_entry", F.explode(entry.otherwise(F.array(F.expr(f"shiftright(prefix, greatest(depth - {fine}, 0))")))))
    # stored, so that the rows of a large id can be dealt to several tasks in the join
    below = cut(entries.groupBy(F.col("owner").alias("_owner"), "_entry").agg(F.collect_list(F.struct("prefix", "depth", "n_rows", "bytes")).alias("_shards")))
    joined = rows.join(below, (F.col("owner") == F.col("_owner")) & (_prefix(fine) == F.col("_entry")))
    own = joined.withColumn("s", F.expr(f"filter(_shards, s -> shiftright(h, {MAX_DEPTH} - s.depth) = s.prefix)[0]"))
    name = F.when(F.col("s.depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("s.prefix").cast("string"), 10, 2), F.col("s.depth"), F.lit("0")))
    return own.select("doc_id", "row_bytes", "h", "t", "number", "owner", name.alias("shard"), F.col("s.depth").alias("depth"), F.col("s.n_rows").alias("shard_rows"), F.col("s.bytes").alias("shard_bytes"))
