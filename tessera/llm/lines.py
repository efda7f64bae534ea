"""Line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, ascii_lower, cut, hash128


def line_key(line: Column) -> Column:
    """What lines are compared by: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and with ``n_lines`` (before) and ``n_dropped`` (both long).

    Lines are what lies between line feeds; a null or empty text has one empty line and comes out empty. A key of at
    least ``min_chars`` code points that at least ``min_docs`` different ids hold goes from every document but that
    with the largest id, which keeps all its lines. Rows with one id count as one document; a null id counts as none
    and keeps no such line. Every row gives a row, repeated ones too. Input columns named ``n_lines`` or ``n_dropped``
    are replaced.

    Counting goes over (hash, id) first and over the hash after that, so a line that a third of all documents share
    reaches its last task as one row from each task before. Only hashes and positions are shuffled by line; whole texts
    meet their dropped positions once.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(content).alias("_row"), F.split(content, "\n", -1).alias("_lines"))
    keys = rows.select("_id", "_row", F.posexplode("_lines").alias("_at", "_line")).select("_id", "_row", "_at", line_key(F.col("_line")).alias("_key"))
    h1, h2 = hash128(F.col("_key"))
    hashed = keys.filter(F.length("_key") >= min_chars).select("_id", "_row", "_at", h1.alias("_h1"), h2.alias("_h2"))
    holders = hashed.filter(F.col("_id").isNotNull()).select("_h1", "_h2", "_id").distinct()
    # stored, so that the join below takes it from a shuffle of its own, and Spark can split a hot line's partition
    repeated = cut(holders.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_id").alias("_last")).filter(F.col("_n") >= min_docs).drop("_n"))
    dropped = (
        hashed.join(repeated, ["_h1", "_h2"]).filter(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy(F.col("_id").alias("_did"), F.col("_row").alias("_drow")).agg(F.collect_set("_at").alias("_gone"))
    )
    lined = docs.select(*kept, F.xxhash64(content).alias("_row"))
    joined = lined.join(dropped, lined[doc_id].eqNullSafe(dropped["_did"]) & (lined["_row"] == dropped["_drow"]), "left")
    # the array of lines is bound once by the outer function, so that each line is reached in one step
    at = F.col("_gone")
    kept_of = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), at), lambda i: F.get(ls, i)), "\n")
    left = F.get(F.transform(F.array(F.split(content, "\n", -1)), kept_of), F.lit(0))
    n_lines = F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    joined = joined.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    return joined.withColumn(text, F.when(at.isNull(), content).otherwise(left)).select(*kept, "n_lines", "n_dropped")
