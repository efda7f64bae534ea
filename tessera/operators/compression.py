"""Compressed chunks: rows of a segment in batches of arrays, with the least and greatest of what they are ordered by.

Rows of one chunk of time and one segment are put in order and cut into batches of up to ``BATCH`` rows. A batch is one
row: its segment, how many rows it has, least and greatest value of each ordering column, times as microseconds since the batch's
first, and every other column as an array. A reader's conditions on time are said to the batches' bounds first, and so to
the Parquet scan, before any array is opened. Rows that arrive in a compressed chunk lie beside it uncompressed until it is
compressed again; only chunks with such rows are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.functions.time import minus, plus, time_bucket
from tessera.operators.runs import numbered

#: Rows of a batch.
BATCH = 1_000


@dataclass(frozen=True)
class Layout:
    """What a table's compression is declared by: time column, chunk interval, segment columns, (column, descending) to order by.

    Without an ordering column it is the time, newest first. Times are in the table's time zone, without one.
    """

    ts: str
    chunk: str = "7 days"
    segment_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    batch: int = BATCH

    @property
    def ordering(self) -> tuple[tuple[str, bool], ...]:
        return self.order_by or ((self.ts, True),)

    @property
    def bounded(self) -> list[str]:
        """Columns whose bounds a batch has: the time and what it is ordered by."""
        return list(dict.fromkeys((self.ts, *(c for c, _ in self.ordering))))

    @classmethod
    def declared(cls, catalog, schema: str, table: str, batch: int = BATCH) -> Layout:
        """Of a table of a catalog, which must be a hypertable with compression."""
        hyper, rule = catalog.find("hypertables", schema=schema, table=table), catalog.find("compression", schema=schema, table=table)
        if hyper is None or rule is None:
            raise ValueError(f"{schema}.{table} is no hypertable with compression")
        order = []
        for o in rule.get("order_by") or ():
            name, *words = o.split() if isinstance(o, str) else (o["column"], o.get("direction") or "")
            order.append((name, " ".join(words).upper().startswith("DESC")))
        return cls(hyper["time_column"], hyper.get("chunk_interval") or "7 days", tuple(rule.get("segment_by") or ()), tuple(order), batch)


def compress(df: DataFrame, layout: Layout) -> DataFrame:
    """Batches (chunk, segment columns, batch from 0, n, min_c and max_c of bounded columns, ts as first and offsets, other columns as arrays).

    Rows without a time are a chunk of their own, whose chunk is null. Rows that the ordering doesn't tell apart are ordered
    by their other columns, which must be of types that have an order. A chunk's segment is put in order by parts of its time, a sixteenth of the chunk each, where the
    time leads the ordering, so a segment with very many rows is many tasks' work.
    """
    ts, segment = layout.ts, list(layout.segment_by)
    values = [c for c in df.columns if c not in segment]
    rows = df.withColumn("chunk", time_bucket(layout.chunk, ts))
    rest = [c for c in values if c not in {c for c, _ in layout.ordering}]
    order = [*(F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in layout.ordering), *(F.col(c).asc_nulls_first() for c in rest)]
    first, descending = layout.ordering[0]
    step = F.floor(F.timestamp_diff("MICROSECOND", F.col("chunk"), F.col(ts).cast("timestamp_ntz")) * 16 / F.timestamp_diff("MICROSECOND", F.col("chunk"), plus(F.col("chunk"), layout.chunk)))
    placed = numbered(rows, ["chunk", *segment], (-step if descending else step) if first == ts else F.lit(0), order, "_n")
    placed = placed.withColumn("batch", F.expr(f"(_n - 1) div {layout.batch}")).withColumn("_micros", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts).cast("timestamp_ntz")))
    bounds = [f(c).alias(f"{n}_{c}") for c in layout.bounded for n, f in (("min", F.min), ("max", F.max))]
    others = [c for c in values if c != ts]
    batches = placed.groupBy("chunk", *segment, "batch").agg(F.count("*").alias("n"), *bounds, F.array_sort(F.collect_list(F.struct("_n", "_micros", *(F.col(c).alias(f"v{i}") for i, c in enumerate(others))))).alias("_rows"))
    batches = batches.withColumn("_first", F.array_min("_rows._micros"))
    return batches.select(
        "chunk", *segment, "batch", "n", *(f"{n}_{c}" for c in layout.bounded for n in ("min", "max")),
        F.struct(F.col("_first").alias("first"), F.transform("_rows._micros", lambda t: t - F.col("_first")).alias("offsets")).alias(ts), *(F.col(f"_rows.v{i}").alias(c) for i, c in enumerate(others)),
    )


def decompress(batches: DataFrame, layout: Layout, columns: Sequence[str], kinds: dict[str, str] | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The rows of ``batches`` with ``columns``; with bounds those of ``[since, until)``, from batches that may have such rows.

    Only asked columns' arrays are read. ``kinds`` gives the time column its type, without a time zone if it says nothing.
    """
    ts = layout.ts
    opened = may_have(batches, layout, since, until)
    at = F.timestamp_add("MICROSECOND", F.col(f"{ts}.first"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    others = [c for c in columns if c not in layout.segment_by and c != ts]
    zipped = opened.select(*layout.segment_by, at.alias("_at"), F.explode(F.arrays_zip(F.col(f"{ts}.offsets").alias("offset"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(others)))).alias("_r"))
    rows = zipped.select(*layout.segment_by, F.timestamp_add("MICROSECOND", F.col("_r.offset"), F.col("_at")).cast((kinds or {}).get(ts, "timestamp_ntz")).alias(ts), *(F.col(f"_r.v{i}").alias(c) for i, c in enumerate(others)))
    if since is not None:
        rows = rows.filter(F.col(ts) >= since)
    if until is not None:
        rows = rows.filter(F.col(ts) < until)
    return rows.select(*columns)


def may_have(batches: DataFrame, layout: Layout, since: Column | None, until: Column | None) -> DataFrame:
    """Batches whose bounds don't rule out a time in ``[since, until)``."""
    if since is not None:
        batches = batches.filter(F.col(f"max_{layout.ts}") >= since)
    return batches if until is None else batches.filter(F.col(f"min_{layout.ts}") < until)


@dataclass(frozen=True)
class CompressedTable:
    """A table in a folder: ``batches`` by chunk, and ``fresh``, rows that no batch has yet, by chunk as well."""

    spark: SparkSession
    path: str
    layout: Layout

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema/{what}").schema).parquet(f"{self.path}/{what}")

    def create(self, empty: DataFrame) -> None:
        """An empty table with the columns of ``empty``."""
        rows, batches = self._by_chunk(empty.limit(0)), self._renamed(compress(empty.limit(0), self.layout))
        for what, df in (("fresh", rows), ("batches", batches)):
            df.write.parquet(f"{self.path}/schema/{what}")
            df.write.partitionBy("_chunk").parquet(f"{self.path}/{what}")

    def _by_chunk(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_chunk", F.date_format(time_bucket(self.layout.chunk, self.layout.ts), "yyyy-MM-dd HH.mm.ss"))

    @staticmethod
    def _renamed(batches: DataFrame) -> DataFrame:
        return batches.withColumn("_chunk", F.date_format("chunk", "yyyy-MM-dd HH.mm.ss")).drop("chunk")

    def insert(self, rows: DataFrame) -> None:
        """Rows go beside the batches, into whatever chunk they lie in. One writer at a time."""
        self.recover()
        self._by_chunk(rows).write.mode("append").partitionBy("_chunk").parquet(f"{self.path}/fresh")

    def compress(self, as_of: Column | None = None, compress_after: str | None = None) -> list[str]:
        """Compresses chunks that have fresh rows and, if there is an age, end that long before ``as_of``; returns these chunks.

        A chunk's batches are written anew from its batches and its fresh rows. Batches are replaced before fresh rows go, and
        the new ones are complete before they replace any, so what is broken off after that point is finished by ``recover``.
        """
        self.recover()
        fresh = self._read("fresh")
        chunk = F.to_timestamp_ntz("_chunk", F.lit("yyyy-MM-dd HH.mm.ss"))
        due = fresh.select("_chunk").distinct()
        if compress_after is not None:
            due = due.filter(plus(chunk, self.layout.chunk) <= minus(as_of, compress_after))
        chunks = sorted(r["_chunk"] for r in due.filter("_chunk IS NOT NULL").collect())  # one for each chunk of time
        if not chunks:
            return []
        here = F.col("_chunk").isin(chunks)
        columns = [c for c in fresh.columns if c != "_chunk"]
        old = decompress(self._read("batches").filter(here), self.layout, columns, {self.layout.ts: fresh.schema[self.layout.ts].dataType.simpleString()})
        new = self._renamed(compress(old.unionByName(fresh.filter(here).select(*columns)), self.layout))
        new.write.mode("overwrite").partitionBy("_chunk").parquet(f"{self.path}/next")
        storage.rename(self.spark, f"{self.path}/next", f"{self.path}/ready")
        self.recover()
        return chunks

    def recover(self) -> None:
        """Finishes a compression that had written all its batches; does nothing otherwise."""
        ready = f"{self.path}/ready"
        if not storage.exists(self.spark, ready):
            return
        new = self.spark.read.schema(self._read("batches").schema).parquet(ready)
        chunks = sorted(r["_chunk"] for r in new.select("_chunk").distinct().collect())
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_chunk").parquet(f"{self.path}/batches")
        for c in chunks:
            storage.remove(self.spark, f"{self.path}/fresh/_chunk={c}")
        storage.remove(self.spark, ready)

    def batches(self) -> DataFrame:
        return self._read("batches")

    def read(self, columns: Sequence[str] | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """All rows, compressed or not, or those of ``[since, until)``."""
        fresh = self._read("fresh")
        columns = list(columns or (c for c in fresh.columns if c != "_chunk"))
        packed = decompress(self._read("batches"), self.layout, columns, {self.layout.ts: fresh.schema[self.layout.ts].dataType.simpleString()}, since, until)
        if since is not None:
            fresh = fresh.filter(F.col(self.layout.ts) >= since)
        if until is not None:
            fresh = fresh.filter(F.col(self.layout.ts) < until)
        return packed.unionByName(fresh.select(*columns))
