"""Exact substring deduplication over a log-structured fingerprint index.

Every window of ``window`` words has an anchor: of the ``anchor`` words long runs in it the one with the least hash, the
first of equals. Equal windows have equal anchors in equal places, so only windows whose anchor occurs twice can occur
twice. Neighbouring windows with the same anchor make one *stretch*, about a fifteenth as many as there are windows.

A batch of documents is added as an immutable run of stretches, with a run of anchors and their counts, sorted by anchor;
count runs are merged into one when there are many of them. Stretches are then joined with the anchors that the merged
runs have at least twice. Stretches that are equal as a whole, shape included, repeat as a whole. Of anchors in different
stretches one stretch of each kind is looked up in its document, and its windows' 128-bit hashes decide one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, written

#: Count runs beyond which they are compacted into one.
FAN_IN = 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Rolling hashes of one text's words, in two streams that come from independent halves of each word's hash."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        power, self.inverse = _power(self.n + 1)
        self.sums = []
        for k in (0, 1):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(halves[:, k] * power[:-1], out=s[1:])
            self.sums.append(s)

    def runs(self, stream: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hash of the words from each start to before its stop; it doesn't depend on where they stand."""
        s = self.sums[stream]
        return _mix((s[stops] - s[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64))


def stretches(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...] | None:
    """(first, last, anchor hash, whole hash): first and last window start of each stretch. None without a window."""
    n = len(words)
    if n < window:
        return None
    h = Hashed(words)
    at = np.arange(n - anchor + 1)
    a = h.runs(0, at, at + anchor)
    wide = window - anchor + 1
    view = np.lib.stride_tricks.sliding_window_view(a, wide)
    least = np.concatenate([view[i : i + 65_536].argmin(1) for i in range(0, len(view), 65_536)]) + np.arange(len(view))
    cuts = np.flatnonzero(np.diff(least)) + 1
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts - 1, [len(least) - 1]))
    place = least[first]
    shape = ((place - first) * 64 + (last - first)).astype(np.uint64)
    whole = _mix(h.runs(1, first, last + window) + shape * np.uint64(_BASE))
    return first, last, a[place].view(np.int64), whole.view(np.int64)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _row(text: bytes | None) -> int:
    """Tells rows of one id with different texts apart."""
    return xxhash.xxh32_intdigest(text or b"") - (1 << 31)


class SubstringIndex:
    """Batches of documents (doc_id, text) and what of them repeats, here or elsewhere."""

    def __init__(self, window: int = 35, anchor: int = 8, fan_in: int = FAN_IN) -> None:
        if not 1 <= anchor <= window <= 64:
            raise ValueError("the anchor must fit the window, and the window 64 words")
        self.window, self.anchor, self.fan_in = window, anchor, fan_in
        self.batches: list[DataFrame] = []
        self.runs: list[DataFrame] = []
        self.counts: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Adds a batch: one run of stretches, one of counted anchors. Null texts are empty."""
        window, anchor = self.window, self.anchor
        kind = docs.schema["doc_id"].dataType
        docs = docs.select("doc_id", "text")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column("doc_id"), b.column("text").cast(pa.large_binary())
                for at in range(0, b.num_rows, 512):
                    took, rows, parts = [], [], []
                    for i in range(at, min(at + 512, b.num_rows)):
                        text = texts[i].as_py()
                        if (found := stretches(_words(text), window, anchor)) is not None:
                            took.append(np.full(len(found[0]), i))
                            rows.append(np.full(len(found[0]), _row(text)))
                            parts.append(found)
                    if parts:
                        first, last, a, whole = (np.concatenate(x) for x in zip(*parts))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(np.concatenate(took))), *(pa.array(x, t) for x, t in ((np.concatenate(rows).astype(np.int32), pa.int32()), (first.astype(np.int32), pa.int32()), ((last - first).astype(np.int8), pa.int8()), (a, pa.int64()), (whole, pa.int64())))],
                            ["doc_id", "row", "first", "more", "anchor", "whole"],
                        )

        found = docs.mapInArrow(scan, f"doc_id {kind.simpleString()}, row int, first int, more tinyint, anchor bigint, whole bigint")
        self.batches.append(docs)
        self.runs.append(written(found))
        self.counts.append(written(self.runs[-1].groupBy("anchor").agg(F.count("*").alias("n")).sortWithinPartitions("anchor")))
        if len(self.counts) > self.fan_in:
            self.compact()

    def _merged(self) -> DataFrame:
        counts = self.counts[0]
        for more in self.counts[1:]:
            counts = counts.unionByName(more)
        return counts if len(self.counts) == 1 else counts.groupBy("anchor").agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        """Merges the count runs into one; runs themselves never change."""
        self.counts = [written(self._merged().sortWithinPartitions("anchor"))]

    def _texts(self) -> DataFrame:
        """(doc_id, row, packed) of all batches; texts are packed before they are shuffled."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdCompressor(level=3)
            for b in batches:
                texts = [t.as_py() or b"" for t in b.column("text").cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(_row, texts), pa.int32(), size=len(texts)), pa.array(map(z.compress, texts), pa.binary(), size=len(texts))], ["doc_id", "row", "packed"])

        out = None
        for docs in self.batches:
            one = docs.mapInArrow(pack, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row int, packed binary")
            out = one if out is None else out.unionByName(one)
        return out

    def repeats(self) -> DataFrame:
        """(doc_id, row, first, mask): bit ``i`` of ``mask`` tells that the window at word ``first + i`` starts elsewhere too."""
        twice = cut(self._merged().filter("n > 1").select("anchor"))
        runs = self.runs[0]
        for more in self.runs[1:]:
            runs = runs.unionByName(more)
        seen = written(runs.join(twice, "anchor"))
        of = ["anchor", "whole"]
        kinds = seen.groupBy(*of).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "first", "more")).alias("one"))
        kinds = written(kinds)
        many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
        looked_up = kinds.join(many, "anchor", "left_semi").select(*of, "n", "one.*")
        windows = written(self._windows(looked_up))
        again = windows.groupBy("h1", "h2").agg(F.sum("n").alias("total")).filter("total > 1").select("h1", "h2")
        some = windows.filter("n = 1").join(again, ["h1", "h2"]).groupBy(*of).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        every = kinds.filter("n > 1").select(*of, F.expr("shiftleft(1L, one.more + 1) - 1").alias("mask"))
        return seen.join(cut(some.unionByName(every)), of).select("doc_id", "row", "first", "mask")

    def _windows(self, stretches_: DataFrame) -> DataFrame:
        """(anchor, whole, n, bit, h1, h2): the windows of one stretch of each kind, hashed from its document."""
        window = self.window
        wanted = stretches_.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "whole", "n", "first", "more")).alias("wanted"))
        wanted = wanted.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
        texts = self._texts().join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).dropDuplicates(["doc_id", "row"]).select("packed", "wanted")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdDecompressor()
            for b in batches:
                for packed, wanted in zip(b.column("packed"), b.column("wanted")):
                    h = Hashed(z.decompress(packed.as_py()).split())
                    v = wanted.values
                    get = {c: v.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "whole", "n", "first", "more")}
                    sizes = get["more"].astype(np.int64) + 1
                    bit = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    at = np.repeat(get["first"].astype(np.int64), sizes) + bit
                    columns = [*(pa.array(np.repeat(get[c], sizes)) for c in ("anchor", "whole", "n")), pa.array(bit.astype(np.int32)), *(pa.array(h.runs(k, at, at + window).view(np.int64)) for k in (0, 1))]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "whole", "n", "bit", "h1", "h2"])

        return texts.mapInArrow(hashed, "anchor bigint, whole bigint, n bigint, bit int, h1 bigint, h2 bigint")

    def kept(self) -> DataFrame:
        """(doc_id, n_words, n_removed, text) for each row added: all words that no repeated window covers, joined by one space."""
        window = self.window
        marks = self.repeats().groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "mask")).alias("marks")).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
        joined = self._texts().join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "packed", "marks")
        kind = self.batches[0].schema["doc_id"].dataType.simpleString()

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdDecompressor()
            bits = np.arange(64)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    total, gone, texts = [], [], []
                    for packed, marks in zip(b.column("packed"), b.column("marks")):
                        words = z.decompress(packed.as_py()).split()
                        total.append(len(words))
                        if marks.is_valid:
                            v = marks.values
                            on = (v.field("mask").to_numpy(zero_copy_only=False)[:, None] >> bits) & 1
                            starts = (v.field("first").to_numpy(zero_copy_only=False).astype(np.int64)[:, None] + bits)[on.astype(bool)]
                            edge = np.zeros(len(words) + 1, np.int64)
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + window, -1)
                            covered = np.cumsum(edge[:-1]) > 0
                            gone.append(int(covered.sum()))
                            words = [words[i] for i in np.flatnonzero(~covered)]
                        else:
                            gone.append(0)
                        texts.append(b" ".join(words))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

        return joined.mapInArrow(drop, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")


def remove_repeats(docs: DataFrame, window: int = 35, batches: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text) of each row of ``docs``, added to an empty index in ``batches`` by hash of the id.

    A null id is a value like others. Two rows that are alike repeat each other, so all their windows go.
    """
    index = SubstringIndex(window)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for k in range(batches):
        index.add(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index.kept()
