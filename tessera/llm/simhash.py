"""SimHash near-duplicate groups, with candidates by the general pigeonhole principle (Qin et al., 2018).

Fingerprints are split into parts of correlated bits. A pair within ``radius`` bits must be within ``t[i]`` bits in
some part ``i`` whenever the ``t[i] + 1`` add up to ``radius + 1``; parts may get unequal thresholds, and -1 leaves a part
out. A dynamic programme chooses them by the candidates that each threshold is estimated to bring. A bucket that is
too large for pairwise verification is resolved by midpoints instead, which is exact and linear in the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, release, small_batches, written
from tessera.llm.components import connected_components

BITS = 64
SEED = 42
#: Fingerprints that the correlation of bits and the sizes of buckets are estimated from; results don't depend on it.
SAMPLE_ROWS = 20_000
#: Up to so many fingerprints in one bucket are compared pairwise, above it midpoints are used. Both ways are exact.
PAIRWISE_BUCKET = 64
#: One more rare shingle that similar texts share for so many shingles of a text.
SHARED_OF = 20
#: Rows of an Arrow batch while texts are read for their shingles, and bytes of sets that are handed on at once.
BATCH_ROWS, SET_BYTES = 1_000, 4 << 20
#: Hashes of words, for all bands of a text together, that are looked at at once.
WORDS_AT_ONCE = 1 << 16
#: So many rows of ids and hashes at most are broadcast, beyond it the join with them is shuffled.
BROADCAST_ROWS = 1 << 20
#: A shingle that COMMON_TEXTS of about COMMON_SAMPLE texts have is looked up last, at most COMMON_SHINGLES are.
#: They tell the order of shingles only, so results don't depend on them.
COMMON_SAMPLE, COMMON_TEXTS, COMMON_SHINGLES = 8_000, 4, 100_000
#: Shingles of so many unlinked nodes at least are listed with each node, if it has no more than MOST_HOTS of them. Both ways are exact.
HOT_KEY, MOST_HOTS = 32, 256



def majority(hashes: np.ndarray) -> np.ndarray:
    """For each row of 64-bit hashes the value whose bits are those that more than half of the row's hashes have set.

    Bits are counted in bytes over blocks of 255 hashes, so that no byte overflows; long rows take a block of blocks at once.
    """
    rows, n = hashes.shape
    counts = np.zeros((rows, BITS), np.int64)
    for at in range(0, n, 255 * 64):
        some = np.ascontiguousarray(hashes[:, at : at + 255 * 64], "<u8")
        m = some.shape[1]
        bits = np.unpackbits(some.view(np.uint8).reshape(rows, m, 8), axis=2, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, m, 255), axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by one space; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)]), ">u8").astype(np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """Bytes make it exact: ``lower`` changes A-Z alone and ``split`` takes the ASCII white space alone."""
    return (text or b"").lower().split()


def fingerprint(text: bytes | None, width: int) -> int:
    """Unsigned SimHash of one text's shingles, repeats included; zero for a text without words."""
    hashes = shingle_hashes(words_of(text), width)
    return int(majority(hashes[None, :])[0]) if len(hashes) else 0


def word_set_fingerprints(words: list[bytes], bands: int) -> np.ndarray:
    """Independent SimHashes over the set of words. A text with a few words edited keeps most of its set, so that its
    fingerprints stay within a few bits, which those over long shingles don't."""
    if not words:
        return np.zeros(bands, np.uint64)
    distinct = set(words)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, distinct)), np.uint64)
    out = np.zeros(bands, np.uint64)
    step = max(1, min(bands, WORDS_AT_ONCE // len(h)))
    for at in range(0, bands, step):  # of a very long text, one after the other
        x = h[None, :] + np.arange(at + 1, min(at + step, bands) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[at : at + step] = majority(x ^ (x >> np.uint64(31)))
    return out


def _texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())


def with_fingerprint(docs: DataFrame, width: int, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` without the text and with a long column: the bits of each text's fingerprint. A null text is empty."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), width) for t in _texts(b, text)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(got.view(np.int64))], [*kept, out])

    return docs.mapInArrow(run, schema)


# ---- parts and thresholds


def correlated_parts(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits grouped into parts of nearly equal size, each next to the bits that it correlates with most."""
    if len(sample) < 2:
        return [list(map(int, x)) for x in np.array_split(np.arange(BITS), parts)]
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0))
    norm[norm == 0] = 1
    corr = np.abs(bits.T @ bits) / np.outer(norm, norm)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for size in (len(x) for x in np.array_split(np.arange(BITS), parts)):
        part = [max(left, key=lambda i: corr[i].sum())]
        left.discard(part[0])
        while len(part) < size:
            best = max(left, key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def _bits_of(values: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for k, i in enumerate(part):
        out |= ((values >> np.uint64(i)) & np.uint64(1)) << np.uint64(k)
    return out


def allocate(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds from -1 up, one for each part, whose ``t + 1`` add up to ``radius + 1`` at least total cost.

    ``costs[i][t + 1]`` is the estimated number of candidates of part ``i`` at threshold ``t``.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t1, more in enumerate(cost):
                if used + t1 <= radius + 1 and ((k := used + t1) not in step or c + more < step[k][0]):
                    step[k] = (c + more, [*ts, t1 - 1])
        best = step
    return best[radius + 1][1]


def plan(sample: np.ndarray, total: int, radius: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds: the number of parts, too, is the one with least estimated candidates plus probes."""
    found = []
    for m in range(max(1, (radius + 2) // 2), radius + 2):
        parts = correlated_parts(sample, m)
        costs = []
        for part in parts:
            row, scale = [0.0], total / max(1, len(sample))
            keys, counts = np.unique(_bits_of(sample, part), return_counts=True)
            exact = float((counts.astype(np.float64) * np.maximum(counts * scale - 1, 0)).sum()) * scale
            uniform = total * total / 2.0 ** len(part)
            for t in range(min(radius, 2) + 1):
                near = sum(float(_choose(len(part), k)) for k in range(t + 1))
                row.append(max(exact, uniform) * near + total * near)
            costs.append(row)
        ts = allocate(costs, radius) if sum(len(c) - 1 for c in costs) > radius else None
        if ts is not None:
            found.append((sum(c[t + 1] for c, t in zip(costs, ts)), parts, ts))
    return min(found, key=lambda x: x[0])[1:]


def _choose(n: int, k: int) -> int:
    return 1 if k == 0 else n * _choose(n - 1, k - 1) // k


def _mask(bits: list[int]) -> int:
    m = sum(1 << i for i in bits)
    return m - (1 << 64) if m >> 63 else m


def _variants(value: Column, part: list[int], flips: int) -> Column:
    """All values within ``flips`` flipped bits of ``part``, as an array."""
    masks = [_mask(list(c)) for k in range(flips + 1) for c in combinations(part, k)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame, radius: int = 2, sample_rows: int = SAMPLE_ROWS, pairwise: int = PAIRWISE_BUCKET) -> DataFrame:
    """(band, a, b) with ``a < b``: enough edges to connect all fingerprints of a band that differ in at most ``radius``
    bits, and none between others. ``prints`` has distinct rows of (band, fp).

    Small buckets: probe, then verify by the count of differing bits. Large buckets: all that lie in one or probe it
    send out every value within ``radius / 2`` bits; two fingerprints share such a midpoint exactly if they are
    within ``radius`` bits, so each midpoint's fingerprints are joined to the least of them.
    """
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    total = prints.filter("band = 0").count()
    picked = prints.filter("band = 0").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).select("fp").collect()
    parts, ts = plan(np.array([r[0] for r in picked], np.int64).view(np.uint64), total, radius)
    used = [(i, p, t) for i, (p, t) in enumerate(zip(parts, ts)) if t >= 0]
    fp = F.col("fp")

    def keys(variants: bool) -> DataFrame:
        each = [F.transform(_variants(fp.bitwiseAND(_mask(p)), p, t if variants else 0), lambda k, i=i: F.struct(F.lit(i).alias("part"), k.alias("key"))) for i, p, t in used]
        return prints.select("band", "fp", F.explode(F.concat(*each)).alias("k")).select("band", "k.part", "k.key", "fp")

    on = ["band", "part", "key"]
    stored, probes = keys(False), keys(True)
    large = cut(stored.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > pairwise).select(on))
    near = (
        stored.join(large, on, "left_anti").withColumnRenamed("fp", "x")
        .join(probes.withColumnRenamed("fp", "y"), on)
        .filter((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius))
        .select("band", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    touched = probes.join(large, on, "left_semi").select("band", "fp").distinct()
    spread = touched.select("band", "fp", F.explode(_variants(fp, list(range(BITS)), radius // 2)).alias("mid"))
    least = spread.groupBy("band", "mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = spread.join(least, ["band", "mid"]).filter("fp != a").select("band", "a", F.col("fp").alias("b"))
    return near.unionByName(shared).distinct()


def fingerprint_components(docs: DataFrame, width: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints are linked by steps of ``radius`` bits or less.

    ``component_id`` is the least id reachable, the document itself included. Texts without words have fingerprint zero
    and are linked like any other. Every input row gives a row; repeated rows give repeated rows. A null id can't be
    the least unless the group has no other. Only distinct fingerprints are compared, so copies cost nothing more.
    """
    prints = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width))
    distinct = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select(F.lit(0).alias("band"), "fp"), radius))
    # the least id of each component, from one row for each fingerprint
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = classed.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(by_print, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


# ---- near-duplicates by verified similarity


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that many sampled texts have, and how many. Results don't depend on the sample."""
    total = rows.count()
    million = 1_000_000
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < math.ceil(million * min(1.0, COMMON_SAMPLE / max(1, total))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in _texts(b, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(words_of(t.as_py()), width)).view(np.int64))], ["h"])

    counts = some.mapInArrow(sets, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_TEXTS)
    got = counts.orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toArrow()
    h, n = (got.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def least_shared(n: int | Column) -> int | Column:
    """How many rare shingles a text of ``n`` shingles shares with every text that is similar enough to it, at least."""
    return 1 + (F.floor(n / SHARED_OF) if isinstance(n, Column) else n // SHARED_OF)


def rare_shingles(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + k`` of the ``n`` distinct, sorted ``hashes``, in an order that all texts share:
    those that aren't common first. Similar sets share ``similarity * n`` at least, and all but ``n - k`` of these stand
    here; so two sets that are similar enough have the lesser ``k`` of both (``least_shared``) in common here."""
    if not len(hashes):
        return hashes
    known, counts = common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        weight = np.where(known[at] == hashes, counts[at], 0)
        hashes = hashes[np.lexsort((hashes, weight))]
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + least_shared(len(hashes))]


def _broadcast_few(df: DataFrame, rows: int) -> DataFrame:
    """A hint for tables of short rows, of which ``rows`` were counted; beyond the bound the join is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sizes_fit(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def sketches(rows: DataFrame, width: int, similarity: float, bands: int) -> DataFrame:
    """(row, doc_id, text_hash, node, n, prints, rare) of (doc_id, text, text_hash).

    ``node`` is a hash of the words, ``n`` the number of shingles, ``prints`` the fingerprints of the bands and ``rare`` the
    shingles that the text is looked up by. A task gives the last two once for each node that it meets.
    """
    common = common_shingles(rows, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                nodes, prints, sizes, rare = [], [], [], []
                for t in _texts(b, "text"):
                    words = words_of(t.as_py())
                    node = xxhash.xxh3_128_digest(b" ".join(words))
                    nodes.append(node)
                    if node in met:
                        prints.append(None)
                        sizes.append(None)
                        rare.append(None)
                        continue
                    met.add(node)
                    hashes = np.unique(shingle_hashes(words, width))
                    prints.append(word_set_fingerprints(words, bands).view(np.int64))
                    sizes.append(len(hashes))
                    rare.append(rare_shingles(hashes, common, similarity).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(rare, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "node", "n", "prints", "rare"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    with small_batches(rows.sparkSession):
        found = rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, node binary, n int, prints array<bigint>, rare array<bigint>")
        return written(found.withColumn("row", F.monotonically_increasing_id()))


def same_band_pairs(distinct: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): candidates by the fingerprints of ``prints``, through representatives, so linear in a group's size."""
    banded = distinct.select("rep", "n", F.posexplode("prints").alias("band", "fp"))
    # one representative for each fingerprint; the other nodes that have it are candidates with that one
    firsts = cut(banded.groupBy("band", "fp").agg(F.min("rep").alias("first"), F.min_by("n", "rep").alias("m")))
    same_print = banded.join(firsts, ["band", "fp"]).filter((F.col("rep") != F.col("first")) & _sizes_fit(F.col("n"), F.col("m"), similarity)).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    found = links(firsts.select("band", "fp"), radius)
    end = lambda fp, x: firsts.select("band", F.col("fp").alias(fp), F.col("first").alias(x), F.col("m").alias(f"n_{x}"))
    near = found.join(end("a", "x"), ["band", "a"]).join(end("b", "y"), ["band", "b"]).filter((F.col("x") != F.col("y")) & _sizes_fit(F.col("n_x"), F.col("n_y"), similarity))
    return same_print.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def mixed_keys(nodes: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, n, pos): the rare shingles that nodes of different groups share, with those nodes.

    Of each shingle only its hash and the least and the greatest of its groups are shuffled; what is left is few. A node
    that several tasks have met counts by its first row, which is its ``rep``.
    """
    listed = nodes.filter(F.col("rare").isNotNull())
    again = cut(listed.select("node", "row").join(distinct.select("node", "rep"), "node").filter("row != rep").select("row"))
    own = listed.join(_broadcast_few(again, again.count()), "row", "left_anti").select(F.col("row").alias("rep"), "n", "rare")
    linked = cut(roots.select(F.col("node").alias("rep"), F.xxhash64("root").alias("group")))
    grouped = own.select("rep", "rare").join(_broadcast_few(linked, linked.count()), "rep", "left").select("rare", F.coalesce("group", F.xxhash64("rep")).alias("group"))
    both = grouped.select(F.explode("rare").alias("key"), "group").groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
    both = cut(both)
    release(nodes.sparkSession)
    placed = own.select("rep", "n", F.posexplode("rare").alias("pos", "key"))
    # joined in the same way at every size: such keys are as many as the texts are long, so a broadcast of them has no bound
    return written(placed.join(both, "key").select("key", "rep", "n", "pos"))


def _rooted(mixed: DataFrame, roots: DataFrame) -> DataFrame:
    """``mixed`` with each node's root, where a key still has several, and ``nth``, how many such keys a node has before it.

    Keys of at least ``HOT_KEY`` nodes come with their node's such keys and the places of these, ``hots`` and ``spots``, so that two
    nodes that have many of them in common can meet in the first alone; not for nodes with over ``MOST_HOTS``.
    """
    rooted = mixed.join(_broadcast_few(roots.withColumnRenamed("node", "rep"), roots.count()), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    several = cut(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("key", (F.col("m") >= HOT_KEY).alias("hot")))
    left = rooted.join(_broadcast_few(several, several.count()), "key")
    left = written(left.withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("pos")) - 1))
    hot = left.filter("hot").groupBy("rep").agg(F.count("*").alias("c"), F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("h")).filter(F.col("c") <= MOST_HOTS)
    hot = cut(hot.select(F.col("rep").alias("_rep"), F.col("h.key").alias("hots"), F.col("h.pos").alias("spots")))
    return left.join(_broadcast_few(hot, hot.count()), (F.col("rep") == F.col("_rep")) & F.col("hot"), "left").drop("_rep")


def _fits(similarity: float) -> Column:
    """Whether ``x`` and ``y`` (n, pos, nth), which have a key in common, may be similar by their sizes and the place of that key:
    before it they share at most as many as either shares with any other group, after it at most what follows in both."""
    n, m = F.col("x.n"), F.col("y.n")
    most = 1 + F.least("x.nth", "y.nth") + F.least(n - F.col("x.pos") - 1, m - F.col("y.pos") - 1)
    return _sizes_fit(n, m, similarity) & (most * (1 + similarity) >= similarity * (n + m) - 1e-6)


def star_pairs(rooted: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the least node of each rare shingle with those others that have it, may be similar and aren't in its group:
    no more rows than the shingles have, however large their groups are."""
    one = rooted.groupBy("key").agg(F.min(F.struct("rep", "n", "pos", "nth", "root")).alias("c")).select("key", "c.*")
    rows = rooted.alias("x").join(one.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _fits(similarity))
    return rows.select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).distinct()


def unlinked_pairs(rooted: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all nodes of different groups that share as many rare shingles as similar ones do, which are counted before
    anything of their texts is looked at; beyond their last common shingle they share at most what follows in both."""
    n, m = F.col("x.n"), F.col("y.n")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.rep") > F.col("y.rep"))
    common = F.array_intersect("x.hots", "y.hots")  # in the order that all texts share; null unless both have them
    first = F.coalesce(F.get(common, F.lit(0)) == F.col("x.key"), F.lit(True))
    rows = rooted.alias("x").join(rooted.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & _fits(similarity) & first).withColumn("common", common)
    last = lambda side: F.coalesce(F.get(F.col(f"{side}.spots"), (F.array_position(F.col(f"{side}.hots"), F.element_at("common", -1)) - 1).cast("int")), F.col(f"{side}.pos"))
    counted = rows.groupBy(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).agg(
        F.sum(F.when(F.col("common").isNull(), 1).otherwise(F.size("common"))).alias("shared"), F.max(n).alias("n"), F.max(m).alias("m"), F.min(n - last("x") - 1).alias("p"), F.min(m - last("y") - 1).alias("q")
    )
    enough = F.col("shared") >= F.least(least_shared(F.col("n")), least_shared(F.col("m")))
    most = F.col("shared") + F.least("p", "q")
    return counted.filter(enough & (most * (1 + similarity) >= similarity * (F.col("n") + F.col("m")) - 1e-6)).select("a", "b")


def similar(rows: DataFrame, distinct: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the stored (a, b) ``pairs`` of nodes whose shingle sets are at least so similar (Jaccard), on whole sets.

    Texts aren't shuffled for the sake of ids, unless these are many. Of each pair the set of the node with fewer partners
    travels to the other, so that no set is sent about for each of the thousands of partners that a node may have. Only 16
    bits of each hash travel at first. Shingles that differ may agree in these, so pairs seem more similar than they are,
    never less: what isn't similar by these bits isn't similar, and the whole hashes of the other pairs decide.
    """
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("partners"))
    ends = cut(ends.join(distinct.select("rep", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash")), "rep"))
    known = lambda c: ends.select(F.col("rep").alias(c), F.col("partners").alias(f"n_{c}"))
    sided = pairs.join(known("a"), "a").join(known("b"), "b")
    sided = cut(sided.select(*(F.when(F.col("n_a") >= F.col("n_b"), F.col(x)).otherwise(F.col(y)).alias(c) for c, x, y in (("stay", "a", "b"), ("go", "b", "a")))))
    with small_batches(rows.sparkSession):
        for bits in (np.uint16, np.uint64):
            sided = _similar_by(bits, rows, ends, sided, width, similarity)
            release(rows.sparkSession)
    return sided.select(F.least("stay", "go").alias("a"), F.greatest("stay", "go").alias("b"))


def _similar_by(bits: type, rows: DataFrame, ends: DataFrame, sided: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those stored (stay, go) pairs that may be similar by the lowest ``bits`` of their hashes; with all bits those that are."""
    n_pairs = sided.count()
    if not n_pairs:
        return sided
    nodes = ends.select("_id", "_hash", "rep")
    go = cut(sided.groupBy("go").agg(F.collect_list("stay").alias("to")).withColumnRenamed("go", "rep").join(nodes, "rep").select("_id", "_hash", "rep", "to"))
    stay = nodes.join(sided.select(F.col("stay").alias("rep")).distinct(), "rep").select("_id", "_hash", "rep", F.array("rep").alias("to"))
    kind = "smallint" if bits is np.uint16 else "bigint"

    def sets(wanted: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
        here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        texts = rows.join(_broadcast_few(wanted, n_pairs), here).select("rep", "to", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: set[int] = set()
            for b in batches:
                for rep, to, text in zip(b.column("rep").to_pylist(), b.column("to"), _texts(b, "text")):
                    if rep in met:  # another row of the same id and text
                        continue
                    met.add(rep)
                    hashes = np.unique(shingle_hashes(words_of(text.as_py()), width))
                    n = len(hashes)
                    hashes = np.unique(hashes.astype(bits)).view(np.int16 if bits is np.uint16 else np.int64)
                    step = max(1, SET_BYTES // max(1, hashes.nbytes))
                    for at in range(0, len(to.values), step):
                        some = to.values.slice(at, step)
                        many = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * len(hashes), np.tile(hashes, len(some)))
                        yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), rep)), many, pa.array(np.full(len(some), n, np.int32))], list(names))

        return texts.mapInArrow(run, f"{names[0]} bigint, {names[1]} bigint, {names[2]} array<{kind}>, {names[3]} int")

    left, right = sets(go, ("stay", "go", "x", "n_x")), sets(stay, ("stay", "_stay", "y", "n_y")).drop("_stay")
    # of several hashes with the same bits all but one may be shared, too
    both = F.size(F.array_intersect("x", "y")) + F.least(F.col("n_x") - F.size("x"), F.col("n_y") - F.size("y"))
    union = F.col("n_x") + F.col("n_y") - both
    return cut(left.join(right, "stay").filter((union <= 0) | (both >= similarity * union - 1e-9)).select("stay", "go").distinct())


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 4, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, group_id, stays) for each row of ``docs``: exact copies and near copies share the least id among them.

    Copies with the same words are one node. A pair of nodes counts whose sets of ``width``-word shingles have a Jaccard
    similarity of at least ``similarity``, computed on the whole sets. The first candidates are nodes whose word-set
    fingerprints of the same band are within ``radius`` bits, with one representative of each fingerprint. Then pairs that
    share enough rare shingles and aren't linked yet are verified: those with representatives of the shingles, and last all
    that are left. As similar sets must share so many, the groups are exact.

    ``stays`` is true for the group's least id, of several texts of that id for the one with the least ``text_hash``; rows that are
    alike in both stay or go together. Texts with no words are copies of one another; a null text is empty. A null id is
    the least only in a group of no others. An empty table gives no rows.
    """
    release(docs.sparkSession)  # what made ``docs`` may be over
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), content.alias("text"), F.xxhash64(content).alias("text_hash"))
    nodes = sketches(rows, width, similarity, bands)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("one")
    distinct = written(nodes.groupBy("node").agg(F.min("row").alias("rep"), one, F.max("n").alias("n"), F.first("prints", ignorenulls=True).alias("prints")))
    # representatives first, so that the members of a large group aren't all paired with all
    roots = connected_components(similar(rows, distinct, cut(same_band_pairs(distinct, radius, similarity)), width, similarity))
    mixed = mixed_keys(nodes, distinct, roots)
    for pairs in (star_pairs, unlinked_pairs):
        release(docs.sparkSession)
        candidates = cut(pairs(_rooted(mixed, roots), similarity))
        release(docs.sparkSession)
        more = similar(rows, distinct, candidates, width, similarity)
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    classed = distinct.select("node", "rep", "one").join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = classed.groupBy("root").agg(F.min("one").alias("least"))
    by_node = classed.join(least, "root").select("node", "least")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return nodes.select("doc_id", "text_hash", "node").join(by_node, "node").select("doc_id", "text_hash", F.col("least.doc_id").alias("group_id"), stays.alias("stays"))


def without_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the one document of each group of near copies that ``stays``, all columns as they were."""
    groups = near_duplicate_groups(docs, width, similarity, doc_id=doc_id, text=text)
    gone = cut(groups.filter(~F.col("stays")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    here = docs[doc_id].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["_hash"])
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, here, "left_anti")
