"""Approximate nearest neighbours by inner product: an NN-descent graph (Dong et al., 2011) and greedy search on it.

Each vector keeps its ``k`` best neighbours so far. They start from blocks of vectors on the same sides of random planes;
then, round by round, the neighbours of a node, in both directions, are introduced to one another: Spark joins nodes to
the neighbours of their neighbours, and pairs that would enter a list are merged into it. A query walks the graph with a beam:
the best nodes found so far are joined with their neighbours until no better one turns up.

Rounds go over the nodes, and walks over the queries, a slice at a time. What a slice has shuffled is dropped before the next, so the disk holds
a part of a round. Graph and walks use 16-bit codes of the vectors; the scores of the result are those of the vectors themselves.

Vectors get one more component that makes them equally long, so that neighbours in the graph are near by distance too,
as greedy search needs; the inner product with a query, whose own component there is zero, stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, release, stored_bytes, written

#: Codes of vectors go to every executor up to so many bytes of them; beyond it each group of ids is joined with its codes.
BROADCAST_BYTES = 128 << 20
#: Vectors compared with each other at once in the start; larger blocks are divided at random.
BLOCK = 1024

#: Vectors for each task. Rounds over few vectors are many short tasks otherwise, each with buffers of its own.
TASK_VECTORS = 4096
LEAST_TASKS = 8
#: Nodes whose neighbours are introduced at once, and how many slices there are at most. Groups joined with codes are four times as large.
SLICE_VECTORS, SLICES = 1 << 16, 8
#: Queries that walk at once, slices of them at most, and nodes whose neighbours one of them looks at in a step.
SLICE_QUERIES, QUERY_SLICES, AHEAD = 4096, 16, 128
#: Queries of a slice whose next nodes are broadcast to the graph instead of shuffling it.
BROADCAST_QUERIES = 4 * SLICE_QUERIES

Resolve = Callable[[np.ndarray, pa.RecordBatch | None, int], np.ndarray]


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the vectors that take part: not null nor zero, all components finite, and of the commonest length."""
    kind = "array<float>" if dict(rows.dtypes)[embedding] == "array<float>" else "array<double>"
    v = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    length = fine.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return fine.filter(F.size("v") == (length["n"] if length else 0))


def _encoded(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows of bytes: 16-bit parts of each vector's largest component, then that component's 32767th and the component that makes all equally long."""
    x = x / (longest or 1.0)
    step = np.abs(x).max(1, keepdims=True) / 32767 if x.size else np.zeros((len(x), 1))
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1, keepdims=True)))
    parts = np.rint(x / np.where(step > 0, step, 1.0)).astype("<i2")
    return np.concatenate((parts.view(np.uint8).reshape(len(x), -1), np.concatenate((step, rest), 1).astype("<f4").view(np.uint8).reshape(len(x), -1)), 1)


def _decoded(codes: np.ndarray) -> np.ndarray:
    codes = np.ascontiguousarray(codes)
    tail = np.ascontiguousarray(codes[:, -8:]).view("<f4")
    return np.concatenate((np.ascontiguousarray(codes[:, :-8]).view("<i2") * tail[:, :1], tail[:, 1:]), 1).astype(np.float32)


def _codes(column: pa.Array, width: int) -> np.ndarray:
    """The rows of bytes of a column of codes without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[start[0] : start[-1]].reshape(-1, width)


class Vectors:
    """Nodes (id, v) with codes of their augmented vectors, looked up from a broadcast or by a join, depending on their size."""

    def __init__(self, nodes: DataFrame) -> None:
        spark = nodes.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        size = nodes.agg(F.count("*").alias("n"), F.max(square).alias("m"), F.max(F.size("v")).alias("d")).first()
        self.n, self.longest, self.dim = size["n"], float(size["m"] or 0.0) ** 0.5, int(size["d"] or 0) + 1
        self.width = 2 * (self.dim - 1) + 8
        longest, dim, width = self.longest, self.dim, self.width

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim - 1)
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width).buffers()[1]
                codes = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(_encoded(x, longest).tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("id"), codes], ["id", "x"])

        self.table = written(self.dealt(nodes.select("id", "v").mapInArrow(encode, "id bigint, x binary")))
        self.shared = None
        if self.n * (width + 8) <= BROADCAST_BYTES:
            got = self.table.toArrow()
            ids, codes = got.column("id").to_numpy(), _codes(got.column("x"), width)
            order = np.argsort(ids)
            self.shared = spark.sparkContext.broadcast((ids[order], codes[order]))
        times = 1 if self.shared is not None else 4
        self.slices = max(1, min(SLICES * times, -(-self.n * times // SLICE_VECTORS)))

    def slice_of(self, node: Column) -> Column:
        return F.pmod(F.xxhash64(node, F.lit(1)), F.lit(self.slices))

    def forget(self) -> None:
        """Drops the codes when nothing is looked up any more."""
        if self.shared is not None:
            self.shared.unpersist()
        discard(self.table)

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` in as few tasks as the number of vectors needs; never in more than it has."""
        return df.coalesce(max(LEAST_TASKS, -(-self.n // TASK_VECTORS)))

    def attached(self, groups: DataFrame, key: str, ids: Column) -> tuple[DataFrame, Resolve]:
        """``groups`` with what the function that is returned needs to give the vectors of a row's ``ids``, in their order."""
        if self.shared is not None:
            shared = self.shared

            def look_up(wanted: np.ndarray, batch: pa.RecordBatch | None, row: int) -> np.ndarray:
                known, x = shared.value
                return _decoded(x[np.searchsorted(known, wanted)])

            return groups, look_up
        each = groups.select(key, F.explode(F.array_distinct(ids)).alias("id")).join(self.table, "id")
        found = each.groupBy(key).agg(F.collect_list(F.struct("id", "x")).alias("_vectors"))
        width = self.width

        def from_row(wanted: np.ndarray, batch: pa.RecordBatch | None, row: int) -> np.ndarray:
            v = batch.column("_vectors")[row].values
            known = v.field("id").to_numpy(zero_copy_only=False)
            order = np.argsort(known)
            return _decoded(_codes(v.field("x"), width)[order[np.searchsorted(known[order], wanted)]])

        return groups.join(found, key, "left"), from_row


def _ordinals(ids: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 in the order of ``ids``."""
    return ids if ids.min() >= 0 and ids.max() < 1 << 32 else np.unique(ids, return_inverse=True)[1]


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, born: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(owners, offsets, others, scores, born): of each owner the ``k`` best different others. Of equal pairs the first born stays."""
    if len(owner):
        # both in one number, which sorts fast
        own, oth = _ordinals(owner), _ordinals(other)
        pair = np.argsort((own.astype(np.uint64) << np.uint64(32)) | oth.astype(np.uint64)) if (born == born[0]).all() else np.lexsort((born, oth, own))
        owner, other, score, born, own, oth = owner[pair], other[pair], score[pair], born[pair], own[pair], oth[pair]
        first = np.ones(len(owner), bool)
        first[1:] = (own[1:] != own[:-1]) | (oth[1:] != oth[:-1])
        owner, other, score, born, own = owner[first], other[first], score[first], born[first], own[first]
        bits = (-score.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
        falling = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)
        order = np.argsort((own.astype(np.uint64) << np.uint64(32)) | falling)
        owner, other, score, born = owner[order], other[order], score[order], born[order]
    start = np.searchsorted(owner, owner)
    kept = np.arange(len(owner)) - start < k
    owner, other, score, born = owner[kept], other[kept], score[kept], born[kept]
    owners, first = np.unique(owner, return_index=True)
    return owners, np.concatenate((first, [len(owner)])).astype(np.int32), other, score, born


def _lists(owner: np.ndarray, other: np.ndarray, score: np.ndarray, born: np.ndarray, k: int) -> pa.RecordBatch:
    owners, offsets, *values = _best(owner, other, score, born, k)
    kinds = (np.int64, np.float32, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(owners), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(t))) for v, t in zip(values, kinds))], ["id", *ENTRY])


#: What a list holds of each neighbour: its id, their inner product, and the round that found it (-1: the start).
ENTRY = ("to", "score", "born")
LISTS = "id bigint, to array<bigint>, score array<float>, born array<int>"


def _merged(lists: DataFrame, k: int, vectors: Vectors) -> DataFrame:
    """One list of the ``k`` best for each id. Lists of one id come from tasks that have merged their own before."""
    gathered = vectors.dealt(lists.select("id", *ENTRY).repartition("id")).sortWithinPartitions("id")

    def whole(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = b.column("id").to_numpy()
        again = ids[1:] == ids[:-1]
        several = np.concatenate((again, [False])) | np.concatenate(([False], again))
        yield b.filter(pa.array(~several))  # a list alone is as it was
        b = b.filter(pa.array(several))
        if b.num_rows:
            owner = np.repeat(b.column("id").to_numpy(), np.diff(b.column("to").offsets.to_numpy()))
            yield _lists(owner, *(b.column(c).flatten().to_numpy() for c in ENTRY), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last id so far, of which the next batch may have more
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b.cast(rest.schema)]).combine_chunks().to_batches()[0]
            at = int(np.searchsorted(b.column("id").to_numpy(), b.column("id")[-1].as_py()))
            if at:
                yield from whole(b.slice(0, at))
            rest = b.slice(at)
        if rest is not None:
            yield from whole(rest)

    return gathered.mapInArrow(run, LISTS)


def _next(graph: DataFrame | None, made: DataFrame) -> DataFrame:
    """``made``, stored, in the place of ``graph``, of which nothing is left on the disk."""
    stored = written(made)
    if graph is not None:
        discard(graph)
    release(made.sparkSession)
    return stored


def _start(vectors: Vectors, k: int, rounds: int, seed: int) -> DataFrame:
    """Lists from blocks: in each round the vectors on the same sides of some random planes, compared with each other."""
    bits = max(0, int(np.ceil(np.log2(max(1, vectors.n / (BLOCK // 2))))))
    planes = np.random.default_rng(seed).standard_normal((rounds, vectors.dim, bits)).astype(np.float32)
    width = vectors.width

    def placed(some: range) -> DataFrame:
        def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = 1 << np.arange(bits, dtype=np.int64)
            for b in batches:
                x = _decoded(_codes(b.column("x"), width))
                for r in some:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(np.full(b.num_rows, r, np.int32)), pa.array(((x @ planes[r] > 0) @ weights).astype(np.int64))], ["id", "x", "round", "side"])

        sided = vectors.table.mapInArrow(sides, "id bigint, x binary, round int, side bigint")
        sizes = sided.groupBy("round", "side").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        return sided.join(cut(sizes), ["round", "side"]).withColumn("part", F.pmod(F.xxhash64("id", "round"), "parts"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _decoded(_codes(table.column("x"), width))
        m = min(k, len(ids) - 1)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        if m > 0:
            parts = []
            for at in range(0, len(ids), BLOCK):  # rows of the products at once
                g = x[at : at + BLOCK] @ x.T
                g[np.arange(len(g)), at + np.arange(len(g))] = -np.inf
                best = np.argpartition(-g, m - 1, axis=1)[:, :m]
                parts.append((np.repeat(ids[at : at + BLOCK], m), ids[best].ravel(), np.take_along_axis(g, best, 1).ravel()))
            found = [np.concatenate(p) for p in zip(*parts)]
        return pa.Table.from_batches([_lists(*found, np.full(len(found[0]), -1, np.int32), k)])

    graph, each = None, max(1, -(-rounds // vectors.slices))
    for at in range(0, rounds, each):
        blocks = placed(range(at, min(rounds, at + each))).select("id", "x", "round", "side", "part").groupBy("round", "side", "part").applyInArrow(compare, LISTS)
        graph = _next(graph, _merged(blocks if graph is None else graph.unionByName(blocks), k, vectors))
    return graph


def _introduce(graph: DataFrame, vectors: Vectors, k: int, reverse: int, turn: int, part: int) -> DataFrame:
    """A round's slice: the members around each node of it are compared; lists of the pairs that beat the worst of a list.

    Pairs whose both ways to the node are older than the round before were compared in it. Of the links that end in a node
    ``reverse`` are taken, others each round; lists keep their best, so a link that isn't taken costs a round, not a neighbour.
    """
    here = lambda df: df.filter(vectors.slice_of(F.col("node")) == part)
    link = graph.select("id", F.explode(F.arrays_zip("to", "born")).alias("l")).select("id", F.col("l.to").alias("to"), (F.col("l.born") >= turn - 1).alias("new"))
    back = here(link.select(F.col("to").alias("node"), F.col("id").alias("member"), "new"))
    back = back.withColumn("n", F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("member", F.lit(turn))))).filter(F.col("n") <= reverse).drop("n")
    back = vectors.dealt(back)
    around = here(link.select(F.col("id").alias("node"), F.col("to").alias("member"), "new")).unionByName(back)
    worst = graph.select(F.col("id").alias("member"), F.when(F.size("to") < k, F.lit(float("-inf"))).otherwise(F.array_min("score")).cast("float").alias("worst"))
    groups = vectors.dealt(around.join(worst, "member")).groupBy("node").agg(F.collect_list(F.struct("member", "new", "worst")).alias("m"))
    groups, resolve = vectors.attached(groups, "node", F.col("m.member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for row, m in enumerate(b.column("m")):
                v = m.values
                ids, first, again = np.unique(v.field("member").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                worst = v.field("worst").to_numpy(zero_copy_only=False)[first]
                new = np.bincount(again, v.field("new").to_numpy(zero_copy_only=False), len(ids)) > 0
                x = resolve(ids, b, row)
                g = x @ x.T
                better = (g > worst[:, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                found.append((ids[i], ids[j], g[i, j]))
            if found:
                owner, other, score = (np.concatenate(p) for p in zip(*found))
                yield _lists(owner, other, score, np.full(len(owner), turn, np.int32), k)

    return _merged(vectors.dealt(groups).mapInArrow(run, LISTS), k, vectors)


def build(vectors: Vectors, k: int = 32, rounds: int = 8, turns: int = 16, reverse: int = 32, settled: float = 0.01, seed: int = 7) -> DataFrame:
    """The neighbour graph (id, to, score, born). Rounds go on until at most the share ``settled`` of the entries of all lists is new in
    one, however many vectors there are; ``turns`` bounds them for data on which they never settle."""
    graph, waiting = _start(vectors, k, rounds, seed), []  # new pairs are merged in once they take as much of the disk as the graph
    for turn in range(turns):
        for part in range(vectors.slices):
            made = _next(None, _introduce(graph, vectors, k, reverse, turn, part))
            waiting.append(made)
            if part + 1 == vectors.slices or sum(map(stored_bytes, waiting)) >= stored_bytes(graph):
                graph = _next(graph, _merged(reduce(DataFrame.unionByName, waiting, graph), k, vectors))
                discard(*waiting)
                waiting = []
        seen = graph.agg(F.sum(F.size(F.filter("born", lambda b: b == turn))).alias("new"), F.sum(F.size("to")).alias("all")).first()
        if (seen["new"] or 0) <= settled * (seen["all"] or 0):
            break
    return graph


def two_way(graph: DataFrame, k: int, vectors: Vectors) -> list[DataFrame]:
    """(id, to), stored by slices: the graph with the best ``k`` links that end in each node, turned round. Nodes that few lists have, as long vectors
    among many short ones, are reached from those that they list themselves."""
    links = graph.select("id", F.explode(F.arrays_zip("to", "score")).alias("l")).select("id", F.col("l.to").alias("to"), F.col("l.score").alias("score"))
    slices = []
    for part in range(vectors.slices):
        ends = links.filter(vectors.slice_of(F.col("to")) == part)
        back = ends.select(F.col("to").alias("id"), F.col("id").alias("to"), F.row_number().over(W.partitionBy("to").orderBy(F.desc("score"), "id")).alias("n")).filter(F.col("n") <= k)
        own = links.select("id", "to").filter(vectors.slice_of(F.col("id")) == part)
        slices.append(_next(None, vectors.dealt(own.unionByName(back.select("id", "to")).groupBy("id").agg(F.collect_set("to").alias("to")))))
    return slices


def search(graph: DataFrame, vectors: Vectors, queries: DataFrame, beam: int = 256, near_by: bool = False) -> DataFrame:
    """(query, ids, scores) of ``queries`` (query, node, q): the best ``beam`` nodes that a greedy walk from ``node`` finds, by
    inner product with ``q``, stored. The best nodes of the beam not yet looked at are joined with their neighbours until none is left.
    ``near_by``: the queries are few, so that the nodes they look at are broadcast to the graph."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in range(b.num_rows):
                q = np.append(np.array(b.column("q")[row].values, np.float32), np.float32(0))
                ids, scores, looked = (b.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "scores", "looked"))
                more = np.setdiff1d(b.column("more")[row].values.to_numpy(zero_copy_only=False), ids) if b.column("more")[row].is_valid else np.zeros(0, np.int64)
                looked = np.concatenate((looked.astype(bool), np.zeros(len(more), bool)))
                ids = np.concatenate((ids, more))
                scores = np.concatenate((scores, resolve(more, b, row) @ q)) if len(more) else scores
                order = np.lexsort((ids, -scores))[:beam]
                ids, scores, looked = ids[order], scores[order], looked[order]
                todo = np.flatnonzero(~looked)[:AHEAD]
                looked[todo] = True
                rows.append((ids, scores, looked, ids[todo]))
            kinds = (pa.int64(), pa.float32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("q"), *(pa.array([r[i] for r in rows], pa.list_(t)) for i, t in enumerate(kinds))], ["query", "q", "ids", "scores", "looked", "todo"])

    kind, parts = queries.schema["query"].dataType.simpleString(), queries.schema["q"].dataType.simpleString()
    state = queries.select("query", "q", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<float>").alias("scores"), F.array().cast("array<boolean>").alias("looked"), F.array("node").alias("more"))
    schema = f"query {kind}, q {parts}, ids array<bigint>, scores array<float>, looked array<boolean>, todo array<bigint>"
    walked = None
    while True:
        given, resolve = vectors.attached(state, "query", F.coalesce("more", F.array().cast("array<bigint>"))) if walked is None or vectors.shared is not None else vectors.attached(state, "query", F.col("more"))
        walked = _next(walked, vectors.dealt(given).mapInArrow(step, schema))
        ahead = walked.select("query", F.explode("todo").alias("id"))
        if ahead.isEmpty():
            return walked
        near = graph.select("id", "to").join(F.broadcast(ahead) if near_by else ahead, "id").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("more"))
        state = walked.select("query", "q", "ids", "scores", "looked").join(near, "query", "left")


def nearest(rows: DataFrame, is_query: Column, top: int = 20, k: int = 32, rounds: int = 8, turns: int = 16, beam: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows with the largest inner products for each row that ``is_query`` (of
    ``vec_id``) picks, itself left out, as found on the graph. Scores are exact; ties go to the smaller id.

    Vectors that are null, zero or not finite take no part, nor do those of an uncommon length. Equal vectors are one node with
    its least ``top + 1`` ids, as no more can be among the nearest; so a vector that a third of all rows have costs
    what any other does. Rows of one id and vector count once; an empty table gives no rows.
    """
    valid = written(usable(rows, vec_id, embedding).distinct())
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    nodes = written(valid.withColumn("n", place).filter(F.col("n") <= top + 1).groupBy("v").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("copies")))
    asked = written(valid.filter(is_query).join(nodes.select("v", F.col("id").alias("node")), "v").select(F.col("vec_id").alias("query"), "node", F.col("v").alias("q")))
    discard(valid)
    release(rows.sparkSession)
    vectors = Vectors(nodes)
    graph = build(vectors, k, rounds, turns)
    links = two_way(graph, k, vectors)
    discard(graph)
    graph = reduce(DataFrame.unionByName, links)
    n = asked.count()
    slices = max(1, min(QUERY_SLICES, -(-n // SLICE_QUERIES)))
    near_by = n <= slices * BROADCAST_QUERIES
    few = F.broadcast if near_by else lambda df: df
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(double("v"), double("q"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    out = []
    for part in range(slices):
        some = asked.filter(F.pmod(F.xxhash64("query", F.lit(2)), F.lit(slices)) == part)
        found = search(graph, vectors, some, beam, near_by)
        # exact scores of the best nodes, in double precision from the original vectors, and their ids
        best = found.select("query", F.explode(F.slice("ids", 1, top + 1 + 2 * top)).alias("id"))
        scored = nodes.join(few(best), "id").join(few(some.select("query", "q")), "query")
        rows_ = scored.select("query", dot.alias("score"), F.explode("copies").alias("vec_id")).filter(F.col("vec_id") != F.col("query"))
        ranked = rows_.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= top)
        out.append(_next(found, ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")))
    vectors.forget()
    discard(*links, nodes, asked)
    return reduce(DataFrame.unionByName, out)
