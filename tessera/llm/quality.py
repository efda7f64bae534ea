"""Ordinal quality classifier: cumulative-link (proportional-odds) regression on hashed text features.

One weight vector over hashed features gives a text's score ``s``; ordered thresholds turn it into grades:
``P(grade <= k) = 1 / (1 + exp(s - t[k]))``. Features are the words that a text has and the shares of its tokens' shapes
(letters, capitals and digits each as one sign, other characters as they are), besides the share of tokens that repeat
the one before. The model is fitted on a bounded sample of labelled rows; every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of words and shapes together.
BUCKETS = 1 << 18
#: Labelled rows that a model is fitted on at most: those with the least hash of their id.
SAMPLE_ROWS = 8_000
#: A word counts if at least so many of the sample's texts have it; a word of one or two texts says nothing.
MIN_TEXTS = 8
#: Tokens whose features a worker remembers.
REMEMBERED = 100_000
SHAPE_SCALE = 8.0
PIECE = 64

_known: dict[str, tuple[int, int]] = {}
_RUN = re.compile(r"(.)\1+", re.S)


def _token(token: str) -> tuple[int, int]:
    """Buckets of a token's word, -1 if it has none, and of its shape."""
    word = "".join([c for c in token.lower() if c.isalnum()])
    shape = _RUN.sub(r"\1\1", "".join(["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token]))
    return (xxhash.xxh32_intdigest("w" + word) % BUCKETS if word else -1, xxhash.xxh32_intdigest("s" + shape) % BUCKETS)


_REPEATS = xxhash.xxh32_intdigest("repeats") % BUCKETS


def _tokens(text: str) -> list[str]:
    """What white space parts; longer tokens, as of writing without spaces, count by pieces of ``PIECE`` characters, each."""
    tokens = text.split()
    if len(text) > PIECE and any(map(PIECE.__lt__, map(len, tokens))):
        tokens = [t[i : i + PIECE] for t in tokens for i in range(0, len(t), PIECE)]
    return tokens


def features(text: str | None) -> dict[int, float]:
    """Sparse features of one text; none for a text without tokens."""
    tokens = _tokens(text or "")
    out: dict[int, float] = {}
    if not tokens:
        return out
    if len(_known) > REMEMBERED:
        _known.clear()
    n = len(tokens)
    for token, times in Counter(tokens).items():
        if (found := _known.get(token)) is None:
            found = _known[token] = _token(token)
        word, shape = found
        if word >= 0:
            out[word] = 1.0
        out[shape] = out.get(shape, 0.0) + SHAPE_SCALE * times / n
    out[_REPEATS] = SHAPE_SCALE * sum(map(str.__eq__, tokens, tokens[1:])) / n
    return out


@dataclass
class Model:
    """``weights`` by bucket (only those that aren't zero) and ascending ``thresholds`` between the ``grades``."""

    grades: list[int] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return sum(x * w for b, x in features(text).items() if (w := get(b)) is not None)

    def tails(self, score: float) -> list[float]:
        """P(grade >= g) for each grade but the least."""
        return [float(1 / (1 + np.exp(np.clip(t - score, -60, 60)))) for t in self.thresholds]


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, l2: float = 3.0, steps: int = 300, min_texts: int = MIN_TEXTS) -> Model:
    """Fits by full-batch adaptive gradient steps with an L2 penalty. Entry ``i`` says that text ``row[i]`` has
    ``value[i]`` in ``bucket[i]``; ``grade`` has the grade of each text. Fewer than two grades: all weights are zero."""
    grades = [int(g) for g in np.unique(grade)]
    if len(grades) < 2:
        return Model(grades, {}, [])
    seen, count = np.unique(bucket, return_counts=True)
    used = seen[count >= min_texts]
    kept = np.isin(bucket, used)
    at, col, val = row[kept].astype(np.int32), np.searchsorted(used, bucket[kept]).astype(np.int32), value[kept].astype(np.float32)
    del row, bucket, value, kept
    y = np.searchsorted(grades, grade)
    n, k = len(grade), len(grades)
    w = np.zeros(len(used))
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    first, gaps = float(np.log(share[0] / (1 - share[0]))), np.diff(np.log(share / (1 - share)))
    p = np.concatenate((w, [first], np.log(np.maximum(gaps, 1e-3))))  # gaps as logarithms keep the thresholds in order
    total = np.zeros_like(p)
    for _ in range(steps):
        w, t = p[: len(w)], _thresholds(p[len(w) :])
        s = np.bincount(at, val * w[col], n)
        # P(y <= j) at both borders of each row's grade
        bounds = np.concatenate(([-np.inf], t, [np.inf]))
        with np.errstate(over="ignore"):
            upper, lower = (1 / (1 + np.exp(np.clip(s - bounds[y + j], -60, 60))) for j in (1, 0))
        upper, lower = np.where(y == k - 1, 1.0, upper), np.where(y == 0, 0.0, lower)
        inside = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        gs = du - dl  # of the loss by the score
        gw = np.bincount(col, val * gs[at], len(w)) + l2 * w
        gt = np.bincount(y, -du, k)[: k - 1] + np.bincount(y, dl, k)[1:]
        grad = np.concatenate((gw, [gt.sum()], [gt[j + 1 :].sum() * np.exp(p[len(w) + 1 + j]) for j in range(k - 2)]))
        total += grad**2
        p = p - 0.5 * grad / np.sqrt(total + 1e-12)
    w, t = p[: len(w)], _thresholds(p[len(w) :])
    return Model(grades, {int(b): float(x) for b, x in zip(used, w) if x}, [float(x) for x in t])


def _thresholds(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> Model:
    """A model from (doc_id, grade) ``ratings``, of which at most ``sample_rows`` are used, picked by the hash of the id.

    Null grades and ids count as unlabelled; ids without a document are passed over. Repeated rows of ``ratings`` count once,
    repeated documents each time; a document with several grades counts with each. Columns named alike don't clash.
    """
    picked = ratings.filter(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(grade).cast("int").alias("_grade")).distinct()
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample_rows)  # so many rows at most are sent to every executor
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_grade"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))], ["_id", "_grade", "b", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(run, f"_id {kind}, _grade int, b array<int>, x array<float>").toArrow()
    got = got.sort_by([("_id", "ascending"), ("_grade", "ascending")]).combine_chunks()  # the same model whatever order the tasks ended in
    if not got.num_rows:
        return Model()
    lists, values, grades = (got.column(c).combine_chunks() for c in ("b", "x", "_grade"))
    del got
    model = fit(np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), values.flatten().to_numpy(), grades.to_numpy())
    del lists, values
    pa.default_memory_pool().release_unused()
    return model


def grade(docs: DataFrame, model: Model, keep_from: int, min_tail: float = 0.4, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail`` (the probability of a grade of at least ``keep_from``) and ``keep``
    (whether that is at least ``min_tail``); input columns of these names are replaced.

    A null or empty text has the score zero. A model without weights, from ratings of fewer than two grades, knows no
    bad text: it keeps all, with the one grade that it saw, or null.
    """
    added = {"expected_grade": "double", "tail": "double", "keep": "boolean"}
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema
    grades, at = model.grades, next((k for k, g in enumerate(model.grades) if g >= keep_from), len(model.grades))

    def judge(text: str | None) -> tuple[float | None, float]:
        if not model.thresholds:
            return (float(grades[0]) if grades else None), 1.0
        tails = model.tails(model.score(text))
        expected = grades[0] + sum((b - a) * p for a, b, p in zip(grades, grades[1:], tails))
        return expected, 1.0 if at == 0 else tails[at - 1] if at < len(grades) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py()) for t in b.column(len(kept))]
            new = [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[1] >= min_tail for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*kept, *added])

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
