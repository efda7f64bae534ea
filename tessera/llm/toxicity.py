"""Toxicity classifier with counterfactual regularisation.

A logistic regression on a text's words and their beginnings and ends, counted and divided by the root of the text's length.
Words that only name a group of people (``IDENTITY``) tend to be frequent in toxic texts, and a plain classifier learns
that naming the group is toxic. So the labelled texts' sentences that hold such a term are rewritten with each of the other
terms of its group, and a change of the score between a sentence and its rewritten form is penalised. In a linear model what
swapping a term adds to the penalty depends on the two terms, the term's count and the sentence's length alone, so all
sentences of all texts are summed up to one number for each pair of terms.

Steps: the labelled sample's features are counted by class (summed on Spark); those that tell the classes apart best stay;
the sample's texts, as sparse rows over these, go to the driver with the sums of the pairs; all texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of features.
BUCKETS = 1 << 20
#: Labelled rows that a model is fitted on at most: those with the least hash of their id.
SAMPLE_ROWS = 8_000
#: Features that a model has at most, and texts of the sample that a feature needs.
MOST_FEATURES, MIN_TEXTS = 4_096, 4
#: Longer runs of letters, as of writing without spaces, count by pieces of so many letters.
PIECE = 24
#: What a word counts against its beginnings and ends.
WORD_SCALE = 2.0
#: Tokens whose features, or whose share of a score, a worker remembers.
REMEMBERED = 200_000
#: Groups of terms that may be swapped for each other.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"), ("africans", "europeans", "americans", "asians"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "citizens", "refugees", "foreigners"), ("immigrant", "citizen", "refugee", "foreigner"), ("old", "young"), ("deaf", "blind", "disabled"), ("poor", "rich"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("étrangers", "citoyens"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "inländer"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "ciudadanos"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; runs longer than ``PIECE`` in pieces, so that all of them counts."""
    found = _WORD.findall((text or "").lower())
    if any(len(w) > PIECE for w in found):
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def word_features(word: str) -> list[tuple[int, float]]:
    """(bucket, weight) of a word: itself, its beginnings of two to eight letters, its ends of two to five."""
    parts = [f"<{word[:k]}" for k in range(2, min(8, len(word) - 1) + 1)] + [f"{word[-k:]}>" for k in range(2, min(5, len(word) - 1) + 1)]
    return [(_bucket(f"<{word}>"), WORD_SCALE), *((_bucket(p), 1.0) for p in parts)]


_known: dict[str, list[tuple[int, float]]] = {}


def features(text: str | None) -> dict[int, float]:
    """Sparse features of a whole text; none for a text without letters."""
    found = words(text)
    out: dict[int, float] = {}
    if len(_known) > REMEMBERED:
        _known.clear()
    for word, times in Counter(found).items():
        if (parts := _known.get(word)) is None:
            parts = _known[word] = word_features(word)
        x = times / sqrt(len(found))
        for bucket, scale in parts:
            out[bucket] = out.get(bucket, 0.0) + x * scale
    return out


def swaps(text: str | None, groups: Sequence[Sequence[str]] = IDENTITY) -> Counter:
    """Of each (term, other term): the sum over the text's sentences of the squared share that swapping them changes."""
    others = {t: [o for o in g if o != t] for g in groups for t in g}
    out: Counter = Counter()
    for sentence in _SENTENCE.findall(text or ""):
        found = words(sentence)
        for term, times in Counter(w for w in found if w in others).items():
            for other in others[term]:
                out[term, other] += times * times / len(found)
    return out


@dataclass
class Model:
    """``weights`` by bucket (only those that aren't zero) and ``bias``."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0

    def share(self, word: str) -> float:
        get = self.weights.get
        return sum(x * w for b, x in word_features(word) if (w := get(b)) is not None)

    def logit(self, text: str | None) -> float:
        found = words(text)
        return self.bias + (sum(times * self.share(w) for w, times in Counter(found).items()) / sqrt(len(found)) if found else 0.0)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -60, 60))))


def loss_and_gradient(p: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray, pairs: np.ndarray, mass: np.ndarray, l2: float, fairness: float) -> tuple[float, np.ndarray]:
    """Of weights and, last, the bias: log loss of all rows, ``l2``/2 of the squared weights, and ``fairness``/2 of the squared changes of the
    score by swapped terms, where ``pairs`` has a row of feature differences for each pair and ``mass`` its sum over the sentences."""
    w, n = p[:-1], len(label)
    s = np.bincount(row, value * w[col], n) + p[-1]
    moved = pairs @ w
    loss = np.logaddexp(0, s).sum() - s[label == 1].sum() + l2 / 2 * w @ w + fairness / 2 * (mass * moved**2).sum()
    error = 1 / (1 + np.exp(-np.clip(s, -60, 60))) - label
    return float(loss), np.append(np.bincount(col, value * error[row], len(w)) + l2 * w + fairness * pairs.T @ (mass * moved), error.sum())


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray, pairs: np.ndarray, mass: np.ndarray, l2: float = 1.0, fairness: float = 10.0, steps: int = 300) -> np.ndarray:
    """Weights of the columns, and the bias, by full-batch adaptive gradient steps; entry ``i`` says that text ``row[i]`` has ``value[i]`` in ``col[i]``."""
    width = pairs.shape[1]
    p = np.zeros(width + 1)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    p[-1] = np.log(share / (1 - share))
    total = np.full_like(p, 1e-8)
    for _ in range(steps):
        g = loss_and_gradient(p, row, col, value, label, pairs, mass, l2, fairness)[1]
        total += g**2
        p = p - 0.5 * g / np.sqrt(total)
    return p


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_features: int = MOST_FEATURES, min_texts: int = MIN_TEXTS, fairness: float = 10.0, groups: Sequence[Sequence[str]] = IDENTITY, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from (doc_id, toxic) ``labels``, of which at most ``sample_rows`` are used, picked by the hash of the id.

    A label other than 0 and 1, or without an id, counts as none; ids without a document are passed over. Repeated rows of
    ``labels`` count once, repeated documents each time; a document with both labels counts with each. Without both labels
    there are no weights: every score is then the share of toxic rows, held between 0.001 and 0.999, or 0.001 without any row.
    Columns named alike don't clash. What reaches the driver: at most ``most_features`` sums, as many entries for each row of
    the sample, and a number for each pair of terms.
    """
    picked = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample_rows)  # so many rows at most are sent to every executor
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column("_text"), b.column("_y").to_pylist()):
                seen[y].update(features(t.as_py()).keys())
                seen[y][-1] += 1  # all texts
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], ["b", "n0", "n1"])

    sums = rows.mapInArrow(count, "b int, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    texts = sums.filter("b = -1").first()
    n0, n1 = (texts["n0"], texts["n1"]) if texts else (0, 0)
    if not n0 or not n1:
        share = min(max(n1 / (n0 + n1) if n0 + n1 else 0.0, 1e-3), 1 - 1e-3)
        return Model({}, float(np.log(share / (1 - share))))
    both = F.col("n0") + F.col("n1")
    gap = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt((both + 4) / (n0 + n1) / n1)  # in standard errors of the toxic share, nearly
    best = sums.filter((F.col("b") >= 0) & (both >= min_texts)).select("b", gap.alias("gap")).orderBy(F.desc("gap"), "b").limit(most_features)
    used = np.sort(np.array([r["b"] for r in best.collect()], np.int64))
    place = {int(b): i for i, b in enumerate(used)}

    terms = sorted({(t, o) for g in groups for t in g for o in g if o != t})
    known = {pair: i for i, pair in enumerate(terms)}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{i: x for k, x in features(t.as_py()).items() if (i := place.get(k)) is not None} for t in b.column("_text")]
            moved = [swaps(t.as_py(), groups) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([
                b.column("_id"), b.column("_y"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32())),
                pa.array([[known[k] for k in m] for m in moved], pa.list_(pa.int32())), pa.array([list(m.values()) for m in moved], pa.list_(pa.float64())),
            ], ["_id", "_y", "c", "x", "pair", "mass"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(rows_of, f"_id {kind}, _y int, c array<int>, x array<float>, pair array<int>, mass array<double>").toArrow()
    got = got.sort_by([("_id", "ascending"), ("_y", "ascending")]).combine_chunks()  # the same model whatever order the tasks ended in
    label_, c, x, pair, sizes = (got.column(k).combine_chunks() for k in ("_y", "c", "x", "pair", "mass"))
    mass = np.bincount(pair.flatten().to_numpy(), sizes.flatten().to_numpy(), len(terms)) if len(pair.flatten()) else np.zeros(len(terms))
    there = np.flatnonzero(mass)
    pairs = np.zeros((len(there), len(used)))
    for i, k in enumerate(there):
        for sign, term in zip((-1, 1), terms[k]):
            for b, scale in word_features(term):
                if b in place:
                    pairs[i, place[b]] += sign * scale
    row = np.repeat(np.arange(len(c), dtype=np.int32), np.diff(c.offsets.to_numpy()))
    col, value = c.flatten().to_numpy(), x.flatten().to_numpy()
    # rare features are scaled up by half, on a logarithmic scale, so that the penalty doesn't silence them
    scale = 1 / np.sqrt(np.sqrt(np.bincount(col, value.astype(np.float64) ** 2, len(used)) / len(c)) + 1e-3)
    p = fit(row, col, value * scale[col].astype(np.float32), label_.to_numpy(), pairs * scale, mass[there], fairness=fairness)
    del got, c, x, row, col, value
    pa.default_memory_pool().release_unused()
    return Model({int(b): float(w) for b, w in zip(used, p[:-1] * scale) if w}, float(p[-1]))


def rate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of being toxic, and ``predicted``, 1 from a score of 0.5 on; columns of these
    names are replaced. A null or empty text, or one without letters, has the score that the bias gives."""
    added = {"score": "double", "predicted": "int"}
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[str, float] = {}
        for b in batches:
            logits = []
            for t in b.column(len(kept)):
                found = words(t.as_py())
                total = 0.0
                for word, times in Counter(found).items():
                    if (share := shares.get(word)) is None:
                        if len(shares) > REMEMBERED:
                            shares.clear()
                        share = shares[word] = model.share(word)
                    total += times * share
                logits.append(model.bias + (total / sqrt(len(found)) if found else 0.0))
            score = 1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())], [*kept, *added])

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)
