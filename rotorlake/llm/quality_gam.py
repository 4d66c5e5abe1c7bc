"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins at quantiles. Shallow trees on one feature at a time, taken in
turn and each scaled by a small rate, fit the gradient of the log loss; their sums are one
lookup table per feature. Then the pairs whose joint trees lower the loss most get a
two-dimensional table each, by the same cyclic boosting on what the main effects leave over.
A score is the logistic of a few looked-up numbers, added with numpy.

Training takes at most ``most`` labelled keys, those with the smallest hashes. Of rows with
equal keys it takes one, that with the smallest features. Features come from the text alone.
Null and empty texts are scored as texts without words. Without labelled rows, every score
is 0.5; a document with several labels counts with each; null keys have no label. Rows are
scored one by one: ties and repeated rows don't matter, other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import released, slices
from .quality_rules import Texts

#: Labelled rows that training takes at most.
MOST_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAST_WEIGHT = 48, 8, 6, 150, 60, 0.15, 4.0
FEATURES = ("log_words", "word_bytes", "symbols", "upper", "digits", "commas_stops", "pipes", "marks", "line_words", "dup_lines", "repeats_2", "repeats_4", "neighbours", "distinct", "short")

_CLASS = {
    "symbols": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8)), "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90), "digits": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "commas_stops": np.isin(np.arange(256), np.frombuffer(b",.;:", np.uint8)), "pipes": np.arange(256) == 124, "marks": np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8)), "newlines": np.arange(256) == 10,
}


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    t = Texts(column)
    words, size = np.maximum(t.words, 1), np.maximum(t.bytes, 1)
    share = {name: t.in_bytes(marked[t.buffer]) for name, marked in _CLASS.items()}
    own = ts.by_text(t.hash, t.of)
    _, before = ts.repeated(own)
    same = np.zeros(len(own), bool)
    same[1:] = own[1:] == own[:-1]
    lines, _ = t.repeated_lines()
    count = lambda marked: ts.per_text(marked, t.of, t.n)
    found = {
        "log_words": np.log1p(t.words), "word_bytes": size / words, "line_words": np.log1p(t.words / (share["newlines"] + 1)), "dup_lines": lines / (share["newlines"] + 1),
        "repeats_2": count(t.in_repeats(2)) / words, "repeats_4": count(t.in_repeats(4)) / words, "neighbours": count(same) / words, "distinct": 1 - count(before) / words, "short": count(t.size <= 3) / words,
    }
    return np.stack([found[name] if name in found else share[name] / size for name in FEATURES], axis=1)


def best_split(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the cut that lowers the loss most; place 0 means none."""
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    total, mass = gradient.sum(), weight.sum()
    fits = (w >= LEAST_WEIGHT) & (mass - w >= LEAST_WEIGHT)
    if not fits.any():
        return 0.0, 0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, g**2 / w + (total - g) ** 2 / (mass - w) - total**2 / mass, -np.inf)
    at = int(np.argmax(gain))
    return max(0.0, float(gain[at])), at + 1


def tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of a shallow tree for each bin: the mean of its leaf, by Newton's rule."""
    gain, at = best_split(gradient, weight) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(gradient), gradient.sum() / (weight.sum() + 1.0))
    return np.concatenate([tree(gradient[:at], weight[:at], depth - 1), tree(gradient[at:], weight[at:], depth - 1)])


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature and then, on either side, the other: (gain, step of each cell)."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(gradient))
    for flip in (False, True):
        g, w = (gradient.T, weight.T) if flip else (gradient, weight)
        for at in range(1, len(g)):
            gain, out = -(g.sum() ** 2) / (w.sum() + 1e-9), np.empty_like(g)
            for rows in (slice(None, at), slice(at, None)):
                inner, cut = best_split(g[rows].sum(axis=0), w[rows].sum(axis=0))
                for columns in (slice(None, cut), slice(cut, None)):
                    a, b = g[rows, columns].sum(), w[rows, columns].sum()
                    gain += a**2 / (b + 1e-9)
                    out[rows, columns] = a / (b + 1.0)
            if gain > best[0]:
                best = (gain, out.T if flip else out)
    return best


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for edge, values, column in zip(self.edges, self.tables, x.T, strict=True):
            out += values[np.searchsorted(edge, column, "right")]
        for (i, j), values in self.pairs.items():
            out += values[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables on rows ``x`` with labels ``y`` of 0 and 1."""
    n_features = len(FEATURES)
    if not len(y):
        return Model(0.0, [np.zeros(0)] * n_features, [np.zeros(1)] * n_features, [np.zeros(0)] * n_features, {})
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    edges, pair_edges = [_edges(c, BINS) for c in x.T], [_edges(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(pair_edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, values in enumerate(tables):
            g, w = slope()
            step = RATE * tree(np.bincount(bins[k], g, len(values)), np.bincount(bins[k], w, len(values)))
            values += step
            margin = np.clip(margin + step[bins[k]], -15, 15)
    cell = {(i, j): coarse[i] * (len(pair_edges[j]) + 1) + coarse[j] for i, j in combinations(range(n_features), 2)}
    shape = {(i, j): (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1) for i, j in cell}
    grid = lambda k, v: np.bincount(cell[k], v, shape[k][0] * shape[k][1]).reshape(shape[k])
    g, w = slope()
    chosen = sorted(cell, key=lambda k: -pair_tree(grid(k, g), grid(k, w))[0])[:PAIRS]
    pairs = {k: np.zeros(shape[k]) for k in chosen}
    for _ in range(PAIR_ROUNDS):
        for k, values in pairs.items():
            g, w = slope()
            step = RATE * pair_tree(grid(k, g), grid(k, w))[1]
            values += step
            margin = np.clip(margin + step.ravel()[cell[k]], -15, 15)
    return Model(base, edges, tables, pair_edges, pairs)


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Learns from the rows of ``df`` that ``labels`` has, of at most ``most`` labelled keys.

    The keys are chosen before any text is read and broadcast; the driver gets the features of
    one row for each.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), spread_of(key).alias("h")).distinct()
    known = known.orderBy("h", "key", "label").limit(most)
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "key").select("h", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, x.T)], names=["h", "label", *FEATURES])

    each = rows.mapInArrow(released(run), "h long, label int" + "".join(f", {f} double" for f in FEATURES)).groupBy("h", "label").agg(F.min(F.struct(*FEATURES)).alias("x"))
    found = each.select("h", "label", "x.*").toPandas().sort_values(["h", "label"])
    return fit(found[list(FEATURES)].to_numpy(float), found["label"].to_numpy(float))


def spread_of(key: str):
    return F.xxhash64(F.col(key).cast("string"))


def classify(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the score, from 0 to 1, added (replaced, where it has such a column)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = df.drop(score).withColumn("__text", F.col(text).cast("string"))
    schema = out.drop("__text").schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = shared.value.score(features(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], score])

    return out.mapInArrow(released(run), schema)
