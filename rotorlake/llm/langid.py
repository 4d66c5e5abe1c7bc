"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public sentencepiece vocabulary. For each language, expected
piece counts come from a few rounds of expectation maximisation over the words of a bounded
labelled sample. A word's probability is the forward sum over every way to cut it into
pieces; pieces never cross words, so that a text's log probability is the sum over its
words, which workers cache. The posterior of the best language is the score.

Words are runs of letters in lower case, with the vocabulary's word mark in front. Any one
character also counts as a piece of a fixed small probability, the same in all languages,
so that words no piece covers have a probability, too. A text that is null, empty or without any letter gets ``und`` with
score 0. Among equal languages the alphabetically first wins. An empty table gives no rows;
without labelled rows, every text gets ``und``. Other columns stay as they are.

Training sample: about ``per_language`` labelled rows of each language, those with the
smallest hashes of their keys; a language with fewer rows gives all of them. A task takes
a text once, however often it occurs, so that copies of one row don't fill the sample. Of
each language's words the TRAINING_WORDS most frequent are fitted, longer ones in parts of
PART letters, so that no probability leaves floating point.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, released, slices, texts

#: Labelled rows of each language that training looks at.
PER_LANGUAGE = 300
#: Words of one language that training takes, the most frequent of its sample.
TRAINING_WORDS = 20_000
ROUNDS, MARK, UNKNOWN, PRIOR, PART = 2, "▁", 1e-8, 1e-7, 24
CACHE_WORDS, SHORT = 200_000, 30

_RUN, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def words(text: str) -> list[str]:
    """Runs of word characters in lower case; :func:`letters` cuts the rare mixed ones."""
    return _RUN.findall(text.lower())


def letters(run: str) -> list[str]:
    return [run] if run.isalpha() else _LETTERS.findall(run)


@dataclass
class Model:
    """Log-free piece probabilities: ``table[piece]`` is a row with one value for each language."""

    languages: list[str]
    table: dict[str, np.ndarray]

    @cached_property
    def widest(self) -> int:
        """Letters of the longest piece."""
        return max(map(len, self.table), default=1)

    def forward(self, word: str) -> np.ndarray:
        """Log probability of a word in each language, over all segmentations."""
        s, table, n, widest = MARK + word, self.table, len(self.languages), self.widest
        sums = [np.ones(n)]
        log = np.zeros(n)
        for end in range(1, len(s) + 1):
            total = sums[-1] * UNKNOWN
            for width in range(1, min(widest, end) + 1):
                row = table.get(s[end - width : end])
                if row is not None:
                    total = total + sums[-width] * row
            sums.append(total)
            if len(sums) > widest:
                sums = sums[-widest:]
                if total.max() < 1e-100:  # keep long words within floating point
                    scale = total.max()
                    sums = [x / scale for x in sums]
                    log += np.log(scale)
        return log + np.log(np.maximum(sums[-1], 1e-300))


def pieces(path: str) -> list[str]:
    """The normal pieces of the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def fit(counts: dict[str, Counter], vocabulary: list[str], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its word counts."""
    languages, known, widest = sorted(counts), set(vocabulary), max(map(len, vocabulary), default=1)
    found: dict[str, dict[str, float]] = {}
    for language in languages:
        frequent = [(MARK + w, c) for w, c in counts[language].most_common(TRAINING_WORDS)]
        edges = []
        for s, c in frequent:
            own = [(i, j, s[i:j]) for j in range(1, len(s) + 1) for i in range(max(0, j - widest), j) if s[i:j] in known or j - i == 1]
            edges.append((len(s), c, own))
        p: dict[str, float] = dict.fromkeys((e[2] for _, _, own in edges for e in own), 1.0)
        for _ in range(rounds):
            expected: dict[str, float] = dict.fromkeys(p, 0.0)
            for n, c, own in edges:
                alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
                for i, j, piece in own:
                    alpha[j] += alpha[i] * p[piece]
                for i, j, piece in reversed(own):
                    beta[i] += beta[j] * p[piece]
                for i, j, piece in own:
                    expected[piece] += c * alpha[i] * p[piece] * beta[j] / alpha[n]
            total = sum(expected.values()) or 1.0
            p = {piece: (x + 0.01) / total for piece, x in expected.items()}
        found[language] = p
    table = {}
    for piece in sorted(known.intersection(*[set().union(*found.values())] if found else [])):
        table[piece] = np.array([max(found[x].get(piece, 0.0), PRIOR) for x in languages])
    return Model(languages, table)


def train(df: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows of ``df`` that have a text and a label.

    The count of labels says below which hash a row is taken, so that no group is sorted or
    collected; what reaches the driver are counts of the sample's words.
    """
    spread = F.xxhash64(F.col(key).cast("string"))
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), spread.alias("h"))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for language, n in have.items():
        limit = int(min(1.0, per_language / n) * 2.0**64 - 2.0**63)
        chosen = chosen | ((F.col("lang") == language) & (F.col("h") <= F.lit(min(limit, 2**63 - 1))))
    counts: dict[str, Counter] = {language: Counter() for language in have}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = {}
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            for language, t in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                if hash(t) not in seen:
                    seen.add(hash(t))
                    own.setdefault(language, Counter()).update(w[at : at + PART] for run in words(t) for w in letters(run) for at in range(0, len(w), PART))
        flat = [(x, w, c) for x, found in own.items() for w, c in found.items()]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], names=["lang", "word", "n"])

    summed = rows.where(chosen).select("lang", "text").mapInArrow(released(counted), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        counts[r["lang"]][r["word"]] = r["n"]
    ordered = {x: Counter(dict(sorted(c.items()))) for x, c in counts.items()}
    return fit(ordered, pieces(path))


class Scorer:
    """Scores texts behind a bounded cache of words; unknown words go forward together."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows, self.filled = model, {}, np.zeros((CACHE_WORDS, len(model.languages))), 0
        self.number = {piece: i for i, piece in enumerate(model.table)}
        self.table = np.array(list(model.table.values())) if model.table else np.zeros((0, len(model.languages)))
        self.widest = model.widest

    def forward(self, found: list[str]) -> np.ndarray:
        """Log probabilities of words of at most SHORT letters, all ends of one place at a time."""
        size, get, widest = max(map(len, found), default=0) + 1, self.number.get, self.widest
        edges: list[list[int]] = [[] for _ in range(size + 1)]
        for k, word in enumerate(found):
            s = MARK + word
            for begin in range(len(s)):
                for end in range(begin + 1, min(begin + widest, len(s)) + 1):
                    if (row := get(s[begin:end])) is not None:
                        edges[end] += (k, begin, row)
        sums = np.ones((size + 1, len(found), len(self.model.languages)))
        for end in range(1, size + 1):
            sums[end] = sums[end - 1] * UNKNOWN
            if edges[end]:
                k, begin, row = np.array(edges[end]).reshape(-1, 3).T
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                sums[end, k[first]] += np.add.reduceat(sums[begin, k] * self.table[row], first, axis=0)
        return np.log(sums[[len(w) + 1 for w in found], range(len(found))])

    def learn(self, runs: list[str]) -> None:
        """Gives each run its place: the sum over its words, or NaN if it has no letter."""
        own = [letters(run) for run in runs]
        need = sorted({w for ws in own for w in ws}, key=lambda w: (len(w), w))
        short = [w for w in need if len(w) <= SHORT]
        value = {w: self.model.forward(w) for w in need[len(short) :]}
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            value.update(zip(part, self.forward(part), strict=True))
        while self.filled + len(runs) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for run, ws in zip(runs, own, strict=True):
            self.rows[self.filled] = value[ws[0]] if len(ws) == 1 else sum((value[w] for w in ws), np.zeros(self.rows.shape[1])) if ws else np.nan
            self.index[run] = self.filled
            self.filled += 1

    def score(self, found: list[str]) -> tuple[list[str], list[float]]:
        """The language and its posterior of each text."""
        cut, index = [words(text) for text in found], self.index
        missing = list(dict.fromkeys(w for ws in cut for w in ws if w not in index))
        if self.filled + len(missing) > CACHE_WORDS and self.filled:
            index.clear()
            self.filled, self.rows = 0, self.rows[:CACHE_WORDS]
            missing = list(dict.fromkeys(w for ws in cut for w in ws))
        self.learn(missing)
        names, scores, place = [], [], index.__getitem__
        for ws in cut:
            logs = self.rows[list(map(place, ws))] if ws else np.zeros((0, self.rows.shape[1]))
            if logs.size and np.isnan(logs[:, 0]).any():
                logs = logs[~np.isnan(logs[:, 0])]
            if not len(logs):
                names.append("und")
                scores.append(0.0)
                continue
            total = logs.sum(axis=0)
            names.append(self.model.languages[int(np.argmax(total))])
            scores.append(float(1.0 / np.exp(total - total.max()).sum()))
        return names, scores


def identify(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior added (replaced, where it has them)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = df.drop(pred, score).withColumn("__text", F.col(text).cast("string"))
    schema = out.drop("__text").schema.add(pred, "string").add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("langid", shared.value, lambda: Scorer(shared.value))
        for batch in slices(batches, "__text", 4 << 20):
            names, scores = own.score(texts(batch, "__text")) if shared.value.languages else (["und"] * batch.num_rows, [0.0] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], pred, score])

    return out.mapInArrow(released(run, "langid"), schema)
