"""Quality rules on repetition, from rolling hashes of words, lines and n-grams in numpy.

Words are runs of characters other than space and \\t to \\r; lines are split at \\n and count
if they hold a word. Base rules: at least ``min_words`` words, and at most half of the words
inside 3-word windows that occur twice or more in the text. The method's rules then bound
the share of characters (UTF-8 bytes of words) that lie inside repeated n-grams, for several
n, and inside lines that repeat an earlier line. Null and empty texts have no words, and so
fail the base rules; rows are judged one by one, so that ties and repeated rows don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import released, slices

#: Largest share of word bytes inside repeated n-grams, by n.
NGRAM_SHARES = {5: 0.30, 7: 0.26, 10: 0.20}
#: Largest share of word bytes inside lines equal to an earlier one.
LINE_SHARE = 0.30
MIN_WORDS = 50
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NEWLINE = np.arange(256) == 10


class Texts:
    """Words and lines of a slice of texts, with their hashes."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        self.buffer, self.offsets = ts.packed(column)
        self.starts, self.ends, self.of = ts.spans(self.buffer, self.offsets, ts.SPACE)
        self.hash = ts.hashes(self.buffer, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.size = self.ends - self.starts
        self.words = np.bincount(self.of, minlength=self.n)
        self.bytes = ts.per_text(self.size, self.of, self.n)

    def in_bytes(self, marked: np.ndarray) -> np.ndarray:
        """Per text, the places of the byte buffer that are marked."""
        total = np.concatenate([[0], np.cumsum(marked)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def chars(self) -> np.ndarray:
        """Code points inside words: bytes that begin a character and aren't white space."""
        return self.in_bytes(((self.buffer & 0xC0) != 0x80) & ~ts.SPACE[self.buffer])

    def in_repeats(self, n: int) -> np.ndarray:
        """True for words inside n-grams that occur more than once in their text."""
        grams, inside = ts.grams(self.hash, n), ts.gram_places(self.of, n)
        at = np.flatnonzero(inside)
        more, _ = ts.repeated(ts.by_text(grams[at], self.of[at]))
        return ts.covered(at[more], n, len(self.of))

    def repeated_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the lines with a word that repeat an earlier line, and their word bytes."""
        starts, ends, of = ts.spans(self.buffer, self.offsets, _NEWLINE)
        first = np.searchsorted(self.starts, starts)
        full = np.flatnonzero((first < len(self.starts)) & (self.starts[np.minimum(first, len(self.starts) - 1)] < ends)) if len(self.starts) else np.zeros(0, int)
        starts, ends, of, first = starts[full], ends[full], of[full], first[full]
        if not len(full):
            return np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        _, before = ts.repeated(ts.by_text(ts.hashes(self.buffer, starts, ends), of))
        total = np.concatenate([[0], np.cumsum(self.size)])
        held = total[np.append(first[1:], len(self.starts))] - total[first]
        return ts.per_text(before, of, self.n), ts.per_text(held * before, of, self.n)


def judge(df: DataFrame, text: str = "text", key: str = "doc_id", shares: dict[int, float] | None = None, line_share: float = LINE_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``
    of each row, and the shares ``line_coverage`` and ``coverage_N`` behind the verdict."""
    shares = NGRAM_SHARES if shares is None else shares
    kind, names = df.schema[key].dataType.simpleString(), [f"coverage_{n}" for n in shares]
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double" + "".join(f", {x} double" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts(batch.column(1))
            lines, line_bytes = t.repeated_lines()
            repeats = ts.per_text(t.in_repeats(3), t.of, t.n)
            covers = [ts.per_text(t.size * t.in_repeats(n), t.of, t.n) / np.maximum(t.bytes, 1) for n in shares]
            line_cover = line_bytes / np.maximum(t.bytes, 1)
            failed = (t.words < min_words) | (100 * repeats > 50 * t.words)
            kept = ~failed & (line_cover <= line_share)
            for cover, most in zip(covers, shares.values(), strict=True):
                kept &= cover <= most
            columns = [t.words.astype(np.int64), t.chars(), t.in_bytes(_SYMBOL[t.buffer]), lines, repeats, failed, kept, line_cover, *covers]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_coverage", *names])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(released(run), schema).withColumnRenamed("key", key)
