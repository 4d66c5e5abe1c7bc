"""Token counts by a two-tier lookup on the map side, without shuffling pre-tokens.

Tier 1 is a compact broadcast table: the most frequent pre-tokens, FREQUENT at most, with the
number of tokens that the library gives for each. They are counted on a sample of about
SAMPLE rows, those with the smallest hashes of their texts; it decides speed alone, not
counts. Tier 2 is a bounded cache in each worker for the rest; a miss there goes to the
library. Counts add up over the pre-tokens of a text.

Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text count as the
library's default has it: one token each. Texts with characters newer than the libraries'
common Unicode version are counted by the library as a whole. Rows are counted one by one:
ties and repeated rows don't matter, other columns aren't read, an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .byte_bpe import byte_characters
from .common import kept, released, slices, texts

#: Entries of the broadcast tier at most, and rows, about, that it is counted on.
FREQUENT, SAMPLE = 1 << 16, 4000


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


@cache
def _characters() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


def piece_ids(path: str, pieces: list[str]) -> list[list[int]]:
    """The ids of pre-tokens by the library's model itself, which skips its work on whole texts."""
    model, table = _model(path), _characters()
    return [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(table))] for p in pieces]


@cache
def _model(path: str):
    return library(path).model


def parts(text: str, special: tuple[str, ...]) -> list[str]:
    """The text cut at special strings, the longest first where several fit."""
    if not any(s in text for s in special):
        return [text]
    import re

    return re.split("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)), text)


def whole_pieces(path: str, source: str) -> list[str]:
    """The pieces of the vocabulary that are pre-tokens by themselves."""
    tok = library(path)
    return [p for p in tok.decode_batch([[i] for i in range(tok.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False) if p and "\0" not in p and "�" not in p and pretokens.settled(p) and pretokens.split(p, source) == [p]]


def frequent(texts_: DataFrame, path: str, source: str, most: int = FREQUENT, sample: int = SAMPLE) -> tuple[str, bytes]:
    """Tier 1 of the texts (column text) as one string of pre-tokens, split by NUL, and a byte of token count for each."""
    rows = texts_.where(F.length("text") > 0)
    share = sample / max(sample, rows.count())
    chosen = rows.where(F.xxhash64("text") <= F.lit(min(int(share * 2.0**64 - 2.0**63), 2**63 - 1)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = Counter(), set()
        for batch in slices(batches, "text", 2 << 20):
            for t in texts(batch, "text"):
                if hash(t) not in seen and pretokens.settled(t):  # copies of one text add nothing
                    found.update(p for p in pretokens.split(t, source) if len(p) <= pretokens.CACHED_LENGTH and "\0" not in p)
                    seen.add(hash(t))
            if len(found) > 4 * most:
                found = Counter(dict(found.most_common(most)))
        top = found.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    best = chosen.mapInArrow(released(tally), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)
    pieces = [r["piece"] for r in best.select("piece").collect()]
    counts = [len(ids) for ids in piece_ids(path, pieces)]
    kept = [(p, n) for p, n in zip(pieces, counts, strict=True) if n < 256]
    return "\0".join(p for p, _ in kept), bytes(n for _, n in kept)


def counter(path: str, source: str, table: tuple[str, bytes]) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts by two tiers."""
    tok, special = library(path), specials(path)
    fixed = dict(zip(table[0].split("\0"), table[1], strict=True)) if table[1] else {}
    tier = pretokens.Cache(lambda pieces: map(len, piece_ids(path, pieces)), fixed)

    def count(texts: list[str]) -> list[int]:
        cut = [[pretokens.split(x, source) for x in parts(t, special)] if pretokens.settled(t) else None for t in texts]
        tier.learn(pieces for c in cut if c for pieces in c)
        return [
            len(tok.encode(t, add_special_tokens=False).ids) if c is None else len(c) - 1 + sum(sum(map(tier.__getitem__, pieces)) for pieces in c)
            for t, c in zip(texts, cut, strict=True)
        ]

    return count


def count_tokens(df: DataFrame, path: str, source: str, text: str = "text", key: str = "doc_id", limit: int = 1024, most: int = FREQUENT) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of each row. ``source``: the pattern of pre-tokens."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(frequent(rows.select("text"), path, source, most))
    kind = df.schema[key].dataType.simpleString()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept("token_counts", (path, source, shared.value), lambda: counter(path, source, shared.value))
        for batch in slices(batches, "text", 2 << 20):
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = pa.array(count(texts(batch, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    out = rows.mapInArrow(released(counts, "token_counts"), f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
