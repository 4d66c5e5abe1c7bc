import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rotorlake.llm import byte_bpe, queries, simple8b, token_counts, token_files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_tiktoken(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_byte_bpe_is_that_of_the_reference_library(odd):
    got = rows(byte_bpe.round_trip(odd, queries.RANKS, public.PATTERN))
    want = []
    for r in odd.collect():
        ids = by_tiktoken(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_byte_bpe_columns_and_empty_table(odd, none):
    coded = byte_bpe.decode(byte_bpe.encode(odd, queries.RANKS, public.PATTERN), queries.RANKS, public.PATTERN)
    assert coded.columns == [*odd.columns, "token_ids", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in coded.collect())
    assert byte_bpe.round_trip(none, queries.RANKS, public.PATTERN).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_on_any_text(text):
    codec = byte_bpe.codec(queries.RANKS, public.PATTERN)
    (ids,) = codec.encode([text])
    assert ids.tolist() == by_tiktoken(text) and codec.decode(ids) == text.encode()


def test_counts_are_the_librarys(odd, none):
    tok = token_counts.library(queries.TOKENIZER)
    want = []
    for r in odd.collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024))
    assert rows(token_counts.count_tokens(odd, queries.TOKENIZER, public.PATTERN)) == sorted(want, key=repr)
    assert token_counts.count_tokens(none, queries.TOKENIZER, public.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, offsets, exceptions = simple8b.pack(a)
    assert np.array_equal(simple8b.unpack(words, offsets, exceptions, len(a)), a)
    assert len(offsets) == -(-len(a) // simple8b.BLOCK) + 1


def test_token_files(spark, odd, none, tmp_path):
    tok = token_counts.library(queries.TOKENIZER)
    for name, df in (("odd", odd), ("none", none)):
        folder = f"file://{tmp_path}/{name}"
        token_files.write(df, folder, queries.TOKENIZER, public.PATTERN, 2, segment_ids=500)
        got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
        source = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or ""))
        start = 0
        assert len(got) == len(source)
        for g, s in zip(got, source, strict=True):
            ids = [*tok.encode(s["text"] or "", add_special_tokens=False).ids, 2]
            assert (g["doc_id"], g["start"], g["n_tokens"], g["token_ids"]) == (s["doc_id"], start, len(ids), ids)
            assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_encoder_looks_up_each_pretoken_once_and_stays_bounded(monkeypatch):
    encoder = token_files.Encoder(queries.TOKENIZER, public.PATTERN, ("the", " the"))
    asked, one = [], encoder.cache.one
    monkeypatch.setattr(encoder.cache, "one", lambda piece: (asked.append(piece), one(piece))[1])
    found = [f"the the zq{i}x zq{i}x {'y' * 70} \u00e9" for i in range(40)] + ["", "a\U0001f600", "<|endoftext|>"]
    want = [token_files.library(queries.TOKENIZER).encode(t, add_special_tokens=False).ids + [2] for t in found]
    ids = lambda: [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(found, 2)]
    assert ids() == ids() == want
    short = [piece for piece in asked if len(piece) <= 64]
    assert len(short) == len(set(short)) > 5 and "the" not in asked and max(map(len, encoder.cache)) <= 64
    encoder.cache.entries = 10
    assert ids() == want and len(encoder.cache) <= 2 + 10 + 8
