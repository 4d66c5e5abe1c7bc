import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, list long, score double"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ta", "ri", "mo", "el", "un", "ka")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated, near copies, odd characters."""
    base = prose(1, 200)
    words = base.split()
    near = [" ".join([*words[:k], "zzz", *words[k + 1 :]]) for k in (10, 60, 110, 150, 190)]
    return [
        None, "", " \n\t ", "a", "a b", "a b c d", "a  b\nc d", "!!! ... ###", "12 34 56", base, base, base.upper(), *near, prose(2, 200), prose(3, 40_000), "x" * 100_000, "日本語の文章 です。", "naïve café — “quoted”… 3² \u00a0x",
        "line one here\nline one here\n\nline two\nline one here", "<|endoftext|> in a text<|endoftext|>", "emoji 🎉🎊 \u0378 new", "\x00\x01 tab\tend", prose(4, 30) + "\nReleased under the MIT License.", "All rights reserved.\n" + prose(5, 30),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """Those texts as documents with columns whose names operators use inside, a repeated row and a null id."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), "k", 1, 2, 0.5) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame([*rows, rows[9], (None, "null id text here now", None, None, 1, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
