"""Models against versions in plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rotorlake.llm import langid, quality_gam

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def naive_features(text):
    text = text or ""
    w = [x.encode() for x in SPACED.findall(text)]
    raw, n, size = text.encode(), max(len(w), 1), max(sum(map(len, w)), 1)

    def repeats(k):
        grams = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({j for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / size
    return [
        math.log1p(len(w)), size / n, share(b"#*$%&|<>"), share(range(65, 91)), share(range(48, 58)), share(b",.;:"), share(b"|"), share(b"!?"), math.log1p(len(w) / len(lines)), dup / len(lines),
        repeats(2) / n, repeats(4) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, len(set(w)) / n if w else 1.0, sum(len(x) <= 3 for x in w) / n,
    ]


def test_features_by_brute_force(odd_texts):
    got = quality_gam.features(pa.array(odd_texts, pa.string()))
    assert np.allclose(got, [naive_features(t) for t in odd_texts], rtol=1e-12, atol=1e-12)


def naive_split(cells):
    """Of (gradient, weight) by bin: (gain, place)."""
    best = (0.0, 0)
    total, mass = sum(g for g, _ in cells), sum(w for _, w in cells)
    for at in range(1, len(cells)):
        g, w = sum(g for g, _ in cells[:at]), sum(w for _, w in cells[:at])
        if w >= quality_gam.LEAST_WEIGHT and mass - w >= quality_gam.LEAST_WEIGHT:
            gain = g * g / w + (total - g) ** 2 / (mass - w) - total * total / mass
            if gain > best[0] + 1e-12:
                best = (gain, at)
    return best


def naive_tree(cells, depth=2):
    gain, at = naive_split(cells) if depth else (0.0, 0)
    if gain <= 1e-9:
        return [sum(g for g, _ in cells) / (sum(w for _, w in cells) + 1.0)] * len(cells)
    return naive_tree(cells[:at], depth - 1) + naive_tree(cells[at:], depth - 1)


def naive_pair(grid):
    """Of a grid of (gradient, weight): (gain, steps)."""
    best = (-1.0, None)
    for flip in (False, True):
        g = [list(r) for r in zip(*grid, strict=True)] if flip else grid
        for at in range(1, len(g)):
            total, mass = sum(c[0] for r in g for c in r), sum(c[1] for r in g for c in r)
            gain, out = -total * total / (mass + 1e-9), []
            for rows in (g[:at], g[at:]):
                columns = [(sum(r[j][0] for r in rows), sum(r[j][1] for r in rows)) for j in range(len(g[0]))]
                _, cut = naive_split(columns)
                steps = []
                for part in (columns[:cut], columns[cut:]):
                    a, b = sum(x for x, _ in part), sum(x for _, x in part)
                    gain += a * a / (b + 1e-9)
                    steps += [a / (b + 1.0)] * len(part)
                out += [steps] * len(rows)
            if gain > best[0] + 1e-12:
                best = (gain, [list(r) for r in zip(*out, strict=True)] if flip else out)
    return best


def naive_scores(x, y, rounds, pair_rounds):
    n, m = len(y), len(x[0])
    rate = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    margin = [math.log(rate / (1 - rate))] * n

    def bins(k, many):
        edges = sorted({float(np.quantile([r[k] for r in x], i / many)) for i in range(1, many)})
        return [sum(e <= r[k] for e in edges) for r in x], len(edges) + 1

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in margin]
        return [(t - q, q * (1 - q)) for t, q in zip(y, p, strict=True)]

    fine, coarse = [bins(k, quality_gam.BINS) for k in range(m)], [bins(k, quality_gam.PAIR_BINS) for k in range(m)]
    for _ in range(rounds):
        for of, size in fine:
            s = slopes()
            cells = [(sum(s[i][0] for i in range(n) if of[i] == b), sum(s[i][1] for i in range(n) if of[i] == b)) for b in range(size)]
            step = naive_tree(cells)
            margin = [min(max(v + quality_gam.RATE * step[of[i]], -15), 15) for i, v in enumerate(margin)]

    def grid(i, j):
        s = slopes()
        out = [[[0.0, 0.0] for _ in range(coarse[j][1])] for _ in range(coarse[i][1])]
        for r in range(n):
            cell = out[coarse[i][0][r]][coarse[j][0][r]]
            cell[0] += s[r][0]
            cell[1] += s[r][1]
        return out

    every = [(i, j) for i in range(m) for j in range(i + 1, m)]
    chosen = sorted(every, key=lambda k: -naive_pair(grid(*k))[0])[: quality_gam.PAIRS]
    for _ in range(pair_rounds):
        for i, j in chosen:
            step = naive_pair(grid(i, j))[1]
            margin = [min(max(v + quality_gam.RATE * step[coarse[i][0][r]][coarse[j][0][r]], -15), 15) for r, v in enumerate(margin)]
    return [1 / (1 + math.exp(-v)) for v in margin]


def test_boosting_by_brute_force(monkeypatch):
    r = np.random.default_rng(5)
    monkeypatch.setattr(quality_gam, "FEATURES", ("a", "b", "c"))
    monkeypatch.setattr(quality_gam, "PAIRS", 2)
    monkeypatch.setattr(quality_gam, "ROUNDS", 6)
    monkeypatch.setattr(quality_gam, "PAIR_ROUNDS", 4)
    x = r.normal(size=(120, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0.3)).astype(float)
    got = quality_gam.fit(x, y).score(x)
    assert np.allclose(got, naive_scores(x.tolist(), y.tolist(), 6, 4), rtol=1e-9)


def cuts(s, known):
    """Every way to cut a string into known pieces and single letters."""
    if not s:
        return [[]]
    return [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in known or k == 1 for rest in cuts(s[k:], known)]


def test_expected_piece_counts_by_enumeration():
    known = [langid.MARK, "a", "b", "ab", langid.MARK + "a", langid.MARK + "ab", "ba", "abab", "c"]
    counts = {"x": Counter({"ab": 5, "abab": 2, "ba": 1}), "y": Counter({"baab": 3, "c": 4, "zb": 1})}
    model = langid.fit(counts, known)
    for at, language in enumerate(sorted(counts)):
        words = [(langid.MARK + w, c) for w, c in counts[language].items()]
        p = dict.fromkeys((piece for s, _ in words for own in cuts(s, set(known)) for piece in own), 1.0)
        for _ in range(langid.ROUNDS):
            expected = dict.fromkeys(p, 0.0)
            for s, c in words:
                ways = [(own, math.prod(p[piece] for piece in own)) for own in cuts(s, set(known))]
                for own, weight in ways:
                    for piece in own:
                        expected[piece] += c * weight / sum(x for _, x in ways)
            p = {piece: (x + 0.01) / sum(expected.values()) for piece, x in expected.items()}
        for piece, row in model.table.items():
            assert math.isclose(row[at], max(p.get(piece, 0.0), langid.PRIOR), rel_tol=1e-9)
    assert set(model.table) <= set(known) and "z" not in model.table


def test_predictions_by_enumeration():
    known = [langid.MARK, "a", "b", "ab", langid.MARK + "a", "c"]
    model = langid.fit({"x": Counter({"ab": 5, "a": 2}), "y": Counter({"bc": 3, "c": 4})}, known)
    texts = ["ab a", "c bc c", "Ab, c!", "12 ?", "b"]
    names, scores = langid.Scorer(model).score(texts)

    def word(w, k):
        value = lambda piece: (model.table[piece][k] if piece in model.table else 0.0) + (langid.UNKNOWN if len(piece) == 1 else 0.0)
        return sum(math.prod(map(value, own)) for own in cuts(langid.MARK + w, set(known)))

    for text, name, score in zip(texts, names, scores, strict=True):
        found = re.findall("[a-z]+", text.lower())
        if not found:
            assert (name, score) == ("und", 0.0)
            continue
        total = [math.prod(word(w, k) for w in found) for k in range(2)]
        best = max(range(2), key=lambda k: (total[k], -k))
        assert name == model.languages[best] and score == pytest.approx(total[best] / sum(total), rel=1e-5)
