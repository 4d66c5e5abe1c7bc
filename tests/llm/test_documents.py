import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rotorlake.llm import components, decontam, langid, ngram_join, quality_gam, quality_rules, queries, textstats

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_hashes_of_ranges_do_not_depend_on_what_is_around():
    a, b = np.frombuffer(b"xx hello yy", np.uint8), np.frombuffer(b"hello" + b"z" * 40_000, np.uint8)
    assert textstats.hashes(a, np.array([3]), np.array([8]))[0] == textstats.hashes(b, np.array([0, 5]), np.array([5, 40_005]))[0]
    long = np.frombuffer(b"ab" * 20_000, np.uint8)
    assert len(set(textstats.hashes(long, np.array([0, 1]), np.array([39_998, 39_999])).tolist())) == 2


def naive_leaks(docs, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOW))
    out, phrases = [], defaultdict(set)
    for item, t in items:
        p = cut(t)
        for i in range(max(1, len(p) - width + 1) if p else 0):
            phrases[tuple(p[i : i + width])].add(str(item))
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(q) for q in phrases}:
            for at in range(len(w) - n + 1):
                if (q := tuple(w[at : at + n])) in phrases:
                    hit.update(range(at, at + n))
                    found |= phrases[q]
        out.append((key, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [1 << 20, 150])
def test_leaks_by_brute_force(spark, odd, none, odd_texts, chars):
    base = odd_texts[9]
    items = [(1, " ".join(base.split()[50:75])), (2, "a b"), (10, base.upper()[:90]), (3, None), (4, "..."), (5, "a a a"), (6, "ta ta ta ta ta ta ta ta ta ta ta")]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(77, "ta " * 40), (78, "a a a a b a a b")]
    df = odd.select("doc_id", "text", "bucket").unionByName(spark.createDataFrame(docs[-2:], "doc_id long, text string"), allowMissingColumns=True)
    leaks = decontam.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), item_chars=chars)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["item_ids"]) for r in leaks.collect()), key=repr)
    assert got == naive_leaks(docs, items, 10)
    unnamed = decontam.find_leaks(df, spark.createDataFrame([(None, "a b"), (None, "c d")], "item_id long, text string"))
    assert {tuple(r["item_ids"]) for r in unnamed.collect()} == {(), ("",)}
    nobody = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(none, nobody).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.find_leaks(df, nobody).collect())


def test_equal_blocks_stay_apart_over_several_passes(spark):
    one = spark.createDataFrame([(None, "alpha beta gamma")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, text string")
    rows = decontam.find_leaks(one.union(one), items, item_chars=10).collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in rows] == [(None, 3, 3, ["1", "2"])] * 2


def test_near_phrases_are_counted(spark):
    docs = spark.createDataFrame([(1, "x delta beta filler alpha gamma y"), (2, "alpha " + "z " * 60 + "beta gamma delta")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_items"], r["n_near"]) for r in decontam.find_leaks(docs, spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")).collect()}
    assert found == {1: (0, 1), 2: (0, 0)}


def naive_groups(docs, percent=75):
    sets = []
    for _, text in docs:
        w = SPACED.findall((text or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(docs)):
        low[find(i)].append(docs[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((docs[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(docs))), key=repr)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()), key=repr)


def test_near_duplicates_by_brute_force(odd, none):
    assert joined(odd) == naive_groups([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert ngram_join.near_duplicates(none).count() == 0


def test_near_duplicates_in_long_lists(spark, odd_texts):
    """A large group of near copies, short texts and shared passages."""
    base = odd_texts[9].split()
    r = np.random.default_rng(3)
    docs = []
    for i in range(90):
        w = list(base)
        for k in r.choice(len(w), int(r.integers(0, 9)), replace=False):
            w[k] = f"w{i}"
        docs.append((200 - i, " ".join(w)))
    docs += [(300 + i, " ".join([*base[:60], *(f"u{i}x{k}" for k in range(int(r.integers(20, 120))))])) for i in range(30)]
    docs += [(400 + i, " ".join(f"s{i % 4}w{k}" for k in range(1 + i % 7))) for i in range(40)]
    assert joined(spark.createDataFrame(docs, "doc_id long, text string")) == naive_groups(docs)


def test_contract_finds_components():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 500, 400), r.integers(0, 500, 400)
    child, root = components.contract(a, b)
    parent = dict(zip(child.tolist(), root.tolist(), strict=True))
    full = {x: {x} for x in range(500)}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if full[x] is not full[y]:
            both = full[x] | full[y]
            for z in both:
                full[z] = both
    assert all(parent.get(x, x) == min(full[x]) for x in {*a.tolist(), *b.tolist()})


def test_components_over_several_tasks(spark):
    links = spark.range(60).selectExpr("id as a", "id + 1 as b").where("a <> 30")
    found = {r["child"]: r["root"] for r in components.components(links, per_task=7).collect()}
    assert found == {i: 0 if i <= 30 else 31 for i in range(61) if i not in (0, 31)}


def test_components_whose_links_do_not_meet_in_a_task(spark):
    """Chains over many parts, one hub, and random links, with more stars left than a task takes."""
    r = np.random.default_rng(1)
    path = r.permutation(300)
    a = np.concatenate([path[:-1], np.full(200, 1000), r.integers(2000, 2400, 250)])
    b = np.concatenate([path[1:], np.arange(1001, 1201), r.integers(2000, 2400, 250)])
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")
    child, root = components.contract(a, b)
    rows = components.components(links, per_task=100).collect()
    assert sorted((x["child"], x["root"]) for x in rows) == sorted(zip(child.tolist(), root.tolist(), strict=True))


def test_languages_on_held_out_rows(spark, sf_dir, odd, none):
    rows = queries.op6_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0
    model = langid.train(odd.where("doc_id <> 13"), queries.PIECES)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == got[7] == got[8] == ("und", 0.0) and got[9][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    empty = langid.train(none, queries.PIECES)
    assert langid.identify(none, empty).count() == 0 and {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    table = {p: np.array([v]) for p, v in (("▁", 0.1), ("a", 0.2), ("b", 0.3), ("ab", 0.4), ("▁a", 0.05), ("▁ab", 0.01))}
    model = langid.Model(["x"], table)

    def total(s):
        return 1.0 if not s else sum(table.get(s[:k], [langid.UNKNOWN if k == 1 else 0.0])[0] * total(s[k:]) + (langid.UNKNOWN * total(s[1:]) if k == 1 and s[:1] in table else 0) for k in range(1, len(s) + 1))

    scorer = langid.Scorer(model)
    for w in ("ab", "abab", "ba", "zab"):
        assert np.isclose(np.exp(model.forward(w))[0], total("▁" + w)) and np.isclose(np.exp(scorer.forward([w]))[0, 0], total("▁" + w))
    assert np.isclose(model.forward("ab" * 3000)[0] / 3000, model.forward("ab" * 1500)[0] / 1500, rtol=1e-2)


def naive_rules(text):
    text = text or ""
    w = SPACED.findall(text)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def naive_coverage(text):
    """Shares of word bytes in lines that repeat, and in n-grams that do."""
    text = text or ""
    w = [x.encode() for x in SPACED.findall(text)]
    size, seen, lines = max(1, sum(map(len, w))), set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            lines += sum(len(x.encode()) for x in SPACED.findall(line)) if line in seen else 0
            seen.add(line)
    out = [lines / size]
    for n in quality_rules.NGRAM_SHARES:
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        out.append(sum(len(w[j]) for j in {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}) / size)
    return out


def test_quality_rules_by_brute_force(spark, odd, none):
    mixed = [" ".join([*(f"w{i}" for i in range(60)), *(f"v{i}" for i in range(k)), "z", *(f"v{i}" for i in range(k))]) for k in (2, 4, 8, 14, 25)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(mixed)], "doc_id long, text string"))
    got = quality_rules.judge(df).collect()
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in got:
        base, shares = naive_rules(text[r["doc_id"]]), naive_coverage(text[r["doc_id"]])
        assert tuple(r)[1:7] == base and np.allclose(tuple(r)[8:], shares)
        assert r["kept"] == (not base[-1] and all(x <= most for x, most in zip(shares, [quality_rules.LINE_SHARE, *quality_rules.NGRAM_SHARES.values()], strict=True)))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == df.count() and kept[9] and not kept[3] and len({kept[500 + i] for i in range(5)}) == 2
    assert quality_rules.judge(none).count() == 0


def test_quality_coverage_by_brute_force():
    t = "a b c d e f a b c d e g a b c d e " + " ".join(f"w{i}" for i in range(60))
    w = t.split()
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    found = quality_rules.Texts(pa.array(["other a b c d e", t, ""]))
    assert np.flatnonzero(found.in_repeats(5)[found.of == 1]).tolist() == sorted(inside) and not found.in_repeats(5)[found.of == 0].any()


def test_quality_scores_on_held_out_rows(spark, sf_dir, odd, none):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op10_quality_classifier(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.9 * len(rows) > 0
    model = quality_gam.train(odd, labels)
    scored = quality_gam.classify(odd, model)
    assert scored.columns == [*(c for c in odd.columns if c != "score"), "score"] and all(0 <= r["score"] <= 1 for r in scored.collect())
    assert quality_gam.classify(none, quality_gam.train(none, labels)).count() == 0
    blank = quality_gam.train(odd, labels.where("quality > 5"))
    assert {r["score"] for r in quality_gam.classify(odd, blank).collect()} == {0.5}
