import itertools
import math
import re

import pytest

from rotorlake.llm import license_scan, queries, url_filter

URLS = [
    None, "", "no scheme", "http://", "https://www.Example.COM/en/1?x", "http://example.com/en/", "http://example.com/en", "http://a.b.example.com/en/x#y", "http://notexample.com/en/x", "ftp://net/es/1", "http://x.net/fr/", "http://x.net/de/",
    "http://com/", "http://a.com", "http://a.com:80/en/", "http://a.com?/en/", "http://x.net#/es/", "x://y://z.com/", "http://example.com/en/en/x", "http://www.example.com/fr/", "http://net./es/",
]


def judged(url):
    """By trying every rule."""
    rest = (url or "").partition("://")[2]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in queries.RULES:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


@pytest.mark.parametrize("bytes_", [url_filter.TRIE_BYTES, 0])
def test_url_filter_by_trie_and_by_join(spark, bytes_):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, verdict string")
    got = {tuple(r) for r in url_filter.filter_urls(df, queries.RULES, trie_bytes=bytes_).collect()}
    assert got == {(i, *judged(u)) for i, u in enumerate([*URLS, *URLS])}
    assert url_filter.filter_urls(df.limit(0), queries.RULES, trie_bytes=bytes_).count() == 0


def test_trie_prefers_longer_hosts_and_blocks_and_takes_partial_segments():
    trie = url_filter.Trie([("allow", "a.com/"), ("block", "com/x/"), ("allow", "com/p"), ("block", "com/p"), ("block", "b.com")])
    assert trie.match("a.com", "/x/1") == ("allow", "a.com/")
    assert trie.match("c.com", "/pq") == ("block", "com/p")
    assert trie.match("d.b.com", "") == ("block", "b.com")
    assert trie.match("com", "/q") is None


def cosine(text, vector, idf, other):
    counts = {w: license_scan.words(text).count(w) * idf.get(w, other) for w in license_scan.words(text)}
    norm = math.sqrt(sum(v * v for v in counts.values()))
    return sum(v * vector.get(w, 0.0) for w, v in counts.items()) / norm if norm else 0.0


MIT = """/*
 * The MIT License (MIT)
 *
 * Copyright (c) 2020 Foo Inc.
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
 * documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
 * rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
 * persons to whom the Software is furnished to do so, subject to the following conditions:
 */
int main() {}"""


def test_license_scan_against_all_cosines(spark, odd, none):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "under the apache license version 2.0 and more words that are not in it at all", "the the the", None, "x\nReleased under the MIT License.\ny", "licensed under cc by 4.0", "All rights reserved, and so on",
        MIT, "# SPDX-License-Identifier: MIT\nimport os", "Copyright (c) 2020 Foo Inc. All rights reserved.", "// This file is released under the MIT License, see LICENSE for details.", "use in the file of this code that can be found",
    ]
    rows = [(i, f"a/{i % 2}/f{i}", t) for i, t in enumerate(texts)] + [(90, "a/0/c/d/g", "plain"), (91, None, "All rights reserved."), (92, "top", "plain")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == len(rows)
    idf, other, vectors = license_scan.weights(license_scan.TEMPLATES)
    for i, path, text in rows:
        paragraphs = ["\n".join(ls) for word, ls in ((w, list(g)) for w, g in itertools.groupby((text or "").split("\n"), lambda x: bool(re.search("[A-Za-z0-9]", x)))) if word]
        segments = [s for s in (text or "", *(text or "").split("\n"), *paragraphs) if set(license_scan.words(s)) & set(license_scan.KEYS)]
        best = max(((round(cosine(s, v, idf, other), 6), name) for s in segments for name, v in vectors), key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0, ""))
        assert got[i]["own_license"] == (best[1] if path and best[0] >= license_scan.LEAST else None), (i, best)
    assert [got[i]["own_license"] for i in (7, 8, 9, 10, 11)] == ["MIT", "MIT", "Proprietary", "MIT", None]
    assert got[90]["license"] == "Apache-2.0" and got[90]["inherited_from"] == "a/0" and got[92]["license"] is None
    scanned = license_scan.scan(odd.withColumnRenamed("source", "path"))
    assert scanned.count() == odd.count()
    assert license_scan.scan(none.withColumnRenamed("source", "path")).count() == 0


def test_every_wording_has_a_key_word():
    assert all(set(license_scan.words(t)) & set(license_scan.KEYS) for ts in license_scan.TEMPLATES.values() for t in ts)
    pattern = re.compile(license_scan.any_of(license_scan.KEYS))
    assert all(pattern.fullmatch(w) for w in license_scan.KEYS) and not pattern.fullmatch("li") and not pattern.fullmatch("mits")
