"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule is ``host/path``. It fits its host and every subdomain, where the URL's path starts
with the rule's path. The longest fitting rule wins; of equally long ones the one with the
longer host, then a block rule. A URL that no rule fits gets ``default`` as its verdict and
null as its rule. Null, empty and relative URLs have an empty host and path, which no rule fits.

The trie is broadcast while it is at most ``TRIE_BYTES`` when serialised. Larger rule sets
are joined on (host suffix, full path segments) instead, which needs no bound.

Rows are judged one by one: ties and repeated rows don't matter, other columns aren't read,
an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released


TRIE_BYTES = 32 << 20
_HOST, _PATH = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_FOLD), slash + path


class Trie:
    """Nodes are ``[children by label, path node or None]``; path nodes ``[children by segment, tails]``.

    A tail is the part of a rule's path after its last full segment: a prefix of what the
    URL has there ('' for a rule that ends with '/').
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, None]
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_FOLD).split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = at = node[1] or [{}, {}]
            *full, tail = path.split("/") if slash else [None]
            for segment in full:
                at = at[0].setdefault(segment, [{}, {}])
            if at[1].get(tail, ("allow",))[0] != "block":
                at[1][tail] = (verdict, rule)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest fitting rule, or None."""
        best, length = None, -1
        node = self.root
        segments = path[1:].split("/") if path[:1] == "/" else None
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            at, depth = node[1], 0
            while at is not None:
                for tail, found in at[1].items():
                    fits = tail is None or segments is not None and "/".join(segments[depth:]).startswith(tail)
                    if fits and len(found[1]) >= length:  # a longer host comes later and wins ties
                        best, length = found, len(found[1])
                if segments is None or depth >= len(segments) - 1:
                    break
                at, depth = at[0].get(segments[depth]), depth + 1
        return best


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``key, host, path, rule, verdict`` of each row; other columns of ``df`` aren't read."""
    trie = Trie(rules)
    if len(pickle.dumps(trie)) > trie_bytes:
        return _joined(df, rules, url, key, default)
    shared = df.sparkSession.sparkContext.broadcast(trie)
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shared.value.match
        for batch in batches:
            parts = [split_url(x) for x in batch.column(1).to_pylist()]
            found = [match(*x) or (default, None) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], [r for _, r in found], [v for v, _ in found]))],
                names=["key", "host", "path", "rule", "verdict"],
            )

    out = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).mapInArrow(released(judge), f"key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)


def _joined(df: DataFrame, rules: list[tuple[str, str]], url: str, key: str, default: str) -> DataFrame:
    """The same by equi-joins, for rule sets beyond the broadcast bound.

    A rule's path is its full segments, up to the last '/', and a tail that what follows in
    the URL begins with. A URL has a row for each of its host's suffixes and each number of
    full segments, as far as any rule goes; rules that share both differ in tails alone.
    """
    spark = df.sparkSession
    cut = [(v, r, *r.partition("/")) for v, r in rules]
    rows = [(v, r, host.translate(_FOLD), *(slash + path).rpartition("/")[::2], bool(slash)) for v, r, host, slash, path in cut]
    depth = max((full.count("/") + 1 for *_, full, _, slash in rows if slash), default=0)
    known = spark.createDataFrame([(v, r, host, full if slash else None, tail if slash else "") for v, r, host, full, tail, slash in rows], "verdict string, rule string, suffix string, full string, tail string")
    url_ = F.coalesce(F.col(url).cast("string"), F.lit(""))
    parts = df.select(F.col(key).alias("key"), F.translate(F.regexp_extract(url_, _HOST, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url_, _PATH, 1).alias("path"))
    distinct = parts.select("host", "path").distinct().where("host <> ''")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # null stands for rules without a path, which fit any; i slashes stand before the tail otherwise
    places = F.concat(F.array(F.lit(0)), F.when(F.startswith("path", F.lit("/")), F.sequence(F.lit(1), F.least(F.lit(max(1, depth)), F.size(segments) - 1))).otherwise(F.expr("cast(array() as array<int>)")))
    full = F.when(F.col("i") > 0, F.array_join(F.slice(segments, F.lit(1), F.col("i")), "/"))
    near = distinct.withColumn("suffix", F.explode(suffixes)).withColumn("i", F.explode(places)).withColumn("full", full)
    tail = F.when(F.col("i") > 0, F.substring(F.col("path"), F.length("n.full") + 2, F.length("path"))).otherwise(F.col("path"))
    hit = near.alias("n").join(known.alias("k"), F.expr("n.suffix = k.suffix and n.full <=> k.full")).select("n.host", "n.path", tail.alias("rest"), "k.verdict", "k.rule", "k.suffix", "k.tail")
    fits = (
        hit.where(F.startswith("rest", F.col("tail")))
        .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("suffix").alias("h"), "verdict", "rule")).alias("best"))
    )
    return parts.join(fits, ["host", "path"], "left").select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
