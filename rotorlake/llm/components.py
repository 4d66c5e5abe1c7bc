"""Connected components of a list of links, without collecting them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored

#: Links that one task contracts.
LINKS_PER_TASK = 1 << 21


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end that isn't the smallest of its component here, with that smallest one."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(ends))
    return ends[moved], ends[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        child, root = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(root, pa.int64())], names=["child", "root"])


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.min("root").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """All roots of a child, and the child, under the smallest of these roots."""
    low = _smallest(edges)
    others = edges.join(low, "child").where("root > low").select(F.col("root").alias("child"), F.col("low").alias("root"))
    return low.withColumnRenamed("low", "root").unionByName(others).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each child under the smallest root of its root, if that has one."""
    low = _smallest(edges).withColumnRenamed("child", "root")
    return edges.join(low, "root", "left").select("child", F.coalesce("low", "root").alias("root")).distinct()


def _loose(edges: DataFrame) -> bool:
    """Whether a child has several roots or a root that is a child."""
    several = edges.groupBy("child").count().where("count > 1")
    return not several.isEmpty() or not edges.join(edges.select(F.col("root").alias("child")), "child", "left_semi").isEmpty()


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    out = stored(new, "stars")
    removed(old)
    return out


def components(links: DataFrame, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``child, root`` for every end of a link (columns a, b: long) but the smallest of its component.

    Up to ``per_task`` links are contracted in one task. More are contracted to stars in parts,
    then small and large stars (Kiveris et al., 2014) alternate as joins of children with the
    roots they hang under, wherever these lie, until each child has one root that is no child.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(links.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("root")).where("child <> root").distinct(), "links")
    n = edges.count()
    if n > per_task:
        edges = _replaced(edges, edges.repartition(-(-n // per_task), "child").mapInArrow(_local, "child long, root long").distinct())
        while edges.count() > per_task:
            if not _loose(edges):
                return edges
            edges = _replaced(edges, _small_star(edges))
            edges = _replaced(edges, _large_star(edges))
    return _replaced(edges, edges.coalesce(1).mapInArrow(_local, "child long, root long").distinct())
