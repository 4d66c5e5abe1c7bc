"""Gmsh 2 ASCII meshes (S1, S2, S3), arrays (S4) and dispatch by extension."""

from __future__ import annotations

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Nodes of each element type that is known; type 11 is the 10-node tetrahedron.
NODES_OF_TYPE = {1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 8: 3, 9: 6, 11: 10, 15: 1}


class MeshError(ValueError):
    """A mesh that can't be read."""


def parse(text: str) -> dict[str, list]:
    """``nodes`` (id from 0, x, y, z), ``elements`` (id from 0, 10 ids) and ``sets`` (name, node id)."""
    lines = iter(text.splitlines())
    sections: dict[str, list[str]] = {}
    for line in lines:
        name = line.strip()
        if name.startswith("$") and not name.startswith("$End"):
            body = []
            for inner in lines:
                if inner.strip() == f"$End{name[1:]}":
                    break
                body.append(inner)
            sections.setdefault(name[1:], body)
    head = sections.get("MeshFormat", [""])[0].split()
    if len(head) < 2 or not 2 <= float(head[0]) < 3:
        raise MeshError("only version 2 of the format is known")
    if head[1] != "0":
        raise MeshError("only ASCII files are known")
    names = {}
    for line in sections.get("PhysicalNames", ["0"])[1:]:
        if line.split():
            _, tag, name = line.split(maxsplit=2)
            names[int(tag)] = name.split()[0].strip('"')
    number, points = {}, []
    for line in sections.get("Nodes", ["0"])[1:]:
        if part := line.split():
            number[int(part[0])] = len(points)
            points.append(tuple(map(float, part[1:4])))
    elements, sets = [], set()
    for line in sections.get("Elements", ["0"])[1:]:
        part = list(map(int, line.split()))
        if not part:
            continue
        if part[1] not in NODES_OF_TYPE:
            raise MeshError(f"unknown element type {part[1]}")
        try:
            own = [number[n] for n in part[3 + part[2] :][: NODES_OF_TYPE[part[1]]]]
        except KeyError as missing:
            raise MeshError(f"unknown node {missing}") from None
        if part[1] == 11:
            elements.append(own)
        if part[2] and part[3] > 0:
            sets.update((names.get(part[3], str(part[3])), n) for n in own)
    xyz = np.array(points).reshape(-1, 3)
    for conn in elements:  # S2: the two last edge nodes may come in the other order
        if np.sum((xyz[conn[8]] - (xyz[conn[2]] + xyz[conn[3]]) / 2) ** 2) < np.sum((xyz[conn[8]] - (xyz[conn[1]] + xyz[conn[3]]) / 2) ** 2):
            conn[8], conn[9] = conn[9], conn[8]
    return {"nodes": [(i, *p) for i, p in enumerate(points)], "elements": list(enumerate(elements)), "sets": sorted(sets)}


_SCHEMAS = {"nodes": "node_id int, x double, y double, z double", "elements": "elem_id int, conn array<int>", "sets": "set_name string, node_id int"}


class MshSource(DataSource):
    """``spark.read.format("msh").option("part", "nodes").load(path)``; parts: nodes, elements, sets.

    One partition for each file: a section can't be split, and a sector mesh is small.
    """

    @classmethod
    def name(cls) -> str:
        return "msh"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("part", "nodes")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition):
        path = partition.value
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with store.open_input_stream(name) as f:
            yield from parse(f.read().decode())[self.options.get("part", "nodes")]


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a mesh, read through Spark, so that any store works."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise MeshError("empty file")
    found = parse(text[0])
    return from_rows(spark, found["nodes"], found["elements"], found["sets"])


def from_rows(spark: SparkSession, nodes: list, elements: list, sets: list) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, _SCHEMAS[name]) for name, rows in (("nodes", nodes), ("elements", elements), ("sets", sets))}


def from_arrays(spark: SparkSession, coords, conn, sets: dict[str, list[int]], axis: int = 2) -> dict[str, DataFrame]:
    """From arrays of shape (n, 3) and (e, 10)."""
    coords, conn = np.asarray(coords, float), np.asarray(conn, int)
    if coords.ndim != 2 or coords.shape[1] != 3 or conn.ndim != 2 or conn.shape[1] != 10 or axis not in (0, 1, 2):
        raise MeshError("need (n, 3) coordinates, (e, 10) elements and an axis of 0, 1 or 2")
    rows = sorted({(name, int(n)) for name, ids in sets.items() for n in ids})
    return from_rows(spark, [(i, *map(float, p)) for i, p in enumerate(coords)], [(i, list(map(int, c))) for i, c in enumerate(conn)], rows)


def load_mesh(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, DataFrame]:
    """By extension; a set named ``hub`` also counts as ``hub_constraint`` (Q9)."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind != "msh":
        raise MeshError(f"no reader for {kind}")
    mesh = load(spark, path)
    from pyspark.sql import functions as F

    sets = mesh["sets"]
    mesh["sets"] = sets.unionByName(sets.where("set_name = 'hub'").withColumn("set_name", F.lit("hub_constraint"))).distinct()
    return mesh
