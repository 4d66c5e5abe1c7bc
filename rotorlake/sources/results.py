"""Sinks and sources of results: CSV, VTK XML, padded archives, and unit sniffers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import modal


def campbell_rows(modes: DataFrame, sectors: int) -> DataFrame:
    """Stationary frequencies as the text that the CSV holds."""
    rows = modal.campbell(modes, sectors)
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    return rows.select(number("rpm").alias("rpm"), F.col("k").alias("harmonic_index"), F.col("family").alias("mode_family"), number("freq_hz").alias("frequency_hz"), F.col("whirl").alias("whirl_direction"))


def zzenf_rows(modes: DataFrame) -> DataFrame:
    """Rotating-frame frequencies as the text that the CSV holds."""
    rows = modal.ranked(modes, ["rpm", "k"], ["freq_hz", "mode_idx"], "mode_family")
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    return rows.select(F.col("k").alias("nodal_diameter"), "mode_family", number("freq_hz").alias("frequency_hz"), number("rpm").alias("rpm"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def write_results(modes: DataFrame, path: str) -> None:
    """Modes partitioned by speed, so that a reader of one speed reads one folder."""
    modes.write.partitionBy("rpm").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_npz(campbell: DataFrame, path: str) -> None:
    """The padded arrays of a small table, in one local file of the driver."""
    freq, rpm, k = modal.padded(campbell)
    np.savez(path, frequencies=freq, rpm=np.array(rpm, float), harmonics=np.array(k, int))


def load_npz(spark: SparkSession, path: str) -> DataFrame:
    with np.load(path) as f:
        at = np.argwhere(~np.isnan(f["frequencies"]))
        rows = [(float(f["rpm"][i]), int(f["harmonics"][j]), int(m) + 1, float(f["frequencies"][i, j, m])) for i, j, m in at]
    return spark.createDataFrame(rows, "rpm double, k int, family int, freq_hz double")


def vtu(nodes: np.ndarray, conn: np.ndarray, shape: np.ndarray) -> str:
    """An unstructured grid of 10-node tetrahedra (type 24) with a complex displacement (n, 3)."""
    array = lambda name, kind, data, width=1: f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{width}" format="ascii">\n' + " ".join(format(x, ".10g") for x in np.ravel(data)) + "\n</DataArray>\n"
    size = np.sqrt((np.abs(shape) ** 2).sum(axis=1))
    return (
        '<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian">\n<UnstructuredGrid>\n'
        f'<Piece NumberOfPoints="{len(nodes)}" NumberOfCells="{len(conn)}">\n<Points>\n' + array("Points", "Float64", nodes, 3) + "</Points>\n<Cells>\n"
        + array("connectivity", "Int32", conn) + array("offsets", "Int32", 10 * np.arange(1, len(conn) + 1)) + array("types", "UInt8", np.full(len(conn), 24)) + "</Cells>\n<PointData>\n"
        + array("displacement_real", "Float64", shape.real, 3) + array("displacement_imag", "Float64", shape.imag, 3) + array("displacement_magnitude", "Float64", size)
        + "</PointData>\n</Piece>\n</UnstructuredGrid>\n</VTKFile>\n"
    )


def write_vtu(nodes: DataFrame, elements: DataFrame, shape: DataFrame, path: str) -> None:
    """One file of a sector's mode (node_id, ux_re, ux_im, ...); a sector mesh fits the driver."""
    n = nodes.orderBy("node_id").toPandas()
    s = nodes.select("node_id").join(shape, "node_id", "left").orderBy("node_id").toPandas().fillna(0.0)
    u = np.stack([s[f"u{c}_re"] + 1j * s[f"u{c}_im"] for c in "xyz"], axis=1)
    conn = np.array([r["conn"] for r in elements.orderBy("elem_id").collect()], int).reshape(-1, 10)
    with open(path, "w") as f:
        f.write(vtu(n[["x", "y", "z"]].to_numpy(), conn, u))


#: Metres per unit, by SI prefix, by name of a conversion-based unit, by IGES flag.
SI_PREFIX = {"MILLI": 1e-3, "CENTI": 1e-2, "DECI": 1e-1, "KILO": 1e3, "MICRO": 1e-6}
CONVERSION = {"INCH": 0.0254, "FOOT": 0.3048, "MILE": 1609.344, "YARD": 0.9144}
IGES_FLAG = {1: 0.0254, 2: 1e-3, 4: 0.3048, 5: 1609.344, 6: 1.0, 7: 1e3, 8: 2.54e-5, 9: 1e-6, 10: 1e-2, 11: 2.54e-8}
IGES_NAME = {
    "MM": 1e-3, "MILLIMETER": 1e-3, "MILLIMETRE": 1e-3, "CM": 1e-2, "CENTIMETER": 1e-2, "CENTIMETRE": 1e-2, "M": 1.0, "METER": 1.0, "METRE": 1.0, "IN": 0.0254, "INCH": 0.0254, "FT": 0.3048, "FOOT": 0.3048, "UM": 1e-6,
}


def step_unit(text: str) -> float | None:
    """Metres per length unit of a STEP file, or None."""
    for m in re.finditer(r"SI_UNIT\s*\(\s*(\$|\.(\w+)\.)\s*,\s*\.METRE\.\s*\)", text):
        if (unit := SI_PREFIX.get(m[2]) if m[2] else 1.0) is not None:
            return unit
    if m := re.search(r"CONVERSION_BASED_UNIT\s*\(\s*'(\w+)'", text):
        return CONVERSION.get(m[1].upper())
    return None


def iges_unit(text: str) -> float | None:
    """Metres per unit of an IGES file, from parameter 14 of its global section, or where that
    is 3, by the name in parameter 15; None for anything else."""
    body = "".join(line[:72] for line in text.splitlines() if line[72:73] == "G")
    found, at = [], 0
    while at < len(body):
        if m := re.compile(r"\s*(\d+)H").match(body, at):
            end = m.end() + int(m[1])
            found.append(body[m.end() : end])
            at = end + 1
        else:
            cut = re.compile(r"[,;]").search(body, at)
            end = cut.start() if cut else len(body)
            found.append(body[at:end].strip())
            at = end + 1
    try:
        flag = int(found[13])
        return IGES_NAME.get(found[14].strip().upper()) if flag == 3 else IGES_FLAG.get(flag)
    except (IndexError, ValueError):
        return None
