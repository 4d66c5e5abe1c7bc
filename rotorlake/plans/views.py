"""Views of the driver's tables as the engine's inputs, for queries and, as SQL, for their check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTORS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modal(spark, d) -> DataFrame:
    """rpm, k, mode_idx, freq_hz, whirl: one row for each mode."""
    line = table(spark, d, "lineitem")
    whirl = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    keys = [(1000.0 * (F.col("l_orderkey") % 7)).alias("rpm"), (F.col("l_suppkey") % 13).cast("int").alias("k"), F.col("l_linenumber").cast("int").alias("mode_idx")]
    return line.groupBy(*keys).agg(F.round(F.min("l_extendedprice") / 100 + 1, 6).alias("freq_hz"), F.min(whirl).alias("whirl"))


MODAL = """modal as (select 1000.0::double * (l_orderkey % 7) as rpm, (l_suppkey % 13)::int as k, l_linenumber::int as mode_idx,
 round(min(l_extendedprice) / 100 + 1, 6) as freq_hz, min(case l_returnflag when 'A' then -1 when 'N' then 0 else 1 end)::int as whirl from lineitem group by all)"""


def triplets(spark, d) -> DataFrame:
    """row, col, val: unassembled entries of a 97 x 97 matrix."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 97).cast("int").alias("row"), (F.col("l_suppkey") % 97).cast("int").alias("col"), F.col("l_quantity").alias("val"))


TRIPLETS = "triplets as (select (l_partkey % 97)::int as row, (l_suppkey % 97)::int as col, l_quantity as val from lineitem)"


def nodes(spark, d) -> DataFrame:
    """node_id, x, y, z: parts as points on a grid, no two at one place."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("node_id"), (key % 17 / 10.0 + 0.5).alias("x"), (key % 23 / 10.0 + 0.25).alias("y"), (F.floor(key / 1955) + key % 5 / 10.0).alias("z"))


NODES = "nodes as (select p_partkey as node_id, (p_partkey % 17) / 10.0::double + 0.5::double as x, (p_partkey % 23) / 10.0::double + 0.25::double as y, (p_partkey // 1955) + (p_partkey % 5) / 10.0::double as z from part)"


def shapes(spark, d) -> DataFrame:
    """vec_id, k, shape: 64 real degrees of freedom."""
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("shape"))


def elements(spark, d) -> DataFrame:
    """elem_id, conn: orders as tetrahedra of four ids that follow each other, so that neighbours
    share a face, with edge nodes after them."""
    o = F.col("o_orderkey")
    corner = [o, o + 1, o + 2, o + 3]
    edge = [4 * corner[i] + (j - i) + 1_000_000_000 for i, j in ((0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3))]
    return table(spark, d, "orders").select(o.alias("elem_id"), F.array(*corner, *edge).alias("conn"))


ELEMENTS = """elements as (select o_orderkey as elem_id, [o_orderkey, o_orderkey + 1, o_orderkey + 2, o_orderkey + 3] as c from orders),
faces as (select elem_id, unnest([0, 1, 2, 3])::int as face_idx, unnest([[c[1], c[3], c[2]], [c[1], c[2], c[4]], [c[1], c[4], c[3]], [c[2], c[3], c[4]]]) as corners from elements),
boundary as (select min(elem_id) as elem_id, min(face_idx) as face_idx, list_sort(corners) as sorted, min(corners) as corners from faces group by list_sort(corners) having count(*) = 1)"""


def triangles(spark, d) -> DataFrame:
    """elem_id, face_idx, nodes: orders as triangles of a strip, which shares no edge with itself but the next one's."""
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(o.alias("elem_id"), F.lit(0).alias("face_idx"), F.array(o, o + 1, o + 2).alias("nodes"))


TRIANGLES = "triangle as (select o_orderkey as elem_id, 0 as face_idx, unnest([[o_orderkey, o_orderkey + 1], [o_orderkey + 1, o_orderkey + 2], [o_orderkey, o_orderkey + 2]]) as e from orders)"


def truth(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nd, j, freq_hz) as true and computed frequencies."""
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 13).cast("int").alias("nd"), (F.col("o_orderkey") % 11).cast("int").alias("j"))
    return o.agg(F.round(F.min("o_totalprice"), 4).alias("freq_hz")), o.agg(F.round(F.max("o_totalprice"), 4).alias("freq_hz")).where("(nd + j) % 5 <> 0")


TRUTH = """grouped as (select (o_custkey % 13)::int as nd, (o_orderkey % 11)::int as j, round(min(o_totalprice), 4) as gt, round(max(o_totalprice), 4) as comp0 from orders group by all),
rel as (select nd, j, case when (nd + j) % 5 <> 0 and abs(gt) >= 1e-12 then abs(comp0 - gt) / abs(gt) * 100 end as rel from grouped)"""
