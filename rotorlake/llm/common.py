"""What the operators of this package share: column handling, batches, shared folders."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step takes at once; numpy needs about 60 times that.
TEXT_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch in the queries of this package; texts are long, and JVM and Python each hold a batch.
BATCH_ROWS = 256


def small_batches(run):
    """A query that first cuts its session's Arrow batches to BATCH_ROWS rows, if they are longer.

    This is a choice of applications: operators cut what they get into slices, whatever the
    setting, and leave it alone.
    """

    @wraps(run)
    def set_first(spark: SparkSession, *args):
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
        return run(spark, *args)

    return set_first


#: What this worker keeps from task to task: the operator it belongs to, what it was made from, and the thing.
_HELD: list[tuple[str, object, object]] = []


def kept(operator: str, source: object, make: Callable[[], object]):
    """The one thing that a worker keeps over its tasks, made anew for another operator or source."""
    if not _HELD or _HELD[0][0] != operator or not (_HELD[0][1] is source or isinstance(source, tuple) and _HELD[0][1] == source):
        _HELD.clear()
        _HELD.append((operator, source, make()))
    return _HELD[0][2]


def released(run, operator: str = ""):
    """A function of a worker that gives memory back after each task, or group: what other
    operators keep, before it begins, and what allocators hold, when it ends.

    Workers live on from stage to stage, and their memory counts as the executor's.
    """

    def forget() -> None:
        if _HELD and _HELD[0][0] != operator:
            _HELD.clear()

    @wraps(run)
    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        trim()

    @wraps(run)
    def over_group(t: pa.Table) -> pa.Table:
        forget()
        out = run(t)
        trim()
        return out

    return over_group if run.__annotations__.get("return") in (pa.Table, "pa.Table") else over_batches


def trim() -> None:
    """Gives what was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8_lengths(column: pa.Array) -> list[int]:
    """Bytes of each text; null counts as 0."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``text`` holds about ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(utf8_lengths(batch.column(batch.schema.get_field_index(text)))):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, text: str) -> list[str]:
    """Python strings; null becomes empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def hashed_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; 0 for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % divisor, F.lit(0))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors both see.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset (tests, a single
    machine) the warehouse serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, partition_by: tuple[str, ...] = (), compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again.

    It cuts the lineage like a checkpoint, survives lost executors and lets a later step
    read only the columns that it needs.
    """
    spark = df.sparkSession
    path = shared_folder(spark, what)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files behind a table that :func:`stored` wrote, once nothing reads them."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rpartition("/")[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one computation in the shared folder, deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.tables = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        for folder in self.folders:
            _delete(self.spark, folder)

    def stored(self, df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
        """Like :func:`stored`."""
        self.folders.append(shared_folder(self.spark, what))
        df.write.option("compression", compression).parquet(self.folders[-1])
        return self.spark.read.schema(df.schema).parquet(self.folders[-1])

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """``df``, partitioned by ``key`` already, as a table that joins on it don't shuffle."""
        self.folders.append(shared_folder(self.spark, "sets"))
        self.tables.append("sets_" + self.folders[-1].rpartition("-")[2])
        df.write.option("path", self.folders[-1]).option("compression", "uncompressed").bucketBy(buckets, key).sortBy(key).saveAsTable(self.tables[-1], format="parquet")
        return self.spark.table(self.tables[-1])
