"""Helpers shared by the corpus operators: scratch tables, crash-safe cuts of lineage, exact columns through
Python workers, joins on hot keys."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING, _RECORDS = "spark.checkpoint.dir", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows at a time that workers take of tables of texts while they are written.
TEXTS = 1_000
#: A key is hot when it holds more rows than this and more than one of 10,000 rows; so there are 10,000 hot
#: keys at most, whatever the size of a table.
HOT_ROWS, HOT_SHARE = 2_000, 10_000
#: Rows that a Python worker takes from an Arrow batch at a time.  Batches are bounded by Spark itself
#: (``spark.sql.execution.arrow.maxBytesPerBatch``).
SLICE = 500
_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where nothing is named, a single machine (master
    ``local``, as in tests) gets a temporary folder that goes when Python ends; a cluster gets an error, as a
    folder of the driver's would be another one on every executor.
    """
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_SETTING} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veritrail-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While a table is written, Python workers get so many rows at a time (a setting that the user has changed
    from Spark's default is left alone); what was set before is set again."""
    if rows is None or spark.conf.get(_RECORDS) != "10000":
        yield
        return
    spark.conf.set(_RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, "10000")


def materialise(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: later reads survive lost executors.

    Unlike an eager checkpoint, the plan runs a single time.  ``batch``: rows that Python workers take at a time,
    for plans that hand texts to them.
    """
    path = scratch_path(df.sparkSession, name)
    with batches(df.sparkSession, batch):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later table reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._scratch
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Hand free memory of a Python worker back: idle workers stay beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def computed(df: DataFrame, carried: list[str], inputs: list[str], compute: Callable[..., list[tuple]], added: dict[str, str]) -> DataFrame:
    """The columns ``carried`` and ``added`` (name to type), one row per row.

    ``compute`` takes the columns ``inputs`` as lists and returns a list of rows of the added columns.  Carried
    columns stay Arrow arrays, so whole numbers keep all their bits beside nulls.
    """
    kinds = [_ARROW[k] for k in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                rows = compute(*(part.column(c).to_pylist() for c in inputs))
                columns = zip(*rows, strict=True)
                arrays = [part.column(c) for c in carried] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *added])
        trim()

    fields = [df.schema[c] for c in carried] + [T.StructField(n, T.DataType.fromDDL(k)) for n, k in added.items()]
    return df.select(*dict.fromkeys([*carried, *inputs])).mapInArrow(run, T.StructType(fields))


def bounded_sample(rows: DataFrame, kind: str, value: str, bounds: dict, most_bytes: int | None = None) -> DataFrame:
    """kind, h, value: different values of each kind, at most ``bound`` of them for ``bounds[kind] = (bound, rows there are)``
    and, of texts, ``most_bytes`` of each kind.

    Rows whose hash of the value falls under the share wanted (and a fifth more) come first; copies of a value are
    one, and what is beyond the bounds goes before anything is collected.
    """
    hashed = rows.select(kind, value, F.xxhash64(value).alias("h"))
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / (1 << 30)
    pick = lambda at: F.coalesce(*(F.when(F.col(kind) == k, F.lit(float(v[at]))) for k, v in bounds.items()), F.lit(0.0))
    near = hashed.where(unit < pick(0) * 1.2 / F.greatest(pick(1), F.lit(1.0)))
    different = near.groupBy(kind, "h").agg(F.first(value).alias(value))
    by_hash = W.partitionBy(kind).orderBy("h")
    kept = different.withColumn("__place", F.row_number().over(by_hash))
    if most_bytes is not None:
        kept = kept.withColumn("__bytes", F.sum(F.octet_length(value)).over(by_hash)).where(F.col("__bytes") <= most_bytes)
    return kept.where(F.col("__place") <= pick(0)).select(kind, "h", value)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int) -> bool:
    """True if the counted rows of a *materialised* table stay under the limit."""
    return df.count() * row_bytes <= limit_bytes


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> DataFrame | None:
    """The hot keys of a materialised table (a column ``__hot``, ``HOT_SHARE`` rows at most); None if there are
    none.  They come from one aggregation that is combined before it is shuffled."""
    total = rows.count() if total is None else total
    if total <= HOT_ROWS:
        return None
    hot = rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("__hot")
    found = hot.collect()  # HOT_SHARE rows at most: each holds more than one of HOT_SHARE parts of the table
    return rows.sparkSession.createDataFrame(found, hot.schema) if found else None


def join_hot(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key at most.

    Rows of hot keys stay where they are and meet their side through a broadcast, bounded as the number of hot
    keys is; all others are shuffled.  No key is null.  ``how``: inner or left.
    """
    if hot is None:
        return rows.join(side, key, how)
    few, held = F.broadcast(hot), F.col(key) == F.col("__hot")
    usual = rows.join(few, held, "left_anti").join(side, key, how)
    return usual.unionByName(rows.join(few, held, "left_semi").join(F.broadcast(side.join(few, held, "left_semi")), key, how))


def deal(rows: DataFrame, chunks: Column, by: str) -> DataFrame:
    """Adds own, a, b: every two chunks of a group meet in one task (a, b), a <= b; ``own`` is a row's chunk, dealt
    by a hash of ``by``.  So a group of any size is compared whole while no task holds more than two chunks."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(by), chunks).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)))
    return dealt.withColumns({"a": F.least("own", "__other"), "b": F.greatest("own", "__other")}).drop("__other")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """rid (a number of the row, in the order of reading), row (all of its columns), written once."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
