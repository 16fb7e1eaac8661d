"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def id_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver share: what the cluster names in ``spark.checkpoint.dir``.

    Only a session in local mode may do without that setting, and then gets a folder below its warehouse.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return named.rstrip("/")


#: Writer's settings for rows of megabytes: else a page has 100 rows at least, and a task that writes or reads one holds them all.
LONG_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}


def spill(df: DataFrame, what: str, partition_by: tuple[str, ...] = (), codec: str = "snappy", long_rows: bool = False) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads that back.

    This cuts the lineage: a lost executor costs no more than the reading of the table. With ``long_rows`` the memory of
    those who write and read it does not grow with the rows of a file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**(LONG_ROWS if long_rows else {})).option("compression", codec).partitionBy(*partition_by).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._spilled = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Deletes spilled tables of which all that was made from them is itself written."""
    for df in tables:
        if df is not None:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(df._spilled)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: What Python workers keep from task to task: the clearing functions by operator, and the operator that ran last.
_KEPT: dict[str, list[Callable[[], None]]] = {}
_owner = ""


def kept(owner: str):
    """As lru_cache, for what one operator's tasks pass on to its next tasks in the same (reused) worker process."""

    def wrap(f):
        cached = lru_cache(4)(f)
        _KEPT.setdefault(owner, []).append(cached.cache_clear)
        return cached

    return wrap


def take_over(owner: str) -> None:
    """Called at the start of an operator's task: what other operators kept in this worker goes back to the system."""
    global _owner
    if _owner == owner:
        return
    import ctypes
    import gc

    import pyarrow as pa

    for name, clear in _KEPT.items():
        if name != owner:
            for f in clear:
                f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc
    _owner = owner


#: The setting for the bytes of rows that a Python worker gets at once, and what small_batches sets it to.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Sets a bound on the bytes that go to a Python worker at once, unless the session has one of its own.

    Spark's own bound is 64 MB, of which an executor holds two or three copies for every core.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


#: Ids up to this number are sent to all executors to select rows; more are joined.
SENT_IDS = 500_000


def by_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """df's rows whose column is (left_semi) or is not (left_anti) in the one column of ids; distinct, without nulls.

    The ids are broadcast only after they are counted to be few; else both sides are joined by shuffle.
    """
    ids = ids.toDF("_sought")
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return df.join(F.broadcast(ids) if few else ids, df[column] == F.col("_sought"), how)


#: Keys with more than a part in so many of all rows are joined by broadcast: there are no more of them than that.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, found: DataFrame, key: str, count: str = "c") -> DataFrame:
    """rows with the columns of found, which has a row for each key, and in ``count`` the number of rows of that key (dropped).

    Keys of many rows are joined where the rows are, all others by shuffle, so that no key makes a large task. Keys aren't null.
    """
    often = max(256, rows.count() // HOT_KEYS)
    hot = found.where(F.col(count) > often).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.where(F.col(count) <= often).drop(count), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column) -> Iterator[bytes]:
    """The UTF-8 of an Arrow string column row by row; null is the empty text.

    Rows are cut from the column's buffer, so that no string object is made.
    """
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for x in column:
        yield x.as_buffer().to_pybytes()


def packed(array) -> bytes:
    """An array of numbers for a binary column."""
    import zlib

    import numpy as np

    return zlib.compress(np.ascontiguousarray(array), 1)


def summed(blobs: DataFrame, dtype: str):
    """The sum of all packed arrays in the one column of blobs, or None if there is no row: added up in groups, and the groups' sums in
    fewer, until one task adds the last ones. The driver gets one array."""
    import zlib

    import numpy as np

    def add(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for x in batch.column(0):
                a = np.frombuffer(zlib.decompress(x.as_py()), dtype)
                if total is None:
                    total = a.copy()
                else:
                    total += a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], names=["x"])

    n = parts(blobs.sparkSession)
    while n > 1:
        blobs = blobs.repartition(n).mapInArrow(add, "x binary")
        n //= 16
    one = blobs.repartition(1).mapInArrow(add, "x binary").collect()
    return np.frombuffer(zlib.decompress(one[0].x), dtype) if one else None
