"""Helpers shared by the corpus operators: shared storage, Arrow batches, range sorts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Words are maximal runs of bytes other than these; `bytes.split()` cuts at exactly this set.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="tastegrid-"))
    return found.rstrip("/")


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tastegrid-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 0) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    With `bucket`, rows are kept in so many buckets by that column, and later joins on it leave them in place.
    """
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}"
    path = f"{_tables_dir(spark)}/{table}"
    writer = df.write.option("compression", "zstd")
    # What is shuffled for a table isn't needed once the table is there.
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        if bucket:
            table = table.replace("-", "_")
            writer.format("parquet").bucketBy(buckets, bucket).option("path", path).saveAsTable(table)
            out = spark.table(table)
        else:
            writer.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out._tastegrid_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_tastegrid_path", None)
        if path:
            _delete(table.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table that this application has materialized, once its results have been taken."""
    _delete(spark, _tables_dir(spark))


def row_numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with a number of its own for each row, written as a table so that every later read has the same numbers."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def prepare(spark: SparkSession) -> None:
    """Ship the code, and bound Arrow batches by rows and bytes, so that very long texts don't add up in a worker.

    The two settings stay with the session, since its lazy results need them when they are computed.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, whatever else `df` has."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(items: list, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about `most`; a larger item gets a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; only sizes tables by it, so results never depend on it."""
    return df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def range_numbered(df: DataFrame, parts: int, keys: list, schema: str, number) -> DataFrame:
    """Range-sort `df` by `keys` into `parts` partitions and materialize it after `number` saw each sorted partition.

    `number(partition_id, batches)` yields Arrow batches of `schema`; it adds positions local to its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from number(TaskContext.get().partitionId(), batches)

    return materialize(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "ranges")


def tree_sum(vectors: DataFrame, dtype, length: int, merge=np.add) -> np.ndarray:
    """The sum of `vectors`, one column of arrays as bytes, a row a partition; merged by treeReduce, some at a time."""
    arrays = vectors.rdd.map(lambda r: np.frombuffer(r[0], dtype=dtype))
    depth = max(2, math.ceil(math.log(max(2, arrays.getNumPartitions()), 8)))  # no more than about 8 vectors in one place
    return arrays.treeReduce(merge, depth) if arrays.getNumPartitions() else np.zeros(length, dtype=dtype)


def tree_last(vectors: DataFrame, dtype, length: int, finish, merge=np.add, fan: int = 8) -> np.ndarray:
    """`finish` of what tree_sum gives, taken in a task: of long vectors, the driver gets only what `finish` leaves of one."""
    arrays = vectors.rdd.map(lambda r: np.frombuffer(r[0], dtype=dtype))
    groups = arrays.getNumPartitions()
    if not groups:
        return finish(np.zeros(length, dtype=dtype))

    def merged(xs: Iterator[np.ndarray]) -> list[np.ndarray]:
        total = None
        for x in xs:
            total = x.copy() if total is None else merge(total, x, out=total)
        return [] if total is None else [total]

    while True:  # once at least, so that vectors are made by as many tasks as there are
        groups = math.ceil(groups / fan)
        arrays = arrays.mapPartitionsWithIndex(lambda i, xs, n=groups: [(i % n, x) for x in merged(xs)]).reduceByKey(merge, groups).values()
        if groups == 1:
            break
    found = arrays.map(finish).collect()
    return found[0] if found else finish(np.zeros(length, dtype=dtype))


_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one compressed blob; bytes of like weight stand together, which compresses well."""
    parts = [np.asarray([len(arrays), *(v for x in arrays for v in (x.itemsize, len(x)))], dtype="<i8").tobytes()]
    parts += [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in arrays]
    return _COMPRESS.compress(b"".join(parts))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    """What pack_arrays was given, as unsigned numbers."""
    raw = _DECOMPRESS.decompress(blob)
    count = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    heads = np.frombuffer(raw, dtype="<i8", count=2 * count, offset=8).reshape(-1, 2).tolist()
    out, at = [], 8 + 16 * count
    for width, n in heads:
        planes = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n))
        at += width * n
    return out
