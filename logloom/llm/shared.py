"""What the operators share: tables in the cluster's shared folder, row-wise Arrow workers, bounded slices of text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker expands at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one under the warehouse where that is unset.

    On a cluster a warehouse on local disks is refused: executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if folder.partition(":")[0] in ("file", folder) and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes of an Arrow batch, where the session sets none: buffers of that size stand in executors and Python workers.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_workers(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes, not by rows alone."""
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


#: Folders of Scratch tables made within `cleared`, innermost last.
_made: list[list[Scratch]] = []


@contextlib.contextmanager
def cleared() -> Iterator[None]:
    """All Scratch tables made within are deleted at the end: what is to stay must be written elsewhere before."""
    _made.append([])
    try:
        yield
    finally:
        for scratch in _made.pop():
            scratch.drop_all_but()


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores behind it until no column of the input has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


#: Shuffle partitions for each file of a table.
FILES = 16


class Scratch:
    """Parquet tables of one run in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/logloom-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        if _made:
            _made[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, as_it_is: bool = False) -> DataFrame:
        """Write df as a table of this name and read it again.

        It is dealt out to a FILES-th of the session's shuffle partitions first, as most of these tables are a small part of the
        input: few files, and a task that writes them does nothing else. as_it_is: one file for each partition of df.
        """
        if not as_it_is:
            df = df.repartition(max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // FILES))
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        self.release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished steps: it does once their plans are garbage on the driver."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(conf).delete(path, True)
        self.names.discard(name)

    def drop_all_but(self, *names: str) -> None:
        """Delete what a result does not read. Its own tables stay: they go with the folder, after the run."""
        for name in self.names - set(names):
            self.drop(name)


#: Rows of 8 bytes that may be broadcast, after they have been counted.
BROADCAST_ROWS = 400_000
#: Bits of one row of a sieve, those for each key, and rows of a sieve at most (16 MB in all).
SIEVE_BITS, BITS_EACH, SIEVE_ROWS = 1 << 15, 16, 1 << 12


def few(ids: DataFrame, number: int | None = None) -> DataFrame:
    """ids (some long columns, a written table), marked for broadcast if it has BROADCAST_ROWS rows at most; number: where it is known."""
    return F.broadcast(ids) if (ids.count() if number is None else number) <= BROADCAST_ROWS else ids


def _sieved(rows: DataFrame, table: DataFrame, on: list[str], number: int) -> tuple[DataFrame, Column]:
    """rows with more columns, and whether a row's key may be in the table: false only where it is not.

    The keys are hashed to bits, in rows of SIEVE_BITS: a table of 16 MB at most, whatever the number of keys.
    """
    bits = min(SIEVE_ROWS, -(-number * BITS_EACH // SIEVE_BITS)) * SIEVE_BITS
    names = [free_name(n, (*rows.columns, *table.columns)) for n in ("sieve_bit", "sieve_row", "sieve_bits")]
    bit, row, held = names
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    sieve = table.select(at.alias(bit)).groupBy(F.floor(F.col(bit) / SIEVE_BITS).alias(row)).agg(F.bitmap_construct_agg(F.col(bit) % SIEVE_BITS).alias(held))
    joined = rows.withColumn(bit, at).withColumn(row, F.floor(F.col(bit) / SIEVE_BITS)).join(F.broadcast(sieve), row, "left")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.col(bit) % SIEVE_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined, F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))


def wanted(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", number: int | None = None) -> DataFrame:
    """rows joined with a written table (its keys not null and of the types of rows' keys), without shuffling rows that find nothing there.

    how: inner, left, left_semi or left_anti. A table of BROADCAST_ROWS at most is broadcast. Of a larger one a sieve of its keys is; only rows
    that pass it are joined by a shuffle. number: the rows of the table, where they are known. rows is read twice for left and left_anti.
    """
    number = table.count() if number is None else number
    if number <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    joined, may = _sieved(rows, table, on, number)
    likely = joined.where(may).select(*rows.columns).join(table, on, how)
    if how in ("inner", "left_semi"):
        return likely
    return likely.unionByName(joined.where(~may).select(*rows.columns), allowMissingColumns=True)


#: Keys that are joined by broadcast because many rows have them: those with more than 1 of so many rows.
HEAVY = 1 << 16


def heavy_join(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows joined with a written table of one row for each key, whose column `size` says how many rows have the key.

    Keys with more than a HEAVY-th of all rows (so fewer than HEAVY keys) are broadcast; no task of the other join meets a larger one.
    rows is read twice, so it should be a written table too.
    """
    limit = (table.agg(F.sum(size)).first()[0] or 0) / HEAVY
    heavy, light = F.broadcast(table.where(F.col(size) > limit)), table.where(F.col(size) <= limit)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on))


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array, and each value's bounds in them (a null is an empty value)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
