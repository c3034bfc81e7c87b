"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to or comes from a Python worker.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Sets the session's bound on the bytes of a batch for Python workers, unless it has its own: what a task holds then
    depends neither on the number of rows in a batch nor on the length of texts, but for a single longer one."""
    conf = df.sparkSession.conf
    if _BATCH_SETTING not in conf.getAll:
        conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster that is an error, as executors would write
    where nobody else can read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(path: str) -> pa.Table:
    """A Parquet file of the shared folder, read by a task; the folder has to be one that Python workers reach too."""
    fs, inside = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(inside) as f:
        return pyarrow.parquet.ParquetFile(f).read()


def sided(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``df`` as the side of a join: broadcast if it has no more than ``most_rows`` rows, else left to be shuffled."""
    return F.broadcast(df) if df.count() <= most_rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the ids that no model learns labels from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_fraction(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable uniform number in (0, 1] from the columns' values."""
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))


def bounded_sample(df: DataFrame, by: Column, most: int, *key: str) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of ``key``; all rows where there are no more."""
    sizes = df.groupBy(by.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    part = sizes.select("_g", F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n")).alias("_p")).collect()
    share = F.lit(0.0)
    for r in part:
        share = F.when(by.eqNullSafe(F.lit(r["_g"])), F.lit(r["_p"])).otherwise(share)
    return df.where(hash_fraction(*key, seed=11) <= share)


def blocks(column: pa.Array | pa.ChunkedArray, most_chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``most_chars`` characters or one text, with the place of the first: bounds what is held at once."""
    at, held, chars = 0, [], 0
    for k in range(len(column)):
        t = column[k].as_py()
        held.append(t)
        chars += len(t or "")
        if chars >= most_chars:
            yield at, held
            at, held, chars = k + 1, [], 0
    if held:
        yield at, held


V = TypeVar("V")


class Recent(dict[str, V]):
    """Values worked out lately by ``make``, looked up with ``[]``.  Past ``most`` keys the younger generation takes the
    place of the older one, so twice as many are kept at most; keys longer than ``longest`` aren't kept."""

    def __init__(self, make: Callable[[str], V], most: int, longest: int = 40):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str) -> V:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            super().clear()
        self[key] = found
        return found

    def clear(self) -> None:
        self.old = {}
        super().clear()


_memory: dict = {}


def take_over(owner: str, clear: Callable[[], None]) -> None:
    """Lets a worker process keep what one operator remembers at a time: the one before is told to forget, and freed
    memory goes back to the system where the C library can give it back."""
    if _memory.get("owner") != owner:
        if _memory:
            _memory["clear"]()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)
        _memory.update(owner=owner, clear=clear)


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], columns: list[Column | str], out: str) -> DataFrame:
    """``columns`` (the keys among them) of the rows of ``df``, and their places from 1 among those of their keys in ``order``.

    Rows are dealt by ranges of keys and order, so the rows of one key are spread over tasks; each range counts its own
    rows of a key, and the counts before it are added.  Keys must not be null.  Rows that are equal in all of these get their places as they come.
    """
    place = F.monotonically_increasing_id()
    read, at, span, n, first, before = unused(df.withColumn(out, F.lit(0)), "_as_read", "_place", "_range", "_n", "_first", "_before")
    ranged = df.withColumn(read, place).repartitionByRange(*keys, *order, read).sortWithinPartitions(*keys, *order, read)
    kept = saved(ranged.select(*columns, place.alias(at), F.spark_partition_id().alias(span)), "numbered")
    spans = kept.groupBy(*keys, span).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    return saved(kept.join(spans, [*keys, span]).withColumn(out, F.col(before) + F.col(at) - F.col(first) + 1).drop(span, at, first, before), "numbered")
