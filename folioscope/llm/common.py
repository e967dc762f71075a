"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most bytes of one batch that goes to a Python worker; long texts then make short batches.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound batches for Python workers by their bytes, as 10,000 long texts would fill a worker.

    The session keeps the lower bound: plans are run after an operator has returned them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < byte_size(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def byte_size(text: str) -> int:
    """A size as Spark's settings have it: a whole number, with a unit of powers of 1024 or without."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text}")
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ")


def give_back() -> None:
    """At the end of a task: return what it took to the system, as workers are used again for later stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only on a local master may that be unset (as in tests); a temporary folder is chosen then.
    """
    context = spark.sparkContext
    if (configured := context.getConf().get("spark.checkpoint.dir")) or (configured := context.getCheckpointDir()):
        return configured.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
    return context.getCheckpointDir().rstrip("/")


#: The scopes that are open, of each thread its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end, but those that are kept; what is returned may read only these.

    A table kept inside a nested use goes with the tables of the outer one.
    Tables that a query's result reads are its caller's: a caller that has
    written the result inside a use of its own leaves nothing behind.
    """
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield
    finally:
        jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
        names = _scopes.get()[-1]
        _scopes.reset(token)
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(settings).delete(path, True)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage at a place that survives lost executors, and gives later
    joins a plain scan, so adaptive execution may split skewed partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scopes := _scopes.get()[: -1 if keep else None]:
        scopes[-1].append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._table = path
    return written


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` has given and nothing reads any more; any other DataFrame is left alone."""
    if path := getattr(df, "_table", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (names are alike in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blank(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(column: str | Column) -> Column:
    """A hash of the text, which with the id tells rows apart (null as the empty text)."""
    return F.xxhash64(blank(column))


def id_bucket(column: str, modulus: int) -> Column:
    """``crc32`` of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def hash_sample(df: DataFrame, keys: tuple[str, ...], wanted: int, total: int, salt: int = 17) -> DataFrame:
    """A repeatable sample of about ``wanted`` of ``total`` rows, chosen by a hash of ``keys``.

    ``keys`` should tell rows apart, so that a large group of copies isn't chosen as a whole.
    """
    if total <= wanted:
        return df
    grain = 1 << 30
    return df.filter(F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(grain)) < F.lit(int(grain * wanted / total)))


class BoundedCache(dict):
    """A dict filled by ``make(key)`` on a miss; emptied when it holds ``limit`` keys."""

    def __init__(self, make, limit: int = 300_000, seed: Iterable[tuple] = ()):
        super().__init__(seed)
        self.make, self.limit, self.seed = make, limit, dict(self)

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
            self.update(self.seed)
        value = self[key] = self.make(key)
        return value


def in_chunks(items: list, size: int) -> Iterator[list]:
    for start in range(0, len(items), size):
        yield items[start : start + size]
