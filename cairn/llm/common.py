"""What the operators share: table access, words, batch sizes, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts may be long, so both are small.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20

#: Bits of a table that spares rows nothing can ask for; what it lets through is checked exactly.
SLOTS = 1 << 25

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Every byte that is no word byte becomes a blank, A-Z become a-z: bytes.split() then gives the
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
_WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)


def names(ddl: str) -> list[str]:
    """Column names of a flat list of columns."""
    return [x.split()[0] for x in ddl.split(",")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that Python workers get, so that long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shielded(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns, which begin with __, don't meet those of its first argument."""

    @wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        clash = {c: f"kept{k}{c}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        done = f(docs.withColumnsRenamed(clash) if clash else docs, *args, **kwargs)
        return done.withColumnsRenamed({v: k for k, v in clash.items()}) if clash else done

    return run


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z, as UTF-8 bytes."""
    return encode(text).translate(_WORD_TABLE).split()


def split_words(text: str | None) -> list[list[bytes]]:
    """``words`` of each \n-split line of a text."""
    return [x.translate(_WORD_TABLE).split() for x in encode(text).split(b"\n")]


def text_key(text: str = "text") -> Column:
    """A key that is equal for equal texts only; a null text counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is built and run inside go when it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def bitmap(slots: DataFrame) -> np.ndarray:
    """Bits of the numbers below SLOTS in the one column of ``slots``, a table of fixed size on the driver."""
    name = slots.columns[0]
    with swept(slots.sparkSession):
        got = slots.selectExpr(f"{name} >> 6 as at", f"shiftleft(1L, cast({name} & 63 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(SLOTS // 64, np.int64)
    table[got["at"].to_numpy()] = got["bit"].to_numpy()
    return table.view(np.uint64)


def held_in(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether each slot's bit is set."""
    return (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def cut(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there: its lineage ends.

    The folder is the one the session names in spark.checkpoint.dir; a cluster must name one. Where it is
    unset on one machine, as in tests, a folder in the warehouse is taken. Tables lie below the application's id
    and may go when the application has ended; those whose paths are in ``held`` can be discarded
    earlier. The write's own shuffle files go when the table is whole.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    path = f"{folder}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Delete the tables in ``held``; everything that is made from them must be written by now."""
    for path in held:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()
