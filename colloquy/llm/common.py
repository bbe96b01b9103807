"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the query contracts: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
SPLIT_BLANKS = r"[\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch, at most: texts, sets and blocks of sets are long, and a Python worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; bounds the session's Arrow batches, and by that the workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session on one machine (tests) that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colloquy-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the held-out folds of the contracts."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def uniform(*cols: Column | str) -> Column:
    """A deterministic pseudo-random number in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def at_most(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """About ``n`` rows of ``df``, or all if it has fewer, picked by a hash of ``keys``.

    Only for fitting a model on a bounded sample.  The bound is held in expectation, so that no sort is
    needed.
    """
    total = df.count()
    return df if total <= n else df.where(uniform(F.lit(seed), *keys) < F.lit(n / total))


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers are reused, and share an executor's budget."""
    gc.collect()
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it wants
        pass
