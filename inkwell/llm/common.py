"""What the operators share: words, hashes, scratch tables and small Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset, and gets one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written() -> int:
    """Scratch tables so far, for release()."""
    return len(_scratch)


def release(since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables from the number `since` on but the `keep` last ones. Frames that still read them can't be used afterwards."""
    gone = _scratch[since : len(_scratch) - keep]
    del _scratch[since : len(_scratch) - keep]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(release)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver collects its garbage. Those of the last job go the second time."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def upload(spark: SparkSession, local: str, path: str) -> None:
    """Copy a file of the driver to a path of any file system that Spark can write."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(local), target)


def tidied(run):
    """run, and then what it has freed goes back to the system: Spark keeps its Python workers for the stages that follow."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: bytes.lower and bytes.split know ASCII only, which is that very class."""
    return text.lower().split() if text else []


def hash64(token: bytes) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


class HashMemo(dict):
    """token -> signed 64-bit hash. Emptied by trim() when it has grown past its bound, so that memory stays bounded."""

    def __missing__(self, token: bytes) -> int:
        h = self[token] = hash64(token)
        return h

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64, public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_mod(column, divisor: int):
    """crc32(column as text) mod divisor, as a Spark column; null ids count as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def row_hash(doc_id, text):
    """64-bit hash of a row's text and of whether doc_id and text are null, as a Spark column: with doc_id it tells rows apart."""
    from pyspark.sql import functions as F

    return F.xxhash64(doc_id.isNull(), text.isNull(), text.cast("string"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
