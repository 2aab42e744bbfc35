"""What the training-data operators share: shared storage, text buffers and counter-based random numbers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of the word rule [^\x20\x09-\x0D]+, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, for the operators here."""
    return modest_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found := "file://" + tempfile.mkdtemp(prefix="leafmill-"))
    return found.rstrip("/")


def plain_names(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1, ... so that no working column's name clashes, and what the given ones are called then."""
    names = df.columns
    return df.toDF(*(f"c{i}" for i in range(len(names)))), [f"c{names.index(c)}" for c in columns]


def modest_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of 1,024 rows: those of texts and sets then hold a few MB in each of an executor's workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release_shuffles(spark)
    return spark.read.parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files whose plans are done, before the next step needs the disk. It acts on
    references that the driver has collected, which Spark by itself sees to every half hour only."""
    gc.collect()
    spark._jvm.System.gc()




def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random uint64 for each byte; with fold_case A-Z get the numbers of a-z."""
    t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if fold_case:
        t[65:91] = t[97:123]
    return t


#: An odd multiplier and its inverse modulo 2**64: prefix sums of byte * BASE**i give the hash of any substring.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[0]=0 of numbers[byte] * BASE**i; the hash of data[a:b] is (S[b]-S[a]) * INVERSE**a."""
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(numbers[data] * powers(BASE, len(data)), out=s[1:])
    return s


def crc(value: int | None) -> int:
    """crc32 of an id as text."""
    import zlib

    return zlib.crc32(str(value).encode())
