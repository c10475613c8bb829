"""What the operators share: reading tables, shared staging, stable hashes on both sides."""

from __future__ import annotations

import ctypes
import hashlib
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit mixer (the finaliser of splitmix64).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Folders of staged tables, with the name of those in the catalog.
_staged: dict[str, str] = {}
ROW_GROUP = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or the context's; a folder of our own only where the master is local and none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(posixpath.join(tempfile.gettempdir(), "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    This cuts the lineage: what follows reads committed files, so a lost
    executor costs the tasks that it ran and no earlier stage, and rows that
    depend on the order of arrival are fixed once. Row groups are small, since
    each task holds one while it writes.
    """
    spark = df.sparkSession
    path = posixpath.join(shared_dir(spark), f"staged-{name}-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return _kept(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """df as a written table in n buckets, so that joins on key don't move it again."""
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    path = posixpath.join(shared_dir(spark), name)
    df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    return _kept(spark.table(name), path, name)


def _kept(df: DataFrame, path: str, name: str = "") -> DataFrame:
    _staged[path] = name
    df.staged_at = path
    return df


def _drop(spark: SparkSession, path: str) -> bool:
    name = _staged.pop(path, "")
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def release(*staged: DataFrame) -> None:
    """Deletes staged tables that no table still to be written reads."""
    for df in staged:
        _drop(df.sparkSession, df.staged_at)


def drop_staged(spark: SparkSession) -> int:
    """Deletes the tables staged so far in this process, once their results are written; how many."""
    return sum(_drop(spark, path) for path in list(_staged))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving what its task has freed back to the system in the end; workers outlive tasks, and allocators keep freed memory."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other systems do without
        if trim:
            trim(0)

    return trimmed


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(col: str, modulus: int):
    """crc32 of the decimal text of an id, as the folds of the contracts take it."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Two primes under 2^31 with bases: products of a power and a byte stay under 2^40, so that sums over a piece are exact.
_FIELDS = ((np.uint64(2147483647), np.uint64(1174562147)), (np.uint64(2147483629), np.uint64(1923704723)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 1 << 18
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field, the powers of the base and of its inverse, n at least."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for prime, base in _FIELDS:
            both = []
            for x in (base, np.uint64(pow(int(base), -1, int(prime)))):
                table, step = np.ones(1, np.uint64), x
                while len(table) < n:  # doubling: the next half is this one times a power
                    table = np.concatenate((table, table * step % prime))
                    step = step * step % prime
                both.append(table)
            _powers.append((both[0], both[1]))
    return _powers


def word_hashes(texts: list[bytes], between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased, split at bytes in `between`, of which the space is one), and the text each belongs to.

    A hash is a polynomial in each of two prime fields, 62 bits in all, so that
    no kind of words collides by construction.
    """
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = offsets(len(t) + 1 for t in texts)
    out, owners, lo = [], [], 0
    gap = np.flatnonzero(between[_LOWER[buffer]])
    while lo < len(buffer):  # pieces that end between words
        hi = int(gap[np.searchsorted(gap, min(lo + PIECE, len(buffer)) - 1)]) + 1
        part = _LOWER[buffer[lo:hi]]
        edge = np.diff((~between[part]).astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letter = part.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(first), np.uint64)
        for (prime, _), (up, down) in zip(_FIELDS, _power_tables(len(part) + 1), strict=True):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letter * up[: len(part)])))
            h = h << np.uint64(31) | (total[end] - total[first]) % prime * down[first] % prime
        h = mix(h)
        for i in np.flatnonzero(end - first > PIECE):  # a sum over so long a word may not be exact
            h[i] = int.from_bytes(hashlib.blake2b(part[first[i] : end[i]], digest_size=8).digest(), "little")
        out.append(h)
        owners.append(np.searchsorted(ends, first + lo, "right") - 1)
        lo = hi
    return np.concatenate(out), np.concatenate(owners)


def offsets(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.fromiter(lengths, dtype=np.int64))))
