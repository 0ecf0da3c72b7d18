"""Helpers that the operators share: reading, seeded hashing of text in numpy, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


#: Bytes of text that a function sees at once, if one row doesn't hold more.
PIECE_BYTES = 1 << 21


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some megabytes: Arrow batches have a bounded number of rows, not of bytes."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy()
    part = np.cumsum(size) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Gives freed memory back to the system: idle Python workers stay alive beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def released(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group, with its memory given back after each call."""

    def run(table):
        try:
            return f(table)
        finally:
            release()

    return run


def released_pair(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As ``released``, of a group on two sides."""

    def run(left, right):
        try:
            return f(left, right)
        finally:
            release()

    return run


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with a function that is built once per task by ``make`` and sees a few megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for piece in pieces(batch):
                yield each(piece)
        del each
        release()

    return df.mapInArrow(run, schema)


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where that is unset, a temporary one, if driver and executors are one machine."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        found = context.getCheckpointDir()
    return found


_below: list[str] = []


@contextlib.contextmanager
def scratch_below(folder: str) -> Iterator[None]:
    """Operators that are called inside put their working tables below ``folder``, so a caller can remove them."""
    _below.append(folder)
    try:
        yield
    finally:
        _below.pop()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that have ended: it does so only once the driver collects garbage, which large tables don't bring about."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written to the shared folder, so no lineage is kept; those that nothing reads any more are removed."""

    def __init__(self, spark: SparkSession):
        base = _below[-1] if _below else scratch_folder(spark)
        self.spark, self.folder = spark, f"{base}/scratch-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, written once."""
        path = f"{self.folder}/{len(self.kept)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        del df
        free_shuffles(self.spark)
        return out

    def keep_in_turn(self, frames: Iterator[DataFrame]) -> DataFrame:
        """The rows of one or more frames of one schema as one table. A frame is made when the one before is written and its shuffle files can go."""
        path = f"{self.folder}/{len(self.kept)}"
        for df in frames:
            df.write.mode("append").parquet(path)
            schema = df.schema
            del df
            free_shuffles(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables of ``keep`` that no later step reads."""
        for path in (p for df, p in self.kept if any(df is t for t in tables)):
            remove(self.spark, path)

def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def integer_key(df: DataFrame, key: str) -> None:
    """Refuses a key that isn't of an integer type, before anything runs."""
    kind = df.schema[key].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{key} must be of an integer type, not {kind.simpleString()}")


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both get an exchange of their own, as its keys are expressions: only then can Spark split a hot key of ``left``.

    ``right`` has one row for a key. Integer keys; the result has those of ``left``.
    """
    other = right.select([F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    same = [left[c].bitwiseXOR(F.lit(1)) == other[f"__{c}"].bitwiseXOR(F.lit(1)) for c in on]
    return left.join(other, same, how).drop(*[f"__{c}" for c in on])


def random_table(seed: int, size: int) -> np.ndarray:
    """Odd 64-bit multipliers or byte codes, the same in every process."""
    return np.random.default_rng(seed).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of a text's words (maximal runs of bytes that are no ASCII white space), A-Z lowered.

    The hash of a word is the sum over its bytes of code[byte] * multiplier ** position, mixed,
    so all words of a text are hashed in a few numpy passes.
    """

    def __init__(self, seed: int = 11):
        self.codes = random_table(seed, 256)[_LOWER]
        self.base = random_table(seed + 1, 1)[0]
        self.powers = np.ones(64, np.uint64)
        self._grow(64)

    def _grow(self, size: int) -> None:
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, self.base), dtype=np.uint64)])

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    def __call__(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        starts, ends = self.spans(data)
        if not len(starts):
            return np.zeros(0, np.uint64)
        lengths = ends - starts
        if lengths.max() >= len(self.powers):
            self._grow(int(lengths.max()))
        offsets = np.cumsum(lengths) - lengths
        position = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
        codes = self.codes[data[~_SPACE[data]]]
        return mix(np.add.reduceat(codes * self.powers[position], offsets) + lengths.astype(np.uint64))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(8), np.array([a.nbytes], np.int64).tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    out, at = [], 8
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        kind, size = data[at: at + 8].strip().decode(), int(np.frombuffer(data, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(data, np.dtype(kind), size // np.dtype(kind).itemsize, at + 16))
        at += 16 + size
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
