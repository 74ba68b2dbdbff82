"""Shared helpers: column hygiene, checkpoints, Arrow text blocks and word or character arrays."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds a worker's memory however many rows a batch has.
CHUNK_BYTES = 1 << 19
U64 = np.uint64


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs locally."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="postloom-checkpoint-")
    sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_empty_text(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the named columns and the text, null text made empty; other columns can't clash."""
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the byte offset of each value (one more than values); nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        array, kind = array.cast(pa.string()), np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def text_chunks(array: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets from 0) of runs of whole texts of about ``chunk_bytes``."""
    data, off = text_bytes(array)
    n, i = len(array), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + chunk_bytes, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit value for each byte; ASCII letters of either case share one.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))[LOWER]
_POWER = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_POWER, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, of: int, name: str) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, 2 * CHUNK_BYTES), of, U64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 8 * CHUNK_BYTES:
            _powers[name] = table
    return table


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each text's first word index (one more than texts).

    A word is a run of bytes other than ASCII white space; a text's border ends it.
    """
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0] = after[-1] = False
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
        inner = off[(off > 0) & (off < len(data))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word without regard to the case of ASCII letters, equal wherever the word stands."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[data] * _power_table(n + 1, _POWER, "power")[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table(n + 1, _INVERSE, "inverse")[starts] + (ends - starts).astype(U64))


def _fold_table(size: int = 0x2000) -> np.ndarray:
    table = np.arange(size, dtype=np.uint32)
    for c in range(size):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


FOLD = _fold_table()


def characters(data: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts (lower case one to one if ``fold``) and each text's first character index."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    firsts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=firsts[1:])
    at = np.minimum(firsts[off], len(points))
    if fold:
        points = np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], points)
    return points, at


def lean(run):
    """For functions over a task's batches: free memory goes back to the system when it is free, not to a pool that grows."""

    @functools.wraps(run)
    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def shared(spark: SparkSession, value):
    """A broadcast of a model whose size is bounded by its parameters."""
    return spark.sparkContext.broadcast(value)
