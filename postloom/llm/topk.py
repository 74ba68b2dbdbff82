"""Exact top-k by inner product over a bit-sliced index.

Vectors are cut into blocks; in a block, each bit of each quantised component is a bitmap over the block's rows. A query
adds the bitmaps, weighted by its own components, column by column with bitwise full adders, which gives the scores of
all rows as bitmaps again. Rows are then chosen from the most significant bitmap downward; rows that tie at the end are
taken by their id, and the chosen rows' scores are worked out from their own components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from postloom.llm.base import lean

K, SCALE, EVERY = 20, 64, 20
#: Rows of an index block and of a query block, about; queries of a block at least.
INDEX_ROWS, QUERY_ROWS, FEW_QUERIES = 65_536, 4_096, 256
#: Quantised components below this size are 64-bit integers; larger ones are Python's, in blocks of their own.
NARROW = 1 << 62
LONG = (-(1 << 63), (1 << 63) - 1)


def quantise(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of finite components, exactly, and which rows hold one of NARROW or more (as objects if any does)."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    wide = (np.abs(scaled) >= NARROW).any(1)
    if not wide.any():
        return scaled.astype(np.int64), wide
    whole = [[int(s) if abs(s) < NARROW else int(x) * scale for s, x in zip(r, v, strict=True)] for r, v in zip(scaled.tolist(), values.tolist(), strict=True)]
    out = np.empty(values.shape, object)  # a component that large is a whole number already
    out[:] = whole
    return out, wide


def build_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (component, bit, words of 64 rows) of the values less each component's least, and those least values."""
    least = values.min(0)
    rest = values - least if values.dtype == object else (values - least).astype(np.uint64)
    bits = max(1, int(rest.max()).bit_length())
    n, dim = values.shape
    words = -(-n // 64)
    out = np.zeros((dim, bits, words * 8), np.uint8)
    for b in range(bits):
        bit = (rest >> b) & 1 if values.dtype == object else (rest >> np.uint64(b)) & np.uint64(1)
        packed = np.packbits(bit.astype(np.uint8), axis=0, bitorder="little")
        out[:, b, : packed.shape[0]] = packed.T
    return out.view(np.uint64), least


def add_weighted(slices: np.ndarray, inverse: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bitmaps, least significant first, of the weighted sum; a negative weight takes the inverse bitmaps instead."""
    columns: list[list[np.ndarray]] = []
    for d in np.flatnonzero(weights).tolist():
        weight, source = abs(int(weights[d])), (slices if weights[d] > 0 else inverse)[d]
        for j in range(weight.bit_length()):
            if weight >> j & 1:
                while len(columns) < j + len(source):
                    columns.append([])
                for b, bitmap in enumerate(source, j):
                    columns[b].append(bitmap)
    total, i = [], 0
    while i < len(columns):
        column = columns[i]
        if len(column) > 1 and i + 1 == len(columns):
            columns.append([])
        while len(column) > 2:  # a full adder: one sum bit here, one carry in the next column
            a, b, c = column.pop(), column.pop(), column.pop()
            x = a ^ b
            columns[i + 1].append((a & b) | (x & c))
            x ^= c
            column.append(x)
        if len(column) == 2:
            a, b = column
            columns[i + 1].append(a & b)
            column[:] = [a ^ b]
        total.append(column[0] if column else np.zeros(slices.shape[2], np.uint64))
        i += 1
    return total


def count_bits(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def rows_of(bitmap: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows whose bit is set."""
    found: list[np.ndarray] = []
    for w in np.flatnonzero(bitmap):
        bits = np.flatnonzero(np.unpackbits(bitmap[w : w + 1].view(np.uint8), bitorder="little"))
        found.append(64 * w + bits)
        most -= len(bits)
        if most <= 0:
            break
    rows = np.concatenate(found) if found else np.empty(0, np.int64)
    return rows[: len(rows) + most] if most < 0 else rows


def choose(total: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Rows with the ``k`` greatest sums among those marked, ties to the first rows."""
    sure, open_ = np.zeros_like(among), among.copy()
    have = 0
    for bitmap in reversed(total):
        both = open_ & bitmap
        n = have + count_bits(both)
        if n > k:
            open_ = both
        else:
            sure |= both
            have = n
            open_ &= ~bitmap
            if n == k:
                break
    rows = rows_of(sure, k)
    return np.concatenate([rows, rows_of(open_, k - have)]) if have < k else rows


def exact_scores(query: np.ndarray, bits: np.ndarray, least: np.ndarray) -> list[int]:
    """Inner products with rows given as bits (component, bit, row) above the least values, of any size."""
    size = max(1, max((abs(int(x)) for x in least), default=0)) + (1 << bits.shape[1])
    if query.dtype != object and least.dtype != object and size * sum(abs(int(q)) for q in query) < NARROW:
        place = np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)
        return (query @ (np.einsum("dbr,b->dr", bits.astype(np.int64), place) + least[:, None])).tolist()
    place = np.array([1 << b for b in range(bits.shape[1])], object)
    values = (bits.astype(object) * place[None, :, None]).sum(1) + least.astype(object)[:, None]
    return [sum(int(q) * int(v) for q, v in zip(query, column, strict=True)) for column in values.T]


def search_block(slices: np.ndarray, least: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """Query ids, rows' ids and scores of each query's top ``k`` rows of a block whose ids are in order."""
    inverse = ~slices
    n, words = len(ids), slices.shape[2]
    every = np.zeros(words * 64, np.uint8)
    every[:n] = 1
    every = np.packbits(every, bitorder="little").view(np.uint64)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for own, query in zip(query_ids, queries, strict=True):
        total = add_weighted(slices, inverse, query)
        among = every.copy()
        for row in range(*np.searchsorted(ids, [own, own + 1])):
            among[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        rows = choose(total, among, k)
        bits = (slices[:, :, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        out[0].extend([int(own)] * len(rows))
        out[1].extend(ids[rows].tolist())
        out[2].extend(exact_scores(query, bits, least))
    return out


def beyond_long(score: int) -> bytes:
    """Puts scores in order that are the same long once they are brought into its range."""
    if LONG[0] <= score <= LONG[1]:
        return b"\x80"
    body = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    body = len(body).to_bytes(4, "big") + body
    return b"\x81" + body if score > 0 else b"\x7f" + bytes(255 - x for x in body)


def _pack(values: np.ndarray) -> bytes:
    return values.astype(np.int64).tobytes() if values.dtype != object else " ".join(str(x) for x in values.ravel()).encode()


def _unpack(body: bytes, wide: bool) -> np.ndarray:
    return np.array([int(x) for x in body.split()], object) if wide else np.frombuffer(body, np.int64)


BLOCK_SCHEMA = "dim int, wide boolean, ids binary, body binary, least binary"


def _blocks(rows: int, index: bool, scale: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if index else None  # a partition has about ``rows`` rows
        for batch in table.combine_chunks().to_batches() if index else batches:
            vectors = batch.column(1)
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                chosen = np.flatnonzero(dims == dim)
                chosen = chosen[np.argsort(ids[chosen], kind="stable")]
                for lo in range(0, len(chosen), rows):
                    some = chosen[lo : lo + rows]
                    values, wide = quantise(flat[starts[some][:, None] + np.arange(dim)], scale)
                    for large in (False, True):
                        at = np.flatnonzero(wide == large)
                        if not len(at):
                            continue
                        own = values[at] if large else values[at].astype(np.int64)
                        if index:
                            slices, least = build_slices(own)
                            body = (slices.tobytes(), _pack(least))
                        else:
                            body = (_pack(own), b"")
                        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([large]), *(pa.array([x], pa.binary()) for x in (ids[some[at]].astype(np.int64).tobytes(), *body))], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    return run


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        columns: tuple[list, list, list] = ([], [], [])
        for r in table.to_pylist():
            ids, least = np.frombuffer(r["ids"], np.int64), _unpack(r["least"], r["wide"])
            slices = np.frombuffer(r["body"], np.uint64).reshape(r["dim"], -1, -(-len(ids) // 64))
            queries = _unpack(r["queries"], r["wide_queries"]).reshape(-1, r["dim"])
            for whole, part in zip(columns, search_block(slices, least, ids, np.frombuffer(r["query_ids"], np.int64), queries, k), strict=True):
                whole += part
        scores = [min(max(s, LONG[0]), LONG[1]) for s in columns[2]]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(scores, pa.int64()), "beyond": pa.array([beyond_long(s) for s in columns[2]], pa.binary())})

    return run


def top_k(vectors: DataFrame, *, k: int = K, scale: int = SCALE, every: int = EVERY, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS, few_queries: int = FEW_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best other rows for each row whose id is divisible by ``every``.

    A score is the inner product of floor(``scale`` * x) over the components, worked out and compared exactly whatever its
    size; one beyond the range of a long is given as the nearest long. Ties go to the smaller id. Vectors that are null,
    empty, or hold nulls or components that aren't finite take no part, nor do rows without id. Only vectors of the query's
    length are compared with it. If an id repeats, each of its rows can be found, none of them for that id's own query, and
    the least of its vectors is the query. Other columns are left out, whatever their names; no rows give none. A block
    needs memory in proportion to the vectors' length; only rows of equal length share one.
    """
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # noqa: E731  false for NaN, which is above all numbers
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(finite("v"))
    floors = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * scale).cast("double")).otherwise(x * scale))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(floors.alias("q"), "v")).alias("least")).select("vec_id", F.col("least.v").alias("v"))
    n = vectors.select("vec_id").count()
    per_block = min(query_rows, max(few_queries, n // (16 * every)))
    blocks, query_blocks = max(1, -(-n // index_rows)), max(1, -(-n // (every * per_block)))
    index = rows.repartition(blocks).mapInArrow(_blocks(2 * index_rows, True, scale), BLOCK_SCHEMA).withColumn("block", F.spark_partition_id())
    asked = queries.repartition(query_blocks).mapInArrow(_blocks(2 * per_block, False, scale), BLOCK_SCHEMA)
    asked = asked.select("dim", F.col("wide").alias("wide_queries"), F.col("ids").alias("query_ids"), F.col("body").alias("queries"), F.spark_partition_id().alias("part"))
    # a pair of blocks is one task's work; blocks of about equal size are copied from both sides
    pairs = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["dim", "part", "block"])
    found = pairs.groupBy("dim", "part", "block").applyInArrow(_search(k), "query_id long, vec_id long, score long, beyond binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
