"""Best-fit packing of token sequences.

The lengths' histogram (at most ``capacity`` numbers) goes to the driver, where a configuration linear program chooses
which combinations of lengths fill sequences: multiplicative weights price the lengths, a knapsack dynamic program finds
the best combinations at those prices, and the fractional solution is rounded down. What that leaves is rounded by filling
sequences around the longest piece, or by best fit, whichever takes fewer, on the same histogram. Documents never leave the executors:
each piece learns its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.base import checkpoint, lean, shared, with_empty_text

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Rounds of the program; how fast prices fall with coverage, how much all rounds together would add to a length, and what a round still takes.
LP_ROUNDS, FALL, GAIN, WORTH = 300, 3.0, 8.0, 0.9
#: Tokens that a combination may have free beside the fullest one; pieces that are placed by search.
SLACK, SEARCHED = 4, 14


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- the configuration linear program -------------------------------------------------------------------------------


def price_table(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest total value of lengths (rising) that fit each room, any number of each, and a length that it takes (0: none)."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        best[c] = best[c - 1]
        if k:
            total = best[c - lengths[:k]] + values[:k]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], taken[c] = total[i], lengths[i]
    return best, taken


def traced(taken: list[int], room: int) -> list[int]:
    """The lengths that ``price_table`` takes for a room."""
    out = []
    while room > 0:
        if taken[room]:
            out.append(taken[room])
            room -= taken[room]
        else:
            room -= 1
    return out


def price_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths of the greatest total value that fits ``capacity``: an unbounded knapsack."""
    order = np.argsort(lengths)
    return Counter(traced(price_table(values[order], lengths[order], capacity)[1].tolist(), capacity))


def configuration_lp(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = LP_ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """Fractional numbers of sequences by combination of lengths, covering no length more often than it occurs; fullest first.

    A length's price is its size, and falls exponentially with the part of its pieces that is covered already; what is covered
    whole has none. Each round prices the lengths once. For every length, the combination around it of the greatest value is worth
    what the length and the best filling of the room behind it are worth; from the worthiest on, all combinations that share no
    length, and are worth WORTH of the best at least, are raised by a step.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], float)
    at = {int(x): i for i, x in enumerate(lengths)}
    share = np.zeros(len(lengths))
    used: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        live = share < 1 - 1e-9
        if not live.any():
            break
        values = np.where(live, lengths / capacity * np.exp(-FALL * (share - share[live].min())), 0.0)
        best, taken = price_table(values, lengths, capacity)
        worth, rest = values + best[capacity - lengths], taken.tolist()
        met = ~live
        for i in np.argsort(-worth, kind="stable").tolist():
            if worth[i] < WORTH * worth.max():
                break
            if met[i]:
                continue
            parts = Counter([i, *(at[x] for x in traced(rest, capacity - int(lengths[i])))])
            index = np.array(list(parts))
            if met[index].any():
                continue
            met[index] = True
            times = np.array(list(parts.values()), float)
            amount = float((np.minimum(GAIN / rounds, 1 - share[index]) * need[index] / times).min())
            share[index] += amount * times / need[index]
            key = tuple(sorted((int(lengths[j]) for j in parts.elements()), reverse=True))
            used[key] = used.get(key, 0.0) + amount
    return sorted(used.items(), key=lambda p: (-sum(p[0]), -p[1], p[0]))


def fullest(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """Pieces that fill a room best, of several such fillings the one with the longest pieces: a knapsack over bits, one for each sum."""
    sums, tried = [1], []
    for length in lengths:  # rising
        if length > room:
            break
        reach, n, k = sums[-1], min(left[length], room // length), 1
        while n:
            times = min(k, n)
            reach |= reach << times * length
            n, k = n - times, 2 * k
        sums.append(reach & (1 << room + 1) - 1)
        tried.append(length)
    at, out = sums[-1].bit_length() - 1, []
    for length, before in zip(reversed(tried), reversed(sums[:-1]), strict=True):
        n = min(left[length], at // length)
        while not before >> (at - n * length) & 1:
            n -= 1
        out += [length] * n
        at -= n * length
    return out


def around_longest(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Sequences around the longest piece left, each filled as well as pieces allow; as many of one combination as there can be."""
    left, plan = {length: n for length, n in histogram.items() if n > 0}, Counter()
    while left:
        longest = max(left)
        left[longest] -= 1
        parts = Counter(fullest(capacity - longest, sorted(x for x in left if left[x]), left))
        left[longest] += 1
        parts[longest] += 1
        n = min(left[x] // k for x, k in parts.items())
        for x, k in parts.items():
            left[x] -= k * n
            if not left[x]:
                del left[x]
        plan[tuple(sorted(parts.elements(), reverse=True))] += n
    return plan


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Best fit, decreasing, on counts: sequences that look alike are handled as one."""
    free: list[Counter] = [Counter() for _ in range(capacity + 1)]
    done: Counter = Counter()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((f for f in range(length, capacity + 1) if free[f]), None)
            if room is None:
                pattern, bins, room = (), left, capacity
            else:
                pattern, bins = next(iter(free[room].items()))
            each = room // length
            full = min(bins, left // each)
            times, many = (each, full) if full else (left, 1)
            if room != capacity or pattern:
                free[room][pattern] -= many
                if not free[room][pattern]:
                    del free[room][pattern]
            free[room - times * length][(*pattern, *[length] * times)] += many
            left -= times * many
    for group in free:
        done.update(group)
    return done


def searched(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """The fewest sequences for a few pieces, by branch and bound: the longest piece left goes to each sequence of another load, or to a new one."""
    pieces = sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True)
    least = -(-sum(pieces) // capacity)
    best = [[p] for p in pieces]

    def place(k: int, bins: list[list[int]]) -> bool:
        nonlocal best
        if len(bins) >= len(best):
            return False
        if k == len(pieces):
            best = [list(b) for b in bins]
            return len(best) == least
        tried = set()
        for b in bins:
            load = sum(b)
            if load + pieces[k] <= capacity and load not in tried:
                tried.add(load)
                b.append(pieces[k])
                if place(k + 1, bins):
                    return True
                b.pop()
        bins.append([pieces[k]])
        if place(k + 1, bins):
            return True
        bins.pop()
        return False

    place(0, [])
    return Counter(tuple(b) for b in best)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = LP_ROUNDS, counts: dict[str, int] | None = None) -> Counter:
    """How many sequences have each combination of lengths; every piece of the histogram is in one.

    The program's combinations are taken as often as their amounts say, rounded down: all that are nearly as full as the fullest, or
    all; wholly, or half or a quarter of them. What that leaves is rounded one sequence at a time around its longest piece, or
    placed by best fit. Of these plans the one of the fewest sequences is kept, of several the one with most from the program,
    then from rounding. A few pieces are placed by search. ``counts`` gets the numbers of sequences by origin.
    """
    whole = {length: n for length, n in histogram.items() if n > 0}
    single = whole.pop(capacity, 0)
    found: list[tuple[int, int, str, Counter, Counter]] = []
    if 0 < sum(whole.values()) <= SEARCHED:
        found.append((0, 0, "search", Counter(), searched(whole, capacity)))
    elif whole:
        program = configuration_lp(whole, capacity, rounds)
        for near in (SLACK, capacity):
            for part in (1.0, 0.5, 0.25, 0.0)[: 4 if near == SLACK else 3]:
                left, taken = dict(whole), Counter()
                for pattern, amount in program:
                    if sum(pattern) >= sum(program[0][0]) - near and (n := int(amount * part)) > 0:
                        taken[pattern] = n
                        for x, k in Counter(pattern).items():
                            left[x] -= k * n
                for origin, place in (("rounding", around_longest), ("best fit", best_fit)):
                    rest = place({x: n for x, n in left.items() if n}, capacity)
                    found.append((sum(taken.values()) + sum(rest.values()), -sum(taken.values()), origin, taken, rest))
    _, _, origin, taken, rest = min(found, key=lambda p: (p[0], p[1], p[2] != "rounding"), default=(0, 0, "rounding", Counter(), Counter()))
    plan = taken + rest
    if single:
        plan[(capacity,)] += single
    if counts is not None:
        counts.update({"whole": single, "program": sum(taken.values()), "rounding": 0, "best fit": 0, "search": 0} | {origin: sum(rest.values())})
    return plan


def slots(plan: Counter) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by their rank: runs of ranks with sequence, offset; sorted by length and rank."""
    rows, taken, base = [], Counter(), 0
    for pattern, n in sorted(plan.items(), key=lambda p: p[0], reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], base, offset))
            taken[length] += n
            offset += length
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


# --- tokens -----------------------------------------------------------------------------------------------------------


#: The alphabet in which byte-level vocabularies write bytes, and the pattern that cuts texts for them.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class two Unicode versions might disagree on, and unusual white space.
UNUSUAL = "[\x0b\x0c\x1c-\x1f\x85\xa0\u0590-\U0010ffff]"


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The ids are those of the tokenizer in the file at ``path``. Its merges also run as a table of ranks, several times as
    fast, for texts of usual characters without special tokens; the two are compared when the encoder is made, and all
    other texts go through the tokenizer itself.
    """

    SAMPLE = "It's  a sample:\n\n  don't STOP, über señor 1234,5 -- \tend  "

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = re.compile("|".join([UNUSUAL, *special])).search
        self.ranks = self._ranks(path)

    def _ranks(self, path: str):
        try:
            import tiktoken

            with open(path, encoding="utf-8") as f:
                kind = json.load(f)
            byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}
            added = {t["content"] for t in kind["added_tokens"]}
            ranks = {bytes(byte[c] for c in word): i for word, i in kind["model"]["vocab"].items() if word not in added}
            quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            same = quick.encode_ordinary(self.SAMPLE) == self.tokenizer.encode(self.SAMPLE, add_special_tokens=False).ids
        except (ImportError, KeyError, ValueError):
            return None
        return quick if same and kind.get("normalizer") is None else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, slow = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if self.ranks is None or self.unusual(text):
                slow.append(i)
            elif text:
                out[i] = np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()
        for i, got in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, "<u4").tobytes()
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _pieces(path: str, end_id: int, capacity: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                docs = some.column(0).to_pylist()
                rows: list[tuple] = []
                for doc, ids in zip(docs, encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    start, piece = 0, 0
                    while start < total:
                        length = (total - start) % capacity or capacity
                        nth = seen[length]
                        seen[length] = nth + 1
                        rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, nth))
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return run


def _place(table):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = (t["length"] << 44) | t["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            out = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])], names=[*PIECES.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, rounds: int = LP_ROUNDS) -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens; a row for each piece, with its place.

    A text is its tokens and ``end_id``; null and empty texts are that one id. Longer ones are cut into pieces of
    ``capacity``, the first shorter if need be; a very long text's ids are in one task's memory, 4 bytes each. Rows that repeat are
    packed as often as they come, a null id stays null, no rows give no rows, and other columns are left out. Pieces of one length
    are alike: they take the places of that length in the order of partitions, and of rows within them.
    """
    spark = docs.sparkSession
    rows = with_empty_text(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    pieces = checkpoint(rows.mapInArrow(_pieces(tokenizer or tokenizer_path(), end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"))
    counts = checkpoint(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    table = shared(spark, slots(plan_sequences(histogram, capacity, rounds)))
    return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
