"""Benchmark decontamination under edit distance, by random-walk embedding and locality-sensitive hashing.

Texts are sequences of words. The embedding walks along a window of words: each step writes the word it stands on and, by a
random bit of step and word, moves on or stays, so that windows at a small edit distance agree in most steps. A key is the
words written at a few sampled steps; keys of windows of the documents are looked up among keys of all windows of the
benchmark's items, for as many independent walks as the target recall needs. That number is found by trial on edited items,
for each length at which one more edit is allowed; items of a length at which the walks don't reach the recall are
looked up by pieces instead: of one piece more than edits are allowed, one is unchanged wherever the item occurs. Each hit is
verified by the exact edit distance between the item and the words around the hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.base import CHUNK_BYTES, U64, checkpoint, lean, mix, shared, text_chunks, word_hashes, words

#: An item occurs where its edit distance in words is at most this share of its words; recall aimed at there; most walks.
MAX_EDITS, RECALL, MOST_WALKS = 0.2, 0.998, 24
#: (least words of an item, words of its windows, stride of the documents' windows, steps of a walk, sampled steps): any
#: place of an item holds a whole window of the documents, also when as many words are deleted as is allowed. Items of
#: fewer words than the last size has are looked up by pieces.
SIZES = ((30, 8, 5, 14, 7), (15, 6, 3, 10, 5), (8, 4, 2, 7, 4))
#: Trials of edited items for each length and kind of edit that recall is measured at.
TRIALS = 500
#: Bytes of distinct item texts whose tables are in memory at once; a larger benchmark is looked up part by part.
PART_BYTES = 1 << 20
#: Bits that choose a cell of the filter that all keys of the documents pass first.
FILTER_BITS = 22


@dataclass(frozen=True)
class Walk:
    """A multiplier for the bit of each step, and which steps are sampled; without multipliers each step moves on."""

    steps: tuple[int, ...]
    sampled: frozenset[int]


@dataclass(frozen=True)
class Scan:
    """How windows of documents are turned into keys."""

    width: int
    stride: int
    walks: tuple[Walk, ...]


def make_walk(size: int, number: int) -> Walk:
    *_, steps, samples = SIZES[size]
    rng = np.random.default_rng([size, number, 20])
    return Walk(tuple((rng.integers(1, 2**63, steps, np.uint64) * U64(2) + U64(1)).tolist()), frozenset(rng.choice(steps, samples, replace=False).tolist()))


def straight(width: int) -> Walk:
    """Writes every word of its window once: the key of a piece."""
    return Walk((), frozenset(range(width)))


def walk_keys(hashes: np.ndarray, starts: np.ndarray, width: int, walk: Walk) -> np.ndarray:
    """The key of the window of ``width`` words at each start; a walk that leaves its window writes zeros."""
    at, key = np.zeros(len(starts), np.int64), np.zeros(len(starts), U64)
    for t in range(max(walk.sampled) + 1):
        word = hashes[starts + np.minimum(at, width - 1)]
        if t >= width:
            word = np.where(at < width, word, U64(0))
        if t in walk.sampled:
            key = key * U64(0x100000001B3) + (word ^ (word >> U64(29)))
        at += (word * U64(walk.steps[t]) >> U64(63)).astype(np.int64) if walk.steps else 1
    return mix(key)


def window_starts(first: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of whole windows at every ``stride`` words of each text, and their texts."""
    count = np.diff(first)
    windows = np.where(count >= width, (count - width) // stride + 1, 0)
    text = np.repeat(np.arange(len(count)), windows)
    order = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    return first[text] + order * stride, text


def hashes_of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for *_, data, off in text_chunks(pa.array(texts, pa.string())):
        starts, ends, first = words(data, off)
        out += np.split(word_hashes(data, starts, ends), first[1:-1])
    return out


def edits_allowed(share: float, n: int) -> int:
    return int(share * n + 1e-9)


def edited(item: np.ndarray, edits: int, kinds: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    """The item after so many edits at different words: 0 replaces one, 1 inserts one, 2 deletes one."""
    out = item.tolist()
    for at in sorted(rng.permutation(len(item))[:edits].tolist(), reverse=True):
        kind = kinds[int(rng.integers(len(kinds)))]
        out[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(2**62))]
    return np.array(out, U64)


def walks_needed(size: int, length: int, edits: int, items: list[np.ndarray], recall: float, most: int) -> int | None:
    """Walks that find ``recall`` of items of ``length`` words after so many edits, by trial; none if ``most`` don't.

    Each kind of edit alone, and all kinds mixed, must reach it. Trial items are made of the words of the items given.
    """
    _, width, stride, *_ = SIZES[size]
    rng = np.random.default_rng([7, length])
    pool = np.concatenate(items)
    kinds = ((0,), (1,), (2,), (0, 1, 2))
    own = [pool[(int(s) + np.arange(length)) % len(pool)] for s in rng.integers(len(pool), size=TRIALS * len(kinds))]
    theirs = [edited(x, edits, kinds[i % len(kinds)], rng)[int(rng.integers(stride)) :] for i, x in enumerate(own)]
    sides = []
    for rows, step in ((own, 1), (theirs, stride)):
        starts, trial = window_starts(np.cumsum([0, *map(len, rows)]), width, step)
        sides.append((np.concatenate(rows), starts, trial))
    found = np.zeros(len(own), bool)
    for k in range(most):
        walk = make_walk(size, k)
        one, two = (mix(walk_keys(h, s, width, walk) + trial.astype(U64) * U64(0x9E3779B97F4A7C15)) for h, s, trial in sides)
        found[sides[1][2][np.isin(two, one)]] = True
        if found.reshape(-1, len(kinds)).mean(0).min() >= recall:
            return k + 1
    return None


def group_of(n: int, share: float) -> tuple[int, int]:
    """Size (-1: by pieces) and allowed edits of items of ``n`` words; items over twice the largest size's least count as those."""
    size = next((s for s, (least, *_) in enumerate(SIZES) if n >= least), -1)
    return size, edits_allowed(share, min(n, 2 * SIZES[0][0]) if size == 0 else n)


@dataclass(frozen=True)
class Plan:
    """Scans of the documents, and the groups of items that pieces find."""

    scans: tuple[Scan, ...]
    by_pieces: frozenset[tuple[int, int]]
    share: float


def plan(items: list[np.ndarray], share: float = MAX_EDITS, recall: float = RECALL, most: int = MOST_WALKS) -> Plan:
    """Scans that find items of these lengths; ``items`` holds one of each length at least.

    Of all lengths of a group, the shortest is tried, at which most is missed: longer items hold more windows for each edit.
    """
    shortest: dict[tuple[int, int], int] = {}
    for n in sorted({len(x) for x in items}, reverse=True):
        shortest[group_of(n, share)] = n
    walks = {g: walks_needed(g[0], n, g[1], items, recall, most) if g[0] >= 0 else None for g, n in shortest.items()}
    scans = []
    for size, (_, width, stride, *_) in enumerate(SIZES):
        n = max((v for (s, _), v in walks.items() if s == size and v), default=0)
        if n:
            scans.append(Scan(width, stride, tuple(make_walk(size, k) for k in range(n))))
    by_pieces = frozenset(g for g, v in walks.items() if v is None)
    widths = {len(x) // (edits_allowed(share, len(x)) + 1) for x in items if group_of(len(x), share) in by_pieces}
    scans += [Scan(w, 1, (straight(w),)) for w in sorted(widths)]
    return Plan(tuple(scans), by_pieces, share)


@dataclass
class Part:
    """Items and, for each scan, where their windows are and, for each walk, sorted keys and the windows that have them."""

    ids: list
    repeats: list
    items: list[np.ndarray]
    places: list[np.ndarray] = field(default_factory=list)
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)


def build(ids: list, items: list[np.ndarray], chosen: Plan, repeats: list | None = None) -> Part:
    """The tables of some items, which have at least one word each."""
    part = Part(ids, repeats or [1] * len(ids), items)
    first = np.cumsum([0, *map(len, items)])
    hashes = np.concatenate(items) if items else np.empty(0, U64)
    groups = [group_of(len(x), chosen.share) for x in items]
    for scan in chosen.scans:
        item, offset = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for i, (x, group) in enumerate(zip(items, groups, strict=True)):
            pieces = edits_allowed(chosen.share, len(x)) + 1
            if group in chosen.by_pieces:
                at = np.arange(pieces) * scan.width if not scan.walks[0].steps and len(x) // pieces == scan.width else ()
            else:
                at = np.arange(len(x) - scan.width + 1) if scan.walks[0].steps and SIZES[group[0]][1] == scan.width else ()
            item.append(np.full(len(at), i, np.int32))
            offset.append(np.asarray(at, np.int32))
        places = np.column_stack([np.concatenate(item), np.concatenate(offset)])
        starts = first[places[:, 0]] + places[:, 1]
        tables = []
        for walk in scan.walks:
            keys = walk_keys(hashes, starts, scan.width, walk)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            tables.append((keys[order], order))
        part.places.append(places)
        part.tables.append(tables)
    return part


def cells(part: Part) -> list[list[np.ndarray]]:
    """Which cells of the filter the part's keys are in."""
    return [[np.unique(keys >> U64(64 - FILTER_BITS)).astype(np.int32) for keys, _ in tables] for tables in part.tables]


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance between the item and any run of the region's words, and where the first such run ends."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)  # a run may begin anywhere
    for i, word in enumerate(item.tolist()):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (region != U64(word)))
        new[0] = i + 1
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def passing(scans: tuple[Scan, ...], filters: list[list[np.ndarray]], hashes: np.ndarray, first: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each scan and walk: keys of the windows that pass the filter, their starts and texts."""
    out = []
    for scan, cells_of in zip(scans, filters, strict=True):
        starts, text = window_starts(first, scan.width, scan.stride)
        found = []
        for walk, usable in zip(scan.walks, cells_of, strict=True):
            key = walk_keys(hashes, starts, scan.width, walk)
            some = np.flatnonzero(usable[key >> U64(64 - FILTER_BITS)])
            found.append((key[some], starts[some], text[some]))
        out.append(found)
    return out


def search(part: Part, keys: list, hashes: np.ndarray, first: np.ndarray, share: float = MAX_EDITS) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) to the least edit distance and its place (words from the text's begin), within the item's allowance."""
    near = []
    for found, places, tables in zip(keys, part.places, part.tables, strict=True):
        for (key, starts, text), (sorted_keys, order) in zip(found, tables, strict=True):
            lo, hi = np.searchsorted(sorted_keys, key, "left"), np.searchsorted(sorted_keys, key, "right")
            times = hi - lo
            hit = np.repeat(np.arange(len(key)), times)
            place = places[order[np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + lo[hit]]]
            near.append(np.column_stack([text[hit], place[:, 0], starts[hit] - place[:, 1]]))
    near = np.unique(np.concatenate(near), axis=0) if near else np.empty((0, 3), np.int64)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    known: dict[int, tuple[bytes, list[int]]] = {}
    last = (-1, -1, 0)  # text, item and place that were compared last
    for text, i, at in near.tolist():
        own = part.items[i]
        n, begin, end = len(own), int(first[text]), int(first[text + 1])
        allowed = edits_allowed(share, n)
        if last[:2] == (text, i) and at - last[2] <= allowed or best.get((text, i), (1, 0))[0] == 0:
            continue  # the region of the last one held every run that this hit may be part of, or no run can be nearer
        if i not in known:
            known[i] = own.tobytes(), own.tolist()
        if begin <= at and at + n <= end and hashes[at : at + n].tobytes() == known[i][0]:
            best[text, i] = (0, at - begin)
            continue
        if not allowed:
            continue
        last = (text, i, at)
        lo = max(begin, at - 2 * allowed)
        region = hashes[lo : min(end, at + n + 3 * allowed)]
        there = set(region.tolist())
        if sum(w not in there for w in known[i][1]) > allowed:  # each such word is an edit
            continue
        distance, stop = edit_distance(own, region)
        if distance < best.get((text, i), (allowed + 1, 0))[0]:
            best[text, i] = (distance, max(0, lo + stop - n - begin))
    return best


SCHEMA = "doc_id long, text_hash long, item_id long, n_items long, distance int, word int, n_words int"


def _find(chosen: Plan, parts: list, cells_of):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = []
        for each in cells_of.value:
            filters.append([])
            for found in each:
                usable = np.zeros(1 << FILTER_BITS, bool)
                usable[found] = True
                filters[-1].append(usable)
        for batch in batches:
            docs, hashed, rows = batch.column(0), batch.column(1), []
            for i, _, data, off in text_chunks(batch.column(2), CHUNK_BYTES if len(parts) == 1 else 4 * CHUNK_BYTES):
                starts, ends, first = words(data, off)
                hashes = word_hashes(data, starts, ends)
                keys = passing(chosen.scans, filters, hashes, first)
                for shared_part in parts:
                    part: Part = shared_part.value
                    for (text, item), (distance, at) in search(part, keys, hashes, first, chosen.share).items():
                        rows.append((docs[i + text].as_py(), hashed[i + text].as_py(), part.ids[item], part.repeats[item], distance, at, len(part.items[item])))
                    if len(parts) > 1:
                        del part, shared_part._value  # read again from the worker's disk when it is next needed: only one part is in memory
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def find(docs: DataFrame, benchmark: DataFrame, *, share: float = MAX_EDITS, recall: float = RECALL, part_bytes: int = PART_BYTES, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, item_id, n_items, distance, word (where it begins, about) and n_words of each item that occurs in a document.

    An item occurs where some run of the document's words is within ``share`` of its words in edit distance (rounded down, so
    items of one to four words must occur exactly); words are runs of bytes other than ASCII white space, ASCII letters of
    either case alike. Null and empty items take no part; items of equal texts are one, with the least of their ids, and
    ``n_items`` tells how many rows they are. Null and empty documents hold nothing. Documents that repeat are reported
    as often as they come; a null id stays null, and ``text_hash`` (xxhash64 of the text) tells documents of one id apart.
    If several runs of a document are as near, the first that was met is reported. Other columns are left out; without
    items or documents there are no rows. Whole documents are read, once; very long ones need memory in proportion to
    their own length. No document is shuffled.
    """
    spark = docs.sparkSession
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    items = checkpoint(texts.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n")))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_parts = max(1, -(-int(size) // part_bytes))
    chosen = plan(_one_of_each_length(items), share, recall)
    parts, found = [], []
    for k in range(n_parts):
        some = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == k).orderBy("item_id", "text").collect()  # distinct texts of about part_bytes
        part = build([r.item_id for r in some], hashes_of([r.text for r in some]), chosen, [r.n for r in some])
        found.append(cells(part))
        parts.append(shared(spark, part))
    merged = [[np.unique(np.concatenate(x)) for x in zip(*each, strict=True)] for each in zip(*found, strict=True)]
    return rows.mapInArrow(_find(chosen, parts, shared(spark, merged)), SCHEMA)


def _one_of_each_length(items: DataFrame, longest: int = 1000) -> list[np.ndarray]:
    """An item for each number of words, at most ``longest``; a longer item stands as one of its beginnings.

    Only the trial of recall uses them, and it never needs more words.
    """
    tokens = F.filter(F.split(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), " "), lambda w: w != "")
    rows = items.select(F.size(tokens).alias("n"), F.array_join(F.slice(tokens, 1, longest), " ").alias("text"))
    some = rows.withColumn("n", F.least("n", F.lit(longest))).groupBy("n").agg(F.min("text").alias("text")).orderBy("n").collect()  # ``longest`` rows at most
    return hashes_of([r.text for r in some])
