"""Near-duplicates by the Jaccard similarity of word shingles, found with a MinHash LSH forest and verified exactly.

Texts with the same set of shingles form a class, and classes stand for their texts from then on. A class has one path of
MinHash values for each tree of the forest; the sorted paths of a tree are its prefix trie, and the classes below a node are
neighbours in that order. Classes meet at whole paths, and at all shorter prefixes down to the length that reaches the recall for pairs at the threshold
itself, unless of all pairs that shorter prefixes would add, not one has a sketch that leaves open whether it is so little alike that whole
paths may miss it; nothing is estimated from a sample. Classes that meet are compared by sketches of one bit for each
MinHash value: pairs that the sketches put five standard deviations below the threshold are dropped, in nodes of any size, so
that a passage which many texts share links none of them. What remains forms clusters by connected components; a cluster's
shingle sets are shipped in blocks of bounded size, every pair of blocks is verified at once by counting common shingles, and
only sums and spanning edges leave a pair of blocks, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.base import U64, checkpoint, lean, mix, text_chunks, word_hashes, words
from postloom.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, MinHash values of a whole path, and the recall of pairs at the threshold.
TREES, DEPTH, RECALL = 32, 8, 0.9999
#: Classes of a node that are compared in step with those of other nodes; classes of a node that one task may see.
SMALL_NODE, HOT_NODE = 32, 10_000
#: Classes and shingles of a block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 150_000
#: Bytes of a path: the tree's number, then its values.
PATH = 1 + 2 * DEPTH

_rng = np.random.default_rng(5)
MULTIPLIERS = _rng.integers(1, 2**63, TREES * DEPTH, np.uint64) * U64(2) + U64(1)
PLACES = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that two classes of this similarity share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold shares a node of some tree with the target recall."""
    return next((k for k in range(depth, 1, -1) if chance(threshold, k, trees) >= recall), 1)


def sketch_agreement(threshold: float, bits: int = TREES * DEPTH, deviations: float = 5.0) -> int:
    """Bits that two sketches at the threshold agree in, less so many standard deviations."""
    p = (1 + threshold) / 2
    return int(bits * p - deviations * np.sqrt(bits * p * (1 - p)))


def sketch_sure(depth: int = DEPTH, recall: float = RECALL, bits: int = TREES * DEPTH, deviations: float = 3.0) -> int:
    """Bits from which on sketches show a pair that prefixes of ``depth`` values find with the recall: those of the least similar such pair, and so many standard deviations."""
    p = (1 + (1 - (1 - recall) ** (1 / TREES)) ** (1 / depth)) / 2
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in order within each, and where each text's begin.

    A text of fewer words has one shingle, of all its words; one without words has none.
    """
    starts, ends, first = words(data, off)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    padded = np.concatenate([h, np.zeros(size, U64)])
    owner = np.repeat(np.arange(len(count)), count)
    last = np.repeat(first[1:], count)
    at = np.arange(len(h))
    sums = np.zeros(len(h), U64)
    for k in range(size):
        sums += np.where(at + k < last, padded[k : k + len(h)], U64(0)) * PLACES[k]
    whole = (at + size <= last) | (at == first[:-1][owner] if len(owner) else np.zeros(0, bool))
    values, owner = mix(sums[whole]), owner[whole]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def set_keys(values: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set; none for an empty one."""
    some = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(some):
        sums = np.column_stack([mix(np.add.reduceat(mix(values ^ U64(seed)), at[some]) + U64(seed)) for seed in (0x1F3D5B79, 0x2E4C6A88)])
        for i, key in zip(some.tolist(), sums, strict=True):
            out[i] = key.tobytes()
    return out


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths of each non-empty set, one behind the other, and its sketch, packed."""
    some = at[:-1][np.diff(at) > 0]
    paths = np.empty((len(some), len(MULTIPLIERS)), ">u2")
    bits = np.empty((len(some), len(MULTIPLIERS)), np.uint8)
    for k, odd in enumerate(MULTIPLIERS):
        least = mix(np.minimum.reduceat(values * odd, some))
        paths[:, k] = least >> U64(48)
        bits[:, k] = least & U64(1)
    numbered = np.empty((len(some), TREES, PATH), np.uint8)
    numbered[:, :, 0] = np.arange(TREES)
    numbered[:, :, 1:] = paths.view(np.uint8).reshape(-1, TREES, PATH - 1)
    return numbered.reshape(len(some), -1), np.packbits(bits, axis=1)


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in text_chunks(batch.column(2)):
            values, at = shingles(data, off)
            keys, sizes = set_keys(values, at), np.diff(at)
            rows = iter(zip(*signatures(values, at), strict=True)) if len(values) else iter(())
            made = [next(rows) if n else (None, None) for n in sizes.tolist()]
            sigs, sketches = ([None if x is None else x.tobytes() for x in column] for column in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "ck", "n", "sig", "sketch"])


def _fixed(column: pa.Array, size: int) -> np.ndarray:
    """Binary values of one size as rows of bytes."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8)[first : first + size * len(column)].reshape(-1, size) if len(column) else np.empty((0, size), np.uint8)


def common_prefixes(paths: np.ndarray) -> np.ndarray:
    """Values that each path has in common with the next one at its beginning; -1 in another tree."""
    same = paths[1:] == paths[:-1]
    values = same[:, 1::2] & same[:, 2::2]
    lengths = np.where(values.all(1), values.shape[1], (~values).argmax(1))
    return np.where(same[:, 0], lengths, -1)


def connect(sketch: np.ndarray, least_agreement: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of all rows whose sketches agree in so many bits.

    A component grows from a row by comparing each of its rows with those that no component has yet.
    """
    free = np.arange(len(sketch))
    bits = 8 * sketch.shape[1] * sketch.itemsize
    a, b = [], []
    while len(free) > 1:
        border, free = [int(free[0])], free[1:]
        while border and len(free):
            x = border.pop()
            near = bits - np.bitwise_count(sketch[free] ^ sketch[x]).sum(1, dtype=np.int64) >= least_agreement
            met = free[near]
            if len(met):
                a.append(np.full(len(met), x))
                b.append(met)
                border += met.tolist()
                free = free[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def meetings(keys: np.ndarray, paths: np.ndarray, sketch: np.ndarray, depth: int, least_agreement: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes of whole nodes, in order of their paths, that share ``depth`` values and no more, as far as sketches allow a link.

    In a node of over SMALL_NODE classes: edges that span all pairs that share ``depth`` values or more.
    """
    common = common_prefixes(paths)
    new = np.flatnonzero(np.append(True, common < depth))[: len(keys)]
    size = np.diff(np.append(new, len(keys)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.repeat(size <= SMALL_NODE, size)
    shared_values = common.copy()
    for lag in range(1, SMALL_NODE):
        if lag > 1:
            shared_values = np.minimum(shared_values[:-1], common[lag - 1 :])
        x = np.flatnonzero((shared_values == depth) & small[: len(shared_values)])
        if not (shared_values >= depth).any():
            break
        x = x[8 * sketch.shape[1] * sketch.itemsize - np.bitwise_count(sketch[x] ^ sketch[x + lag]).sum(1, dtype=np.int64) >= least_agreement]
        a.append(x)
        b.append(x + lag)
    for first, n in zip(new[size > SMALL_NODE].tolist(), size[size > SMALL_NODE].tolist(), strict=True):
        one, two = connect(sketch[first : first + n], least_agreement)
        a.append(first + one)
        b.append(first + two)
    return keys[np.concatenate(a)], keys[np.concatenate(b)]


def _whole_nodes(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, paths and sketches, in order of their paths, without cutting a node at ``depth``."""
    rest: tuple[np.ndarray, ...] = ()
    for batch in batches:
        now = (batch.column(0).to_numpy(), _fixed(batch.column(1), PATH), _fixed(batch.column(2), TREES * DEPTH // 8))
        now = tuple(map(np.concatenate, zip(rest, now, strict=True))) if rest else now
        if len(now[0]):
            other = np.flatnonzero((now[1][:, : 1 + 2 * depth] != now[1][-1, : 1 + 2 * depth]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last node may go on in the next batch
            if cut:
                yield tuple(x[:cut] for x in now)
            rest = tuple(x[cut:].copy() for x in now)
    if rest and len(rest[0]):
        yield rest


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _not_alone(depth: int):
    """The rows that share ``depth`` values with another one."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, paths, sketch in _whole_nodes(batches, depth):
            with_next = common_prefixes(paths) >= depth
            some = np.flatnonzero(np.append(with_next, False) | np.append(False, with_next))
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array([x.tobytes() for x in paths[some]], pa.binary()), pa.array([x.tobytes() for x in sketch[some]], pa.binary())], names=["key", "path", "sketch"])

    return run


def _meet(depth: int, floor: int, least_agreement: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, paths, sketch in _whole_nodes(batches, floor):
            yield _edges(*meetings(keys, paths, np.ascontiguousarray(sketch).view(U64), depth, least_agreement))

    return run


def _unsure(depth: int, floor: int, least_agreement: int, sure: int):
    """Edges of prefixes shorter than ``depth`` whose sketches agree in fewer than ``sure`` bits; a task stops at its first ones."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, paths, sketch in _whole_nodes(batches, floor):
            bits = np.ascontiguousarray(sketch).view(U64)
            for shorter in range(floor, depth):
                a, b = meetings(np.arange(len(keys)), paths, bits, shorter, least_agreement)
                open_ = 8 * bits.shape[1] * bits.itemsize - np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) < sure
                if open_.any():
                    yield _edges(keys[a[open_][:1]], keys[b[open_][:1]])
                    return

    return run


def _meet_blocks(least_agreement: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        sketch = _fixed(table.column("sketch").combine_chunks(), TREES * DEPTH // 8)
        a, b = connect(np.ascontiguousarray(sketch).view(U64), least_agreement)
        return pa.Table.from_batches([_edges(keys[a], keys[b])])

    return run


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in text_chunks(batch.column(0)):
            values, at = shingles(data, off)
            sets = [values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, at), pa.binary()), pa.array(sets, pa.binary())], names=["ck", "set"])


def common_shingles(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[which] > 1
    number = np.cumsum(times > 1) - 1
    owner, which = owner[keep], number[which[keep]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, columns):
        a, b = np.searchsorted(which, [lo, lo + columns])
        part = np.zeros((len(sets), min(columns, int(which[-1]) + 1 - lo)), np.float32)
        part[owner[a:b], which[a:b] - lo] = 1
        out += part @ part.T
    return out


def verify(keys: list[bytes], copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, list[bytes]]:
    """For each class: documents of linked classes, and the least key that it is linked with here, through others too.

    ``side`` tells two blocks apart; only pairs across them count unless it is the ``same`` block.
    """
    common, sizes = common_shingles(sets), np.array([len(s) for s in sets], float)
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    linked &= (side[:, None] != side[None, :]) | same
    np.fill_diagonal(linked, False)
    links = linked @ copies
    order = np.argsort(np.array(keys, object), kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    while True:
        least = np.minimum(rank, np.where(linked, rank[None, :], len(keys)).min(1, initial=len(keys)))
        if (least == rank).all():
            break
        rank = least
    return links, [keys[order[r]] for r in rank.tolist()]


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        keys, roots, sides, sets = (table.column(x).to_pylist() for x in ("ck", "root", "side", "set"))
        copies, same = table.column("copies").to_numpy(), table.column("one")[0].as_py() == table.column("two")[0].as_py()
        members: dict[bytes, list[int]] = {}
        for i, root in enumerate(roots):
            members.setdefault(root, []).append(i)
        out: list[tuple] = []
        for rows in members.values():
            if len(rows) > 1:
                links, least = verify([keys[i] for i in rows], copies[rows], [np.frombuffer(sets[i], U64) for i in rows], np.array([sides[i] for i in rows]), same, threshold)
                out += [(keys[i], int(n), m) for i, n, m in zip(rows, links, least, strict=True) if n]
        columns = zip(*out, strict=True) if out else [()] * 3
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["ck", "links", "least"])

    return run


#: Rows that one of the tasks of a value's rows takes, about.
SALT_ROWS = 1_000_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, spread: str, salts: int, how: str = "inner") -> DataFrame:
    """Join on ``key``, of which ``small`` has one row a value, where a value may hold a large part of ``rows``.

    The rows of a value are dealt over ``salts`` tasks by the hash of ``spread``, and each row of ``small`` goes to all of them.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copied = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copied, [key, "salt"], how).drop("salt")


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash, class_id, class_hash, copy_id and n_links of every document.

    ``n_links``: other documents whose shingle sets have a Jaccard similarity of ``threshold`` or more with its own;
    ``copy_id``: the least doc_id among documents of the same shingle set; ``class_id``: the least among all that links
    connect. Shingles are of five words; words are runs of bytes other than ASCII white space, ASCII letters of either
    case alike. A text of one to four words is one shingle; null, empty and blank texts have none, link to nothing and
    are classes of their own. Rows that repeat are copies of each other, also if their ids are equal; null ids stay null
    and a class without ids has a null class_id. ``text_hash`` (xxhash64 of the text, null as empty) tells documents of one
    id apart, and the document of ``class_id`` and ``class_hash`` stands for its class: null ids come last, then the least
    hash. Other columns are left out, whatever their names; no rows give none. Whole texts are read, long ones in memory
    that grows with their own length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = checkpoint(texts.mapInArrow(_sign, "doc_id long, text_hash long, ck binary, n long, sig binary, sketch binary"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    classes = checkpoint(signed.filter("ck IS NOT NULL").groupBy("ck").agg(head.alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")).withColumn("key", F.xxhash64("ck")))
    salts = max(16, classes.count() // SALT_ROWS)
    clusters = components(_meetings(classes, threshold, recall))
    links = _links(texts, classes, clusters, threshold, salts)
    linked = components(links.select(F.col("ck").alias("a"), F.col("least").alias("b")))
    sums = links.groupBy("ck").agg(F.sum("links").alias("links"))
    known = classes.select("ck", "head", "copies").join(sums, "ck", "left").join(linked.withColumnRenamed("node", "ck"), "ck", "left")
    known = checkpoint(known.select("ck", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root"))
    ids = known.filter("root IS NOT NULL").groupBy("root").agg(F.min("head").alias("first"))
    named = join_hot(known, ids, "root", "ck", salts, "left").select("ck", F.coalesce("first", "head").alias("first"), "head", "n_links")
    columns = ("doc_id", "text_hash", F.col("first.id").alias("class_id"), F.col("first.hash").alias("class_hash"), F.col("head.id").alias("copy_id"), "n_links")
    some = signed.filter("ck IS NOT NULL").select("doc_id", "text_hash", "ck").join(named, "ck").select(*columns)
    own = F.struct(F.lit(False).alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    none = signed.filter("ck IS NULL").select("doc_id", "text_hash", own.alias("first"), own.alias("head"), F.lit(0).cast("long").alias("n_links")).select(*columns)
    return some.unionByName(none)


def _of_classes(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(ck, set) of classes, from the texts of the documents that stand for them."""
    heads = classes.select(F.col("head.id").alias("head_id"), F.col("head.hash").alias("text_hash"))
    wanted = texts.join(heads, (texts["text_hash"] == heads["text_hash"]) & texts["doc_id"].eqNullSafe(heads["head_id"]), "left_semi")
    return wanted.select("text").mapInArrow(_sets, "ck binary, set binary").filter("ck IS NOT NULL").dropDuplicates(["ck"])


def _meetings(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges (a, b) of class keys that connect all classes which meet in a node and whose sketches allow a link."""
    floor, least = prefix_depth(threshold, recall), sketch_agreement(threshold)
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * PATH + 1, F.lit(PATH)))
    rows = classes.select("key", F.explode(paths).alias("path"), "sketch")
    node = F.xxhash64(F.substring("path", 1, 1 + 2 * floor))
    hot = checkpoint(rows.groupBy(node.alias("node")).agg(F.count("*").alias("k")).filter(F.col("k") > HOT_NODE))
    edges, others = None, rows
    if not hot.isEmpty():
        # classes of a hot node are dealt over blocks, and every two blocks are compared in a task of their own
        blocks = F.ceil(2 * F.col("k") / HOT_NODE).cast("int")
        dealt = rows.withColumn("node", node).join(hot, "node").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x <> side)")))
        pairs = pairs.select("node", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "key", "sketch")
        edges = checkpoint(pairs.groupBy("node", "one", "two").applyInArrow(_meet_blocks(least), "a long, b long"))
        others = rows.withColumn("node", node).join(hot, "node", "left_anti").select("key", "path", "sketch")
    trie = checkpoint(others.repartition(node).sortWithinPartitions("path").mapInArrow(_not_alone(floor), "key long, path binary, sketch binary"))
    for depth in range(DEPTH, floor - 1, -1):
        met = checkpoint(trie.mapInArrow(_meet(depth, floor, least), "a long, b long"))
        edges = met if edges is None else edges.unionByName(met)
        if depth == DEPTH > floor and trie.mapInArrow(_unsure(depth, floor, least, sketch_sure(depth, recall)), "a long, b long").isEmpty():
            break
    return edges


def _links(texts: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, salts: int) -> DataFrame:
    """(ck, links, least) of each class in each pair of its cluster's blocks that holds a link of it."""
    members = clusters.withColumnRenamed("node", "key").join(classes.select("key", "ck", "head", "copies", "n"), "key")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = checkpoint(join_hot(members, sizes.select("root", blocks.alias("blocks")), "root", "ck", salts))
    small = members.filter("blocks = 1").agg(F.sum("n").alias("n")).first().n or 0
    bundles = max(1, -(-int(small) // BLOCK_SHINGLES))
    placed = members.select("ck", "root", "copies", "blocks", F.pmod(F.xxhash64("ck"), F.col("blocks").cast("long")).cast("int").alias("side"))
    placed = placed.join(_of_classes(texts, members), "ck")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.withColumn("other", other).withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other"), "bundle": F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.xxhash64("root"))})
    groups = pairs.select("bundle", "one", "two", "root", "ck", "copies", "side", "set", (F.col("blocks") > 1).alias("large")).groupBy("large", "bundle", "one", "two")
    return checkpoint(groups.applyInArrow(_verify(threshold), "ck binary, links long, least binary"))
