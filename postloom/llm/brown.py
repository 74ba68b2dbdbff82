"""Language-model scores by class-based n-grams.

Words that are frequent, and the endings of all others, are assigned to classes by exchange clustering: each is moved to
the class that most raises the mutual information of neighbouring classes, until few move. Every further word of the
training text is then moved once more, by the counts of its own neighbours' classes, so that only words it doesn't hold
have the class of their ending; transitions are counted over the classes of all words. The log-probability of a text is
the sum over its tokens of the class-transition and the word-emission probability. Counts and classes of words stay in a
table; only those of the most frequent words, a fixed number, are broadcast, and other words of a text are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.base import checkpoint, crc_mod, lean, shared, text_chunks, with_empty_text

#: Rows whose crc32(doc_id as text) modulo FOLDS is HELD_OUT aren't learned from.
FOLDS, HELD_OUT = 7, 2
#: Words whose counts are broadcast; words and endings that are clustered; bytes of an ending; classes; rounds of exchange.
FREQUENT, CLUSTERED, ENDINGS, ENDING, CLASSES, ROUNDS = 200_000, 1000, 300, 3, 48, 12
#: Counts that smooth a class's transitions.
SMOOTH = 2.0
#: Distinct words that a task counts before it passes them on.
COUNT_AT_ONCE = 400_000


def tokens(array: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Each row's words, A to Z made lower case."""
    for i, j, data, off in text_chunks(array):
        text, cuts = data.tobytes().lower(), off.tolist()
        for k in range(j - i):
            yield i + k, text[cuts[k] : cuts[k + 1]].split()


@lean
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def drain() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for _, words in tokens(batch.column(0)):
            seen.update(words)
            if len(seen) > COUNT_AT_ONCE:
                yield drain()
    if seen:
        yield drain()


@dataclass
class Items:
    """What is clustered: 0 ends a text, then words, then endings, then all else. ``index``: a frequent word's number."""

    words: list[bytes]  # frequent words, the clustered ones first
    counts: np.ndarray
    clustered: int
    endings: list[bytes]
    each: bool = False  # frequent words beyond the clustered ones have items of their own, after ``rest``

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}
        ending = {e: 1 + self.clustered + k for k, e in enumerate(self.endings)}
        self.rest = 1 + self.clustered + len(self.endings)
        self.ending = ending
        self.item = np.array([1 + i if i < self.clustered else ending.get(w[-ENDING:], self.rest) for i, w in enumerate(self.words)], np.int64)
        if self.each:
            self.item[self.clustered :] = self.rest + 1 + np.arange(len(self.words) - self.clustered)
        self.logs = np.log10(self.counts + 1.0)

    def __reduce__(self):  # only what the rest is made from is sent
        return Items, (self.words, self.counts, self.clustered, self.endings, self.each)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Frequent-word numbers (or -1) and items."""
        get, ending, rest = self.index.get, self.ending.get, self.rest
        number = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        item = self.item[number] if len(self.item) else np.full(len(words), rest)
        for k in np.flatnonzero(number < 0).tolist():
            item[k] = ending(words[k][-ENDING:], rest)
        return number, item


def _bigrams(items):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        these: Items = items.value
        size = these.rest + 1
        seen = np.zeros(size * size, np.int64)
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, words in tokens(batch.column(0)):
                path = np.zeros(len(words) + 2, np.int64)
                path[1:-1] = these.of(words)[1]
                parts.append(path[:-1] * size + path[1:])
                held += len(words)
                if held > 2_000_000:
                    seen += np.bincount(np.concatenate(parts), minlength=size * size)
                    parts.clear()
                    held = 0
        if parts:
            seen += np.bincount(np.concatenate(parts), minlength=size * size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each item, from counts of neighbouring items; item 0 alone has class 0."""
    n = len(pairs)
    total = pairs.sum(1) + pairs.sum(0)
    order = 1 + np.argsort(-total[1:], kind="stable")
    group = np.zeros(n, np.int64)
    group[order] = 1 + np.arange(n - 1) % max(classes - 1, 1)
    one = np.zeros((n, classes))
    one[np.arange(n), group] = 1
    after, before = pairs @ one, pairs.T @ one  # by item and neighbour's class
    joint = one.T @ after
    for _ in range(rounds if n > 2 and classes > 2 else 0):
        moved = 0
        for w in order.tolist():
            a, own = group[w], pairs[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            joint[a] -= right
            joint[:, a] -= left
            joint[a, a] -= own
            rows, columns = joint.sum(1), joint.sum(0)
            f = _xlogx(joint)
            more_rows, more_columns = _xlogx(joint + right) - f, _xlogx(joint + left[:, None]) - f
            d = np.arange(classes)
            gain = more_rows.sum(1) - more_rows[d, d] + more_columns.sum(0) - more_columns[d, d]
            gain += _xlogx(joint[d, d] + right + left + own) - f[d, d]
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(columns + left.sum() + own) - _xlogx(columns)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += right
            joint[:, b] += left
            joint[b, b] += own
            if b != a:
                moved += 1
                group[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
        if moved <= n // 200:
            break
    return group


def context(classes: int) -> np.dtype:
    """A count of neighbours of one class: before a word, or after it (``classes`` more); a greater count is several."""
    return np.dtype([("code", "u1" if 2 * classes <= 256 else "<u2"), ("n", "<u2")])


def class_kind(classes: int) -> np.dtype:
    """The type of a class in a path; its greatest value stands for a word whose class is looked up."""
    return np.dtype("u1" if classes < 255 else "<u2")


def _contexts(model, classes: int):
    """word, and its CONTEXT counts as bytes, of the words that aren't clustered."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, group = model.value
        others: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        held = 0

        def drain() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(parts), return_counts=True)
            pieces = -(-times // 65_535)
            keys, times, last = np.repeat(keys, pieces), np.repeat(times, pieces), np.cumsum(pieces) - 1
            times[last] -= 65_535 * (pieces - 1)
            times = np.minimum(times, 65_535)
            found = np.empty(len(keys), context(classes))
            found["code"], found["n"] = keys % (2 * classes), times
            number = keys // (2 * classes)
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist()
            names = items.words + list(others)
            words = [names[i] for i in number[cuts].tolist()]
            counts = [found[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
            parts.clear()
            others.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.binary())], names=["word", "counts"])

        for batch in batches:
            for _, words in tokens(batch.column(0)):
                number, item = items.of(words)
                for k in np.flatnonzero(number < 0).tolist():
                    number[k] = len(items.words) + others.setdefault(words[k], len(others))
                path = np.zeros(len(words) + 2, np.int64)
                path[1:-1] = group[item]
                at = np.flatnonzero(number >= items.clustered)
                if len(at):
                    parts.append(np.concatenate([number[at] * 2 * classes + path[at], (number[at] * 2 + 1) * classes + path[at + 2]]))
                    held += 2 * len(at)
                if held > 4_000_000:
                    yield drain()
                    held = 0
        if parts:
            yield drain()

    return run


def assign(owner: np.ndarray, code: np.ndarray, n: np.ndarray, now: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The best class of each word, from counts of its neighbours' classes (owner rising, all words there), as in an exchange.

    ``now``: the class in which ``joint`` counts the word so far; the word is taken out of it first.
    """
    classes, words, at = len(joint), len(now), np.arange(len(n))
    table = np.concatenate([joint, joint.T])  # by code: the neighbour's class, then the word's
    base = table[code]
    low = _xlogx(table)[code]
    base[at, now[owner]] = np.maximum(base[at, now[owner]] - n, 0)
    low[at, now[owner]] = _xlogx(base[at, now[owner]])
    first = np.searchsorted(owner, np.arange(words))
    gain = np.add.reduceat(_xlogx(base + n[:, None]) - low, first)
    both = np.zeros((2, words, classes))
    both[code // classes, owner, code % classes] = n
    i, b = np.nonzero((both[0] > 0) & (both[1] > 0))  # neighbours on both sides meet in a class's transition to itself
    left, right, own, same = both[0][i, b], both[1][i, b], joint[b, b], now[i] == b
    whole, less_left, less_right = (np.maximum(own - same * x, 0) for x in (left + right, left, right))
    gain[i, b] += _xlogx(whole + left + right) - _xlogx(whole) - _xlogx(less_left + left) + _xlogx(less_left) - _xlogx(less_right + right) + _xlogx(less_right)
    total = both[0].sum(1)
    for sums in (joint.sum(1), joint.sum(0)):
        rest = np.repeat(sums[None], words, 0)
        rest[np.arange(words), now] = np.maximum(rest[np.arange(words), now] - total, 0)
        gain -= _xlogx(rest + total[:, None]) - _xlogx(rest)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def _assign(model, joint, chunk: int = 1000):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (items, group), sums = model.value, joint.value
        classes = len(sums)
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                words, lists = (batch.column(k).slice(lo, chunk).to_pylist() for k in (0, 1))
                parts = [b"".join(x) for x in lists]
                kind = context(classes)
                found = np.frombuffer(b"".join(parts), kind)
                owner = np.repeat(np.arange(len(words)), [len(p) // kind.itemsize for p in parts])
                keys, which = np.unique(owner * 2 * classes + found["code"], return_inverse=True)
                n = np.bincount(which, found["n"])
                owner, code = keys // (2 * classes), keys % (2 * classes)
                now = group[[items.ending.get(w[-ENDING:], items.rest) for w in words]]
                best = assign(owner, code, n, now, sums)
                times = np.bincount(owner, n * (code < classes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times), pa.array(best.astype(np.int64))], names=["word", "n", "class"])

    return run


@dataclass
class Model:
    items: Items
    group: np.ndarray  # class of each item
    step: np.ndarray  # log10 probability of a class after a class
    room: np.ndarray  # log10 of a class's emission denominator; 0 for the end
    base_room: float
    end_log: float
    train_tokens: int
    base_only: bool


KNOWN = "doc_id long, h long, held_out boolean, training boolean, n_tokens long, n_known long, emitted double, path binary, spots binary, endings binary, names array<binary>"


def _known(model, classes: int):
    """Of each text: its classes as bytes, as far as its words are frequent.

    For its other words, ``spots`` has the numbers of those words among the text's distinct ones in byte order, in the
    text's order, ``endings`` the classes that each of them has if the training text doesn't hold it, and ``names`` the words.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, group = model.value
        kind = class_kind(classes)
        for batch in batches:
            out, paths, spots, endings, lists = np.zeros((batch.num_rows, 3)), [], [], [], []
            for k, words in tokens(batch.column(4)):
                number, item = items.of(words)
                path, rare = group[item].astype(kind), np.flatnonzero(number < 0)
                out[k] = len(words) + 1, len(words) - len(rare), items.logs[number[number >= 0]].sum()
                names = rare_words(words, rare)
                place = {w: i for i, w in enumerate(names)}
                at = np.fromiter((place[words[i]] for i in rare.tolist()), np.int64, len(rare))
                tails = np.empty(len(names), kind)
                tails[at] = path[rare]
                path[rare] = np.iinfo(kind).max
                paths.append(path.tobytes())
                spots.append(at.astype(spot_kind(len(names))).tobytes())
                endings.append(tails.tobytes())
                lists.append(names)
            columns = [pa.array(out[:, 0].astype(np.int64)), pa.array(out[:, 1].astype(np.int64)), pa.array(out[:, 2]), *(pa.array(x, pa.binary()) for x in (paths, spots, endings)), pa.array(lists, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=[x.split()[0] for x in KNOWN.split(", ")])

    return run


def rare_words(words: list[bytes], at: np.ndarray) -> list[bytes]:
    """The distinct words at these places, in byte order."""
    return sorted({words[i] for i in at.tolist()})


def spot_kind(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 65_536 else "<u4")


PATHS = "doc_id long, held_out boolean, training boolean, n_tokens long, n_known long, emitted double, path binary"


def _paths(classes: int):
    """The classes of a text's tokens as bytes, with their counts; the last column has number, class and count of its rare words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = class_kind(classes)
        for batch in batches:
            known, emitted = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in (4, 5))
            paths, met = [], batch.column(9)
            cuts, values = met.offsets.to_numpy().tolist(), met.values  # a null list is one of no values
            places, groups = (values.field(k).to_numpy(zero_copy_only=False) for k in ("i", "class"))
            lasting = np.log10(values.field("n").to_numpy(zero_copy_only=False) + 1.0)
            for k, (path, spots, endings) in enumerate(zip(*(batch.column(c).to_pylist() for c in (6, 7, 8)), strict=True)):
                path, own = np.frombuffer(path, kind).copy(), np.frombuffer(endings, kind).copy()
                if len(own):
                    logs, some = np.full(len(own), -1.0), slice(cuts[k], cuts[k + 1])
                    own[places[some]], logs[places[some]] = groups[some], lasting[some]
                    at = np.frombuffer(spots, spot_kind(len(own)))
                    path[path == np.iinfo(kind).max] = own[at]
                    seen = logs[at]
                    known[k] += (seen >= 0).sum()
                    emitted[k] += seen[seen >= 0].sum()
                paths.append(path.tobytes())
            columns = [pa.array(known), pa.array(emitted), pa.array(paths, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=[x.split()[0] for x in PATHS.split(", ")])

    return run


def _whole(path: bytes, classes: int) -> np.ndarray:
    """With the text's end, class 0, on both sides."""
    return np.concatenate([[0], np.frombuffer(path, class_kind(classes)), [0]]).astype(np.int64)


def _steps(classes: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                whole = _whole(path, classes)
                seen += np.bincount(whole[:-1] * classes + whole[1:], minlength=classes * classes)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    return run


def _scores(sums):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, room = sums.value
        for batch in batches:
            out = []
            for path in batch.column(batch.num_columns - 1).to_pylist():
                whole = _whole(path, len(step))
                out.append(step[whole[:-1], whole[1:]].sum() - room[whole[1:]].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "path"])

    return run


def least_frequent(counts: DataFrame, frequent: int) -> int:
    """The least count (one of a geometric scale) that at most ``frequent`` words reach."""
    scale = F.floor(F.log2("n") * 32)
    steps = counts.groupBy(scale.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("s")).collect()  # 32 rows for each doubling of counts
    least, total = 1 << 62, 0
    for r in steps:
        total += r.k
        if total > frequent:
            break
        least = r.n
    return least


def cluster(training: DataFrame, counts: DataFrame, least: int, *, clustered: int = CLUSTERED, endings: int = ENDINGS, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Items, np.ndarray, DataFrame]:
    """Items and their classes, and (word, n, class) of all words that aren't clustered; words of ``least`` or more are broadcast."""
    spark = training.sparkSession
    top = counts.filter(F.col("n") >= least).toArrow()  # at most ``frequent`` rows
    number = top.column("n").to_numpy()
    order = np.lexsort((np.array(top.column("word").to_pylist(), object), -number)) if len(number) else np.empty(0, np.int64)
    words, number = top.column("word").take(pa.array(order)).to_pylist(), number[order]
    clustered = min(clustered, len(words))
    tails = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in words[:clustered]], "word binary")), "word", "left_anti")
    tails = tails.groupBy(F.substring("word", -ENDING, ENDING).alias("e")).agg(F.sum("n").alias("n"))
    ends = tails.orderBy(F.desc("n"), "e").limit(endings).collect()
    items = Items(words, number, clustered, [bytes(r.e) for r in ends])
    size = items.rest + 1
    found = training.select("text").mapInArrow(_bigrams(shared(spark, items)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # (items + 1) ** 2 rows at most
    pairs = np.zeros(size * size)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    del found
    pairs = pairs.reshape(size, size)
    group = exchange(pairs, classes, rounds)
    one = np.zeros((size, classes))
    one[np.arange(size), group] = 1
    first = shared(spark, (items, group))
    contexts = training.select("text").mapInArrow(_contexts(first, classes), "word binary, counts binary").groupBy("word").agg(F.collect_list("counts").alias("counts"))
    assigned = checkpoint(contexts.mapInArrow(_assign(first, shared(spark, one.T @ pairs @ one)), "word binary, n long, class long"))
    own = assigned.filter(F.col("n") >= least).select("word", "class").toArrow()  # at most ``frequent`` rows
    place = dict(zip(own.column("word").to_pylist(), own.column("class").to_pylist(), strict=True))
    group = np.concatenate([group, np.array([place[w] for w in words[clustered:]], np.int64)])
    return Items(words, number, clustered, items.endings, True), group, assigned


def class_paths(rows: DataFrame, items: Items, group: np.ndarray, assigned: DataFrame, least: int, classes: int) -> DataFrame:
    """doc_id, held_out, training, n_tokens, n_known, emitted and path of rows of doc_id, h (hash of the text), held_out, training and text.

    Only words that aren't frequent and paths of classes are shuffled, never texts.
    """
    known = checkpoint(rows.select("doc_id", "h", "held_out", "training", "text").mapInArrow(_known(shared(rows.sparkSession, (items, group)), classes), KNOWN))
    rare = known.select("doc_id", "h", F.posexplode("names").alias("i", "word"))
    met = rare.join(assigned.filter(F.col("n") < least), "word").groupBy("doc_id", "h").agg(F.collect_set(F.struct("i", "n", "class")).alias("rare")).select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "rare")
    both = known.join(met, known["doc_id"].eqNullSafe(F.col("d")) & (known["h"] == F.col("k")), "left").select("doc_id", "held_out", "training", "n_tokens", "n_known", "emitted", "path", "spots", "endings", "rare")
    return both.mapInArrow(_paths(classes), PATHS)


def finish(items: Items, group: np.ndarray, assigned: DataFrame, training: DataFrame, counts: DataFrame, paths: DataFrame, classes: int) -> Model:
    """Statistics of the classes over all words."""
    texts = training.count()
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole.n or 0) + texts, int(whole.v) + (texts > 0)
    found = paths.filter("training").select("path").mapInArrow(_steps(classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # classes ** 2 rows at most
    joint = np.zeros(classes * classes)
    joint[[r.pair for r in found]] = [r.n for r in found]
    joint = joint.reshape(classes, classes)
    share = (joint.sum(0) + 1) / (joint.sum() + classes)
    step = np.log10((joint + SMOOTH * share) / (joint.sum(1, keepdims=True) + SMOOTH))
    amount = np.bincount(group[1 : items.clustered + 1], items.counts[: items.clustered] + 1.0, classes)
    for r in assigned.groupBy("class").agg((F.sum("n") + F.count("*")).alias("n")).collect():  # a row for each class
        amount[r["class"]] += r.n
    room = np.log10(amount + 1)
    room[0] = 0
    return Model(items, group, step, room, float(np.log10(n + v + 1)), float(np.log10(texts + 1)), n, texts == 0)


def learn(training: DataFrame, counts: DataFrame, least: int, *, classes: int = CLASSES, **parameters) -> Model:
    """Classes and their statistics; ``counts``: (word, n) of the whole training text; words of ``least`` or more are broadcast."""
    items, group, assigned = cluster(training, counts, least, classes=classes, **parameters)
    rows = training.select(F.lit(None).cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.lit(False).alias("held_out"), F.lit(True).alias("training"), "text")
    return finish(items, group, assigned, training, counts, class_paths(rows, items, group, assigned, least, classes), classes)


def score(docs: DataFrame, *, frequent: int = FREQUENT, classes: int = CLASSES, **parameters) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Learned from the rows that aren't held out (rows without id are neither held out nor learned from). Null and empty
    texts have one token, the end. Without training text both scores are those of no counts, 0. Rows that repeat count as
    often as they come and keep their rows; other columns are left out, whatever their names. Very long texts are whole: a task holds
    a text's words and classes. Words of one count are ordered by their bytes.
    """
    remainder = crc_mod("doc_id", FOLDS)
    rows = with_empty_text(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(remainder != HELD_OUT, F.lit(False)).alias("training"))
    training = rows.filter("training")
    counts = checkpoint(training.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    least = least_frequent(counts, frequent)
    items, group, assigned = cluster(training, counts, least, classes=classes, **parameters)
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), "held_out", "training", "text")
    paths = checkpoint(class_paths(keyed, items, group, assigned, least, classes))
    m = finish(items, group, assigned, training, counts, paths, classes)
    own = paths.drop("training").mapInArrow(_scores(shared(docs.sparkSession, (m.step, m.room))), "doc_id long, held_out boolean, n_tokens long, n_known long, emitted double, path double")
    base = F.col("emitted") + F.lit(m.end_log) - F.col("n_tokens") * F.lit(m.base_room)
    known = F.col("n_known") + F.lit(int(m.train_tokens > 0))
    return own.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(m.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base if m.base_only else F.col("emitted") + F.col("path")).alias("score"))
