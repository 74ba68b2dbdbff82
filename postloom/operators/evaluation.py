"""Votes, precision and recall, calibration, correlations and bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.session import checkpoint
from postloom.sources.readers import lookup


def majority(votes: DataFrame, item: str, kind: str, worker: str, score: str) -> DataFrame:
    """item, kind, winner: the strictly most frequent score of at least two workers; a worker votes once, with the least score."""
    once = votes.groupBy(item, kind, worker).agg(F.min(score).alias(score))
    counts = once.groupBy(item, kind, score).agg(F.count("*").alias("n"))
    top = counts.groupBy(item, kind).agg(F.max("n").alias("best"), F.max_by(score, "n").alias("winner"), F.collect_list("n").alias("ns"))  # a number for each score
    tied = F.size(F.filter("ns", lambda n: n == F.col("best"))) > 1
    return top.filter((F.col("best") > 1) & ~tied).select(item, kind, "winner")


def complete(winners: DataFrame, item: str, kind: str, kinds: list[str]) -> DataFrame:
    """Items that have a winner for all kinds, one column for each."""
    wide = winners.groupBy(item).pivot(kind, kinds).agg(F.first("winner"))
    return wide.na.drop(subset=kinds)


def attention(checks: DataFrame, worker: str, order: str, answer: str, expected: list[str], blocks: tuple[tuple[int, ...], ...], least: int = 0) -> DataFrame:
    """worker, answers in order of the checks (``_`` between them) and class; workers of a class below ``least`` are dropped.

    Checks are numbered from 0; a missing or null answer is empty, and of several the least counts. ``blocks`` holds the two
    groups of checks that catch careless workers. Class 3: all answers as expected; 2: both groups are; 1: one group is; 0: none.
    """
    slots = [F.coalesce(F.min(F.when(F.col(order) == k, F.col(answer))), F.lit("")) for k in range(len(expected))]
    rows = checks.groupBy(worker).agg(F.array(*slots).alias("_a"))
    right = F.zip_with("_a", F.array(*map(F.lit, expected)), lambda x, y: x == y)
    passed = [reduce(lambda a, b: a & b, (F.element_at(right, k + 1) for k in block)) for block in blocks]
    kind = F.when(F.forall(right, lambda ok: ok), 3).when(reduce(lambda a, b: a & b, passed), 2).when(reduce(lambda a, b: a | b, passed), 1).otherwise(0)
    return rows.select(worker, F.array_join("_a", "_").alias("answers"), kind.cast("int").alias("class")).filter(F.col("class") >= least)


def precision(label: Column, inside: Column, least: int = 2) -> Column:
    """Share of positives among labelled rows inside; null for fewer than ``least``."""
    n = F.count_if(inside & label.isNotNull())
    return F.when(n >= least, F.avg(F.when(inside, label.cast("double"))))


def recall(label: Column, found: Column) -> Column:
    """Share of positives that are found, in percent."""
    return 100 * F.try_divide(F.count_if((label == 1) & found), F.count_if(label == 1))


def confusion(truth: Column, guess: Column) -> list[Column]:
    return [F.count_if((truth == t) & (guess == g)).alias(name) for name, t, g in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def auc(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """``by``, n_pos, n_neg and auc: the share of pairs of a positive and a negative row that the score orders rightly, ties as half.

    Exact: scores are counted by label and sorted by range partitions of (``by``, score); a task sums its own part, and the
    negatives of the partitions before count for all its positives. Null scores and labels take no part; auc is null where a group has one label.
    """
    import numpy as np
    import pandas as pd

    known = rows.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    counts = known.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    order = [*by, "_s"]

    def run(frames):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for frame in frames:
            if by:
                columns = [frame[c] for c in by]
                same = np.logical_and.reduce([(c.eq(c.shift()) | (c.isna() & c.shift().isna())).to_numpy() for c in columns])
                heads = np.flatnonzero(~same | (np.arange(len(frame)) == 0))
            else:
                heads = np.zeros(min(len(frame), 1), int)
            for k, stop in zip(heads, np.append(heads[1:], len(frame)), strict=True):
                some = frame.iloc[k:stop]
                pos, neg = some["pos"].to_numpy(float), some["neg"].to_numpy(float)
                key = tuple(None if pd.isna(v) else v for v in some[by].iloc[0]) if by else ()
                if last is None or key != last[0]:
                    if last is not None:
                        yield row(part, last)
                    last = [key, 0.0, 0.0, 0.0]
                last[1] += float((pos * (last[3] + np.cumsum(neg) - neg / 2)).sum())
                last[2] += pos.sum()
                last[3] += neg.sum()
        if last is not None:
            yield row(part, last)

    def row(part, found):
        key, wins, pos, neg = found
        return pd.DataFrame({**{c: [v] for c, v in zip(by, key, strict=True)}, "part": [part], "wins": [wins], "pos": [pos], "neg": [neg]})

    kinds = dict(counts.dtypes)
    parts = checkpoint(counts.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, "".join(f"`{c}` {kinds[c]}, " for c in by) + "part int, wins double, pos double, neg double"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group and partition
    summed = parts.withColumn("before", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))).groupBy(*by).agg(F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"), F.sum(F.col("wins") + F.col("pos") * F.col("before")).alias("w"))
    return summed.select(*by, "n_pos", "n_neg", F.try_divide("w", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))


def report(rows: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """``by``, class, precision, recall, f1 and support of classes 0 and 1; null where nothing is to be divided by."""
    c = rows.groupBy(*by).agg(*confusion(F.col(truth), F.col(guess)))
    of = lambda k, hit, wrong, missed: F.struct(F.lit(k).alias("class"), F.col(hit).alias("hit"), F.col(wrong).alias("wrong"), F.col(missed).alias("missed"))
    each = c.select(*by, F.explode(F.array(of(0, "tn", "fn", "fp"), of(1, "tp", "fp", "fn"))).alias("c")).select(*by, "c.*")
    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    return each.select(*by, "class", F.try_divide(hit, hit + wrong).alias("precision"), F.try_divide(hit, hit + missed).alias("recall"), F.try_divide(2.0 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))


def ordered_counts(rows: DataFrame, value: str) -> DataFrame:
    """value, c and before of each distinct known value: how many rows have it, and a smaller one.

    Only distinct values are sorted, by range partitions; sums run within a partition, and the totals of those before are added.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))

    def run(frames):
        from pyspark import TaskContext

        part, below = TaskContext.get().partitionId(), 0
        for frame in frames:
            upto = frame["c"].cumsum() + below
            yield frame.assign(within=upto - frame["c"], part=part)
            below = int(upto.iloc[-1]) if len(frame) else below

    kind = dict(counts.dtypes)[value]
    placed = checkpoint(counts.repartitionByRange(value).sortWithinPartitions(value).mapInPandas(run, f"`{value}` {kind}, c long, within long, part int"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.sum("c").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("below"))  # a row for each partition
    return placed.join(F.broadcast(offsets), "part").select(value, "c", (F.col("within") + F.col("below")).alias("before"))


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """Each distinct value and the mean rank of its rows."""
    return ordered_counts(rows, value).select(value, (F.col("before") + (F.col("c") + 1) / 2).alias(f"{value}_rank"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns; few distinct values' ranks are broadcast, under a check of their number."""
    r = lookup(lookup(rows, average_ranks(rows, a), a), average_ranks(rows, b), b)
    return r.agg(F.corr(a, b).alias("pearson"), F.corr(f"{a}_rank", f"{b}_rank").alias("spearman"))


#: Values of a digit of a rank, by which inversions are counted.
DIGIT = 256


def inversions(values) -> int:
    """Pairs of which the first is greater, counted while sorted halves are merged."""
    import numpy as np

    _, rank = np.unique(values, return_inverse=True)
    n, width, total = len(rank), 1, 0
    span = int(rank.max()) + 1 if n else 1
    place = np.arange(n)
    rank = rank.astype(np.int64)
    while width < n:
        block = place // (2 * width)
        left = place % (2 * width) < width
        key = block * span + rank
        lefts = key[left]  # sorted: each left half is
        upto = np.searchsorted(lefts, key[~left], "right")
        ends = np.minimum((block[~left] + 1) * width, len(lefts))  # left halves before a right one are whole
        total += int((ends - upto).sum())
        rank = np.sort(key) - block * span
        width *= 2
    return total


def beside(*rows: DataFrame) -> DataFrame:
    """One row of all columns of frames that have one row each."""
    columns = [c for r in rows for c in r.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).agg(*(F.max(c).alias(c) for c in columns))


def falls(rows: DataFrame, a: str, rank: str, size: int) -> DataFrame:
    """``n``: pairs of rows that rise strictly in ``a`` or tie there, and in (a, rank) order fall in ``rank`` (from 0, below ``size``).

    A pair falls where the first digit that differs falls, so digits are counted one after the other, among the rows that share
    all digits before. Rows are dealt by these and (a, rank) to range partitions; a task counts its own pairs with numpy, a batch at
    a time, and hands on how often each digit came in the runs that its partition's borders cut. Only those counts meet.
    """
    import numpy as np
    import pandas as pd

    def within(base: int):
        def run(frames):
            from pyspark import TaskContext

            part, total, edge = TaskContext.get().partitionId(), 0, []
            run_prefix, seen = None, np.zeros(DIGIT, np.int64)

            def close(first: bool):
                if run_prefix is not None and first:
                    edge.append((run_prefix, seen.copy()))

            runs = 0
            for frame in frames:
                prefix, digit = (frame[rank] // (base * DIGIT)).to_numpy(), (frame[rank] // base % DIGIT).to_numpy()
                heads = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(frame) else np.zeros(0, int)
                for k, stop in zip(heads, np.append(heads[1:], len(prefix)), strict=True):
                    if prefix[k] != run_prefix:
                        close(runs == 1)
                        run_prefix, runs = prefix[k], runs + 1
                        seen[:] = 0
                    own = digit[k:stop]
                    above = seen.sum() - np.cumsum(seen)  # earlier rows with a greater digit
                    total += int(above[own].sum()) + inversions(own)
                    seen += np.bincount(own, minlength=DIGIT)
            close(runs >= 1)  # the last run, and the first one when it ended
            yield pd.DataFrame({"part": [part] * (len(edge) + 1), "prefix": [-1, *(int(p) for p, _ in edge)], "n": [total] + [0] * len(edge), "digits": [None, *(h.tolist() for _, h in edge)]})

        return run

    def between(frames):
        prefix, seen, total = None, np.zeros(DIGIT, np.int64), 0
        for frame in frames:
            for p, digits in zip(frame["prefix"], frame["digits"], strict=True):
                own = np.asarray(digits, np.int64)
                if p != prefix:
                    prefix, seen = p, np.zeros(DIGIT, np.int64)
                total += sum(int(x) * int(y) for x, y in zip(own, seen.sum() - np.cumsum(seen), strict=True))
                seen = seen + own
        yield pd.DataFrame({"n": [total]})

    found = None
    base = 1
    while base < max(size, 1):
        order = [F.floor(F.col(rank) / (base * DIGIT)), a, rank]
        parts = checkpoint(rows.select(a, rank).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(within(base), "part int, prefix long, n long, digits array<long>"))
        cut = parts.filter("digits IS NOT NULL").repartition("prefix").sortWithinPartitions("prefix", "part").mapInPandas(between, "n long")  # two rows a partition at most
        both = parts.filter("digits IS NULL").select("n").unionByName(cut)
        found = both if found is None else found.unionByName(both)
        base *= DIGIT
    return found.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")) if found is not None else rows.agg(F.lit(0).cast("decimal(38,0)").alias("n"))


def kendall(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-a and mean squared difference, of rows where both are known.

    Pairs that fall are counted by the digits of the second value's rank (``falls``), ties from the numbers of equal values, and the
    pairs that rise are the rest; no two rows are compared, and no task's memory grows with the rows.
    """
    both = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    placed = checkpoint(lookup(both, ordered_counts(both, "b").select("b", "before"), "b"))
    n = placed.count()
    pairs = lambda keys: placed.groupBy(*keys).agg(F.count("*").cast("decimal(38,0)").alias("c")).agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).cast("double").alias("n"))
    tied = beside(pairs(["a"]).withColumnRenamed("n", "ta"), pairs(["b"]).withColumnRenamed("n", "tb"), pairs(["a", "b"]).withColumnRenamed("n", "tab"), falls(placed, "a", "before", n).select(F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("fall")), placed.agg(F.avg(F.pow(F.col("a") - F.col("b"), 2)).alias("mse")))
    total = n * (n - 1.0) / 2
    rise = F.lit(total) - F.col("fall") - F.col("tb")  # pairs of one a rise in this order too, but don't count
    return tied.select(F.try_divide(rise - F.col("fall") - (F.col("ta") - F.col("tab")), F.lit(total)).alias("tau"), "mse")


def bootstrap_draws(rows: DataFrame, key: str, label: str, rounds: int) -> DataFrame:
    """``round`` and the rows drawn in it: as many positives as there are, with replacement, and as many negatives.

    A round's negatives are drawn with replacement from a run of as many in an order by digest, which begins at a place of its
    own in each round. All places are digests of round and draw, so a rerun draws the same; nulls take no part.
    """
    from postloom.operators.retrieval import RANGE_ROWS, hash_order, hash_place, numbered

    spark = rows.sparkSession
    sides, sizes = [], []
    for k in (1, 0):
        side = rows.filter(F.col(label) == k).withColumn("_order", hash_order(F.col(key)))
        sides.append(numbered(side, [F.col("_order")]).withColumn("_i", F.col("rank") - 1).drop("rank", "_order"))
        sizes.append(side.count())
    n, out = min(sizes), []
    for k, name in ((0, "p"), (1, "n")):
        size, times = sizes[k], sizes[0] if k == 0 else n
        draws = spark.range(rounds * times, numPartitions=max(1, rounds * times // RANGE_ROWS)).select((F.floor(F.col("id") / max(times, 1)) + 1).cast("long").alias("round"), (F.col("id") % max(times, 1)).alias("j"))
        at = hash_place(F.concat_ws(":", F.lit(name), "round", "j"), max(times, 1))
        if k:
            at = (hash_place(F.concat_ws(":", F.lit("start"), "round"), max(size, 1)) + at) % max(size, 1)
        out.append(draws.select("round", at.alias("_i")).join(sides[k], "_i").drop("_i"))
    return out[0].unionByName(out[1])


def platt(rows: DataFrame, x: str, y: str, by: str, steps: int = 25) -> DataFrame:
    """Slope and intercept of an unpenalised logistic fit in each group: Newton steps on sums that Spark aggregates.

    Null where a group has one label only. All groups take their steps together; a step is one aggregation.
    """
    fits = rows.groupBy(by).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi")).filter("_lo < _hi").select(by, F.lit(0.0).alias("slope"), F.lit(0.0).alias("intercept"))
    for _ in range(steps):
        z = F.col("slope") * F.col(x) + F.col("intercept")
        p = 1 / (1 + F.exp(-z))
        parts = rows.join(fits, by).withColumns({"_p": p, "_w": p * (1 - p)})
        s = parts.groupBy(by, "slope", "intercept").agg(*(F.sum(e).alias(n) for n, e in (("ga", (F.col(y) - F.col("_p")) * F.col(x)), ("gb", F.col(y) - F.col("_p")), ("haa", F.col("_w") * F.col(x) * F.col(x)), ("hab", F.col("_w") * F.col(x)), ("hbb", F.col("_w")))))
        d = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        step = s.select(by, (F.col("slope") + F.try_divide(F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb"), d)).alias("slope"), (F.col("intercept") + F.try_divide(F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga"), d)).alias("intercept"))
        fits = checkpoint(step)
    return fits


def bootstrap_platt(rows: DataFrame, key: str, score: str, label: str, rounds: int) -> DataFrame:
    """round, slope and intercept of an unpenalised logistic fit of the label on the score in every round of ``bootstrap_draws``.

    Draws are counted by (round, score, label), and all rounds take their Newton steps together on these counts. Rounds that
    can't be fitted have null values.
    """
    from postloom.operators.regression import logit

    drawn = bootstrap_draws(rows.select(key, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")), key, "label", rounds)
    counts = checkpoint(drawn.groupBy("round", "score", "label").agg(F.count("*").alias("n")))
    fits = logit(counts, "label", ["score"], ["round"], weight="n")
    wide = lambda term: F.max(F.when(F.col("term") == term, F.col("coefficient")))
    return fits.groupBy("round").agg(wide("score").alias("slope"), wide("const").alias("intercept"))


def intervals(fits: DataFrame, by: list[str], values: list[str], share: float = 0.95) -> DataFrame:
    """``by``, fitted and, for each value, its mean and the exact quantiles that hold ``share`` of the rounds between them."""
    ends = [(1 - share) / 2, (1 + share) / 2]
    return fits.groupBy(*by).agg(F.count(values[0]).alias("fitted"), *(e for v in values for e in (F.avg(v).alias(v), F.percentile(v, ends[0]).alias(f"{v}_low"), F.percentile(v, ends[1]).alias(f"{v}_high"))))
