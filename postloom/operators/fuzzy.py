"""Similarity of short texts by their sets of words, for pairs at hand and between two tables.

The ratio of two texts is the best of three comparisons between the words that both have, and those with the rest of either
text behind; two strings are compared by twice their longest common subsequence over their lengths. The subsequence is found
by bits of whole rows at once, in Arrow batches, and only for the words that differ. All else is in the JVM.

Tables are joined by keys: a pair can only reach the threshold if it shares one of a few rare words, or two of a few rare pairs of
neighbouring letters (how few follows from the threshold and the lengths), so no two texts are compared that share none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, floor

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Counts of the most frequent words and pairs of letters, which order them by rarity; all others count as rarest.
FREQUENT = 50_000
#: Below this threshold texts need share nothing.
LEAST = 70.0


def words_of(text: Column) -> Column:
    """The distinct words (runs of letters, digits and underscores) in lower case, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != "")))


def key_of(text: Column) -> Column:
    """The words of a text as one; texts of one key are as similar to any other."""
    return F.array_join(words_of(text), " ")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: each character of b moves a row of bits, one for each character of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _subsequences(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _ratio(a: Column, b: Column, shared: Column) -> tuple[Column, Column]:
    """The better ratio of the shared words to either text, and that of the two texts, if their rests share ``shared`` characters."""
    both, one, two = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
    size = lambda words: F.length(F.array_join(words, " "))
    n0, n1, n2 = size(both), size(one), size(two)
    behind = lambda n: F.when((n0 > 0) & (n > 0), n0 + 1 + n).otherwise(n0 + n)
    within = lambda n: F.when(n0 > 0, 2 * n0 / (n0 + behind(n))).otherwise(F.lit(0.0))
    common = F.when((n0 > 0) & (n1 > 0) & (n2 > 0), n0 + 1).otherwise(n0) + shared
    across = F.try_divide(2.0 * common, behind(n1) + behind(n2))
    return F.greatest(within(n1), within(n2)), across


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts in percent, whatever the order and number of their words; 0 if either has no words, null for a null text."""
    x, y = words_of(a), words_of(b)
    rest = lambda p, q: F.coalesce(F.array_join(F.array_except(p, q), " "), F.lit(""))
    near, across = _ratio(x, y, _subsequences(rest(x, y), rest(y, x)))
    some = F.when((F.size(x) > 0) & (F.size(y) > 0), 100 * F.greatest(near, across)).otherwise(F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), some)


# ---- keys of a join ----


def unshared_weight(length: int, tau: float) -> float:
    """What the words that a text of this length doesn't share may weigh (their lengths and one each), if those shared are to be ``tau`` similar to it."""
    kappa = (1 - tau) / tau
    return 2 * length * kappa / (1 + 2 * kappa)


@cache
def prefix_sizes(length: int, tau: float) -> tuple[int, int]:
    """How many of the rarest pairs of letters of a text to take, so that a text ``tau`` similar to it has two of its own in common; and
    so that it has one, for those partners that need share one only (0 if there are none).

    ``tau`` bounds the letters deleted (x) and inserted (y) from one to the other. A deletion takes two pairs away at most, and an
    insertion one, so all but 2x + y of a text's length + 1 pairs (with its ends) are kept.
    """
    two = one = 0
    for other in range(max(1, ceil(length * tau / (2 - tau) - 1e-9)), floor(length * (2 - tau) / tau + 1e-9) + 1):
        edits = floor((1 - tau) * (length + other) + 1e-9)
        gap = abs(length - other)
        if edits < gap:
            continue
        edits -= (edits - gap) % 2
        lost = (3 * edits + length - other) // 2
        if length + 1 - lost >= 2:
            two = max(two, lost + 2)
        else:
            one = max(one, lost + 1)
    return two, one


def letter_pairs(key: str) -> list[tuple[str, int]]:
    """Neighbouring characters, with a blank at both ends, each with the number of equal ones before it; the same for any order of the words."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(key) + 1):
        pair = (f" {key} ")[i : i + 2]
        out.append((pair, seen[pair]))
        seen[pair] += 1
    return out


def codes(key: str, left: bool, tau: float, word_counts: dict[str, int], pair_counts: dict[str, int]) -> set[int]:
    """Numbers of which two texts of the two sides share one if their ratio is ``tau`` or more."""
    number = lambda *parts: xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)
    words = sorted(key.split(" "), key=lambda w: (word_counts.get(w, 0), w))
    room, weight, prefix = unshared_weight(len(key), tau) + 1e-9, 0, []
    for w in words:
        prefix.append(w)
        weight += len(w) + 1
        if weight > room:
            break
    # a text whose words the other one nearly all has: its prefix meets all words of the other
    found = {number("in" if left else "out", w) for w in prefix} | {number("out" if left else "in", w) for w in words}
    pairs = sorted(letter_pairs(key), key=lambda p: (pair_counts.get(p[0], 0), p))
    two, one = prefix_sizes(len(key), tau)
    found |= {number("pairs", *p, *q) for p, q in combinations(pairs[:two], 2)}
    return found | {number("pair", *p) for p in pairs[:one]}


def _frequent(keys: DataFrame, each) -> dict[str, int]:
    """How many keys hold each of the most frequent values of ``each`` (an array of a key); FREQUENT rows at most."""
    counts = keys.select(F.explode(F.array_distinct(each)).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return {r.v: r.n for r in counts.orderBy(F.desc("n"), "v").limit(FREQUENT).collect()}


def similar_keys(left: DataFrame, right: DataFrame, left_text: str, right_text: str, threshold: float) -> DataFrame:
    """left_key, right_key and ratio of all pairs of keys (see ``key_of``) of the two tables at ``threshold`` percent or over.

    Rows of one key are compared once: join their texts' keys for the rows. Texts without words and null ones are similar to
    none. Every pair at the threshold is found; the number of pairs is that of the result, which short texts can make large,
    as a text is wholly similar to all that hold its words. Thresholds below LEAST are refused.
    """
    if threshold < LEAST:
        raise ValueError(f"a threshold below {LEAST} has no keys")
    tau = threshold / 100
    sides = [rows.select(key_of(F.col(text)).alias("key")).filter("key != ''").distinct() for rows, text in ((left, left_text), (right, right_text))]
    both = sides[0].unionByName(sides[1])
    padded = F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(padded, i, F.lit(2)))
    word_counts, pair_counts = _frequent(both, F.split("key", " ")), _frequent(both, pairs)

    def coded(rows: DataFrame, is_left: bool, name: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for key in frame["key"]:
                    found = codes(key, is_left, tau, word_counts, pair_counts)
                    yield pd.DataFrame({"code": list(found), name: key})

        return rows.mapInPandas(run, f"code long, {name} string")

    met = coded(sides[0], True, "left_key").join(coded(sides[1], False, "right_key"), "code").select("left_key", "right_key").distinct()
    # what lengths alone allow, before any letters are compared
    a, b = F.split("left_key", " "), F.split("right_key", " ")
    least = F.least(*(F.length(F.array_join(F.array_except(p, q), " ")) for p, q in ((a, b), (b, a))))
    near, across = _ratio(a, b, least)
    possible = met.filter(100 * F.greatest(near, across) >= threshold - 1e-9)
    return possible.withColumn("ratio", token_set_ratio(F.col("left_key"), F.col("right_key"))).filter(F.col("ratio") >= threshold - 1e-9)


def best_matches(left: DataFrame, right: DataFrame, left_text: str, right_text: str, threshold: float) -> DataFrame:
    """Each key of the left table with the most similar key of the right one at the threshold, ties to the first in order."""
    pairs = similar_keys(left, right, left_text, right_text, threshold)
    best = F.min(F.struct((-F.col("ratio")).alias("_r"), "right_key", "ratio")).alias("b")
    return pairs.groupBy("left_key").agg(best).select("left_key", "b.right_key", "b.ratio")
