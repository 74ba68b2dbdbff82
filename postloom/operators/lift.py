"""Word, n-gram and keyword lift, co-occurrence and lexicon scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Characters of texts, about, whose n-grams a task counts at once.
CHUNK = 1 << 23


def _counted(texts: pa.Array, part: pa.Array, number: pa.Array, n: int) -> list[pa.Array]:
    """by, gram, n, total and known of the distinct n-grams of some texts: words are numbered, and their numbers sorted, not the texts."""
    tokens = pc.split_pattern(texts.cast(pa.large_string()), " ")
    row, word = pc.list_parent_indices(tokens).to_numpy(), pc.list_flatten(tokens)
    count = max(len(word) - n + 1, 0)
    code = word.dictionary_encode()
    codes, most = code.indices.to_numpy().astype(np.int64), len(code.dictionary)
    at = np.flatnonzero(row[:count] == row[n - 1 : n - 1 + count])  # n-grams within one text
    key, size = part.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)[row[at]], len(texts)
    for k in range(n):
        if size * most >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            size = len(found)
        key, size = key * most + codes[at + k], size * most
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    at, first = at[order], at[order[starts]]
    grams = [code.dictionary.take(code.indices.take(pa.array(first + k))) for k in range(n)]
    sums = [np.add.reduceat(v[row[at]], starts) if len(key) else np.zeros(0, np.int64) for v in (number.fill_null(0).to_numpy(), number.is_valid().cast(pa.int64()).to_numpy())]
    return [part.take(pa.array(row[first])), pc.binary_join_element_wise(*grams, pa.scalar(" ", pa.large_string())).cast(pa.string()), *(pa.array(v, pa.int64()) for v in (np.diff(np.append(starts, len(key))), *sums))]


def ngram_counts(docs: DataFrame, n: int, by: Column | None = None, number: Column | None = None, text: str = "text") -> DataFrame:
    """by (if given), gram, n and (with ``number``, a whole number) total and known: occurrences of the n-grams of the blank-separated words
    of the lower-case text, the sum of their texts' numbers, and of how many these aren't null. Null texts have none.

    Each task counts the n-grams of some texts at a time, so that it's their distinct ones that are shuffled.
    """
    rows = docs.select(F.lower(text).alias("text"), (F.lit(0) if by is None else by).alias("by"), (F.lit(0) if number is None else number).cast("long").alias("number"))
    kind = rows.schema["by"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(0)), 0).cast(pa.int64())).to_numpy()
            start = 0
            while start < len(size):
                end = max(int(size.searchsorted((size[start - 1] if start else 0) + CHUNK, "right")), start + 1)
                texts, part, numbers = (c.slice(start, end - start) for c in batch.columns)
                start = end
                yield pa.RecordBatch.from_arrays(_counted(texts, part, numbers, n), names=["by", "gram", "n", "total", "known"])

    counted = rows.mapInArrow(run, f"by {kind}, gram string, n long, total long, known long")
    return counted.groupBy(*([] if by is None else ["by"]), "gram").agg(*(F.sum(c).alias(c) for c in (["n"] if number is None else ["n", "total", "known"])))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: occurrences of the blank-separated words of the lower-case text."""
    return docs.select(F.explode(F.split(F.lower(text), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lexicon_scores(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, n_scored and mean score of the words that a lexicon (word, score) has."""
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.join(lexicon, "word").groupBy("doc_id").agg(F.count("*").alias("n_scored"), F.avg("score").alias("sentiment"))


def cooccurrence(docs: DataFrame, keywords: list[str], top: int | None = None) -> DataFrame:
    """keyword, word, n (in texts with the keyword), n_all and pct; all keywords in one pass over the texts."""
    lowered = docs.select(F.lower("text").alias("text"))
    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("text"), k))
    each = F.split("text", " ")
    # repeated for the words inside one expression, so that a text is searched once and not for each of its words
    paired = F.arrays_zip(each.alias("word"), F.array_repeat(hits, F.size(each)).alias("hits"))
    words = lowered.select(F.inline(paired).alias("word", "hits")).groupBy("word", "hits").agg(F.count("*").alias("n"))
    total = words.groupBy("word").agg(F.sum("n").alias("n_all"))
    near = words.select("word", "n", F.explode("hits").alias("keyword")).groupBy("keyword", "word").agg(F.sum("n").alias("n"))
    out = near.join(total, "word").select("keyword", "word", "n", "n_all", (F.col("n") / F.col("n_all")).alias("pct"))
    if top is None:
        return out
    order = Window.partitionBy("keyword").orderBy(F.desc("n"), "word")
    return out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).drop("k")


def lift(part: DataFrame, whole: DataFrame, key: str, part_size: int | Column, whole_size: int | Column) -> DataFrame:
    """key, n_part, n_whole, lift of counts (key, n) in a part over those in the whole; missing in the whole: null."""
    both = part.withColumnRenamed("n", "n_part").join(whole.withColumnRenamed("n", "n_whole"), key, "left")
    return lift_of(both, part_size, whole_size)


def lift_of(counts: DataFrame, part_size: int | Column, whole_size: int | Column) -> DataFrame:
    """The rows (n_part, n_whole) with their lift."""
    return counts.withColumn("lift", F.try_divide(F.col("n_part") / F.lit(part_size), F.col("n_whole") / F.lit(whole_size)))
