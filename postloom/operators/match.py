"""Substring search of many patterns at once, without comparing every text with every pattern."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import ngrams
from postloom.session import checkpoint

#: Inner words of a sentence by which texts and sentences meet, at most.
INNER = 3


#: Bytes of phrases that one automaton holds, about.
PART_BYTES = 1 << 24


def automaton(phrases: list[str]):
    """An Aho-Corasick automaton of the phrases."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        made.add_word(p)
    made.make_automaton()
    return made


def parts_of(phrases: DataFrame, column: str, part_bytes: int = PART_BYTES) -> Iterator[list[str]]:
    """The distinct phrases, dealt by digest into parts of about ``part_bytes``, one after the other."""
    known = checkpoint(phrases.select(F.col(column).cast("string").alias("phrase")).filter(F.length("phrase") > 0).distinct())
    size = known.agg(F.sum(F.octet_length("phrase")).alias("n")).first().n or 0
    n = max(1, -(-size // part_bytes))
    for k in range(n if size else 0):
        if part := [r.phrase for r in known.filter(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k).collect()]:  # part_bytes, about
            yield part


def scanned(docs: DataFrame, text: str, phrases: DataFrame, column: str, part_bytes: int = PART_BYTES) -> list[DataFrame]:
    """For each part of the phrases, the rows of ``docs`` whose text holds any of them: one scan of the texts a part, whatever their number."""
    from postloom.functions.text import in_blocks

    found = []
    for part in parts_of(phrases, column, part_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            import pyarrow as pa

            machine = automaton(sent.value)
            for batch in batches:
                k = batch.schema.get_field_index(text)
                for some in in_blocks(batch, k):
                    hits = [t is not None and next(machine.iter(t), None) is not None for t in some.column(k).to_pylist()]
                    yield some.filter(pa.array(hits, pa.bool_()))

        found.append(docs.mapInArrow(run, docs.schema))
    return found


def contains_any(docs: DataFrame, sentences: DataFrame, inner: int = INNER, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id and whether any sentence is a substring of its text, for each row of ``docs``.

    The words after a sentence's first one, but for its last, stand whole in any text that holds the sentence, so texts and
    sentences meet by up to ``inner`` of them and only then are compared. Sentences of one or two words have none; an automaton of
    them, in parts of about ``part_bytes``, scans each text once a part.
    """
    words = F.split("sentence", " ")
    known = sentences.filter(F.length("sentence") > 0).distinct().withColumn("k", F.least(F.greatest(F.size(words) - 2, F.lit(0)), F.lit(inner)))
    known = known.withColumn("run", F.array_join(F.slice(words, 2, F.col("k")), " "))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")  # ids may repeat
    found = []
    for k in sorted(r.k for r in known.select("k").distinct().collect()):  # at most ``inner`` + 1 rows
        if k == 0:
            found += [part.select("doc_id", "_h") for part in scanned(keyed, "text", known.filter("k = 0"), "sentence", part_bytes)]
        else:
            runs = keyed.select("doc_id", "_h", F.explode(F.array_distinct(ngrams(F.split("text", " "), k))).alias("run"))
            met = runs.join(known.filter(F.col("k") == k), "run").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), "sentence")
            found.append(keyed.join(met, keyed["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k"))).filter(F.col("text").contains(F.col("sentence"))).select("doc_id", "_h"))
    if not found:
        return docs.select("doc_id", F.lit(False).alias("found"))
    hits = reduce(DataFrame.unionByName, found).distinct().select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), F.lit(True).alias("found"))
    short = keyed.drop("text")
    return short.join(hits, short["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")), "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"))


def phrase_flags(docs: DataFrame, text: str, phrases: DataFrame, column: str, name: str = "found", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows with whether their text holds any phrase of a table of any length, null for a null text. One scan a part of the phrases."""
    from postloom.functions.text import in_blocks

    rows = docs.withColumn(name, F.when(F.col(text).isNotNull(), F.lit(False)))
    for part in parts_of(phrases, column, part_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            import pyarrow as pa

            machine = automaton(sent.value)
            for batch in batches:
                k, f = batch.schema.get_field_index(text), batch.schema.get_field_index(name)
                for some in in_blocks(batch, k):
                    flags = [None if t is None else bool(old) or next(machine.iter(t), None) is not None for t, old in zip(some.column(k).to_pylist(), some.column(f).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(flags, pa.bool_()) if i == f else c for i, c in enumerate(some.columns)], names=some.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows
