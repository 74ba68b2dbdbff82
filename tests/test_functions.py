from pyspark.sql import functions as F

from postloom.functions import scalar, text


def one(spark, expression, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1).alias("x")])
    return df.select(expression.alias("r")).first().r


def test_truncated_null_is_not_truncated(spark):
    rows = spark.createDataFrame([("a", "b", True), ("a", "b", False), ("a", "b", None)], "t string, f string, c boolean")
    assert [r[0] for r in rows.select(text.coalesce_text(F.col("t"), F.col("f"), F.col("c"))).collect()] == ["b", "a", "a"]


def test_patterns_are_not_escaped_by_default():
    assert text.alternation(["b?", "A"]) == "(a)|(b?)"
    assert text.alternation(["b?"], escape=True) == r"(b\?)"


def test_unaccent(spark):
    assert one(spark, text.unaccent(F.col("t")), t="Ñandú été đ") == "Nandu ete đ".replace("đ", "d")
    assert one(spark, text.unaccent_latin(F.col("t")), t="ação") == "acao"


def test_cleaning(spark):
    assert one(spark, text.mask_mentions_urls(F.col("t")), t="@a see http://x.y/z now") == "@mention see <url> now"
    assert one(spark, text.keep_alnum(F.col("t")), t=" #a-b@c! ") == "a b@c"
    assert one(spark, text.drop_backslash(F.col("t")), t="a\\b") == "a b"


def test_skipgrams(spark):
    tokens = F.split(F.lit("a b c d"), " ")
    assert one(spark, text.skipgrams(tokens, 2, 1)) == [["a", "b"], ["a", "c"], ["b", "c"], ["b", "d"], ["c", "d"]]
    assert len(one(spark, text.skipgrams(tokens, 3))) == 4
    assert one(spark, text.skipgrams(F.slice(tokens, 1, 1), 2)) == []


def test_nearest_index_takes_the_first_on_ties(spark):
    assert one(spark, scalar.nearest_index(F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0)), F.lit(1.0))) == 0


def test_rate_and_cosine_of_nothing_are_null(spark):
    assert one(spark, scalar.activity_rate(F.lit(3), F.lit(0))) is None
    assert one(spark, scalar.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_roots():
    assert abs(scalar.bisect_root(lambda x: x - 0.3, 0, 1) - 0.3) < 1e-9
    assert scalar.sigmoid_root(2, -1) == 0.5


def test_unaccent_over_all_of_unicode(spark):
    """A letter that Unicode names after a plain one "with" a mark becomes the plain one, if it decomposes or is Latin."""
    import sys
    import unicodedata

    named = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        whole = unicodedata.name(c, "")
        if " WITH " in whole and unicodedata.category(c)[0] == "L":
            try:
                named[c] = unicodedata.lookup(whole[: whole.index(" WITH ")])
            except KeyError:
                pass
    want = {c: b for c, b in named.items() if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.combining(unicodedata.normalize("NFD", c)[-1]) >= 200}
    want |= {c: b for c, b in named.items() if "a" <= b <= "z" and ord(c) < 0x10000 and unicodedata.category(c) == "Ll"}
    found = {r.c: r.u for r in spark.createDataFrame([(c,) for c in want], "c string").select("c", text.unaccent(F.col("c")).alias("u")).collect()}
    wrong = {c: (found[c], b) for c, b in want.items() if found[c] != b}
    assert len(want) > 900 and set(wrong) <= {"ۀ"}
    others = [c for c in map(chr, range(sys.maxunicode + 1)) if c not in named and unicodedata.category(c)[0] in "LNPSZ" and unicodedata.category(c) != "Cs"]
    kept = spark.createDataFrame([("".join(others[i : i + 5000]),) for i in range(0, len(others), 5000)], "c string").filter(text.unaccent(F.col("c")) != F.col("c")).collect()
    assert not kept


def test_ngram_gap_is_one_pattern_in_one_pass(spark):
    """Texts aren't cut into runs, runs of any length need no stack, and the order counts within a run only."""
    texts = ["of the to", "of, the to", "x of: of a the.\nto", "to the of", "the oftheto", "the " * 300_000, "the " * 300_000 + "and", "the, " * 100_000 + "and", "thand", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    two, three = text.ngram_gap(F.col("t"), ["the", "and"]), text.ngram_gap(F.col("t"), ["of", "the", "to"])
    got = [tuple(r) for r in df.orderBy("k").select(two, three).collect()]
    assert got == [(False, True), (False, False), (False, True), (False, False), (False, True), (False, False), (True, False), (False, False), (False, False), (False, False), (None, None)]
    assert "split" not in str(two) and text.run_pattern(["the", "and"]) == r"(?:^|[^.\w\s])(?:(?!the)[.\w\s])*+the(?:(?!and)[.\w\s])*+and"
