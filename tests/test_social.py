import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from postloom.functions import social


def tokens(spark, text, **more):
    return spark.createDataFrame([(text,)], "t string").select(social.tokens_social(F.col("t"), **more).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("I can't, they're :-) It's 1,5 a@b.cd @me http://x.y <3 don’t :(", "i can not , they are <happy> it is <number> <email> <user> <url> <heart> do not <sad>"),
        ("raise 5% or 5.5 percent, $1,200.50 or 20 dollars; €5k", "raise <percent> or <percent> , <money> or <money> ; <money>"),
        ("call +1 (743) 555-3824 or 743-555-3824", "call <phone> or <phone>"),
        ("at 10:30 am or 5pm on 2021-03-04, 3/4/21, Jan 5th, 2020 and 5 May 2021", "at <time> or <time> on <date> , <date> , <date> and <date>"),
        ("SO goooood *very* f**k !!! ?!? a. b..", "<allcaps> so </allcaps> good <elongated> very <emphasis> f**k <censored> ! <repeated> ? <repeated> a . b . <repeated>"),
        ("#NewJob &amp; &lt;3 24be 3.5 I x_1", "<hashtag> newjob </hashtag> & <heart> 24be <number> i x_1"),
        ("Été ÉTÉ l’été", "été <allcaps> été </allcaps> l'été"),
        ("", ""),
        (" \n\t", ""),
    ],
)
def test_marks(spark, text, expected):
    assert tokens(spark, text) == expected.split()


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(social.tokens_social(F.col("t")).alias("x")).first().x is None


def brute(cutter, letters):
    """All cuts; of equal costs the longest last word, then the longest before it."""
    def cost(words):
        return sum(cutter.costs.get(w, cutter.base + len(w) * social.UNIT) for w in words)

    best = None
    for gaps in itertools.product([0, 1], repeat=len(letters) - 1):
        at = [0, *(i + 1 for i, g in enumerate(gaps) if g), len(letters)]
        words = [letters[a:b] for a, b in itertools.pairwise(at)]
        key = (cost(words), at[-2::-1])
        if best is None or key < best[0]:
            best = (key, words)
    return best[1]


def test_cuts_equal_all_cuts():
    rng = random.Random(0)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 500) for _ in range(30)}
    cutter = social.TagCutter(words, sum(words.values()) + 1000)
    for _ in range(200):
        letters = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        assert cutter.cut(letters) == brute(cutter, letters), letters


def test_words_of_tags():
    cutter = social.TagCutter({"new": 100, "job": 100, "in": 300, "paris": 20}, 1000)
    assert cutter.words("#newjobinparis") == ["new", "job", "in", "paris"]
    assert cutter.words("#NewJob2020_InPARIS") == ["new", "job", "2020", "in", "paris"]
    assert cutter.words("#xyzzy") == ["xyzzy"]
    assert cutter.words("#___") == []
    assert cutter.words("#" + "z" * 5000) == ["z" * 5000]
    assert social.TagCutter({}, 0).words("#abc") == ["abc"]


def test_rows_with_tags(spark):
    docs = spark.createDataFrame([(1, "new job in new york new job"), (2, None), (3, ""), (4, "#newjob here #NewJob #newjob")], "id int, text string")
    counts, total = social.word_counts(docs, "text", 3)
    assert counts == {"new": 3, "job": 2, "newjob": 3} and total == 11
    cutter = social.TagCutter({"new": 3, "job": 2}, total)
    got = {r.id: r.tokens for r in social.social_rows(docs, "text", cutter).collect()}
    assert got[2] is None and got[3] == []
    assert got[4] == "<hashtag> new job </hashtag> here <hashtag> new job </hashtag> <hashtag> new job </hashtag>".split()
    assert math.isclose(cutter.costs["new"], 1e6 * math.log10(11 / 3), rel_tol=1e-5)
