"""Toxicity, quality and language: accuracy on held-out text, edge rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postloom.llm import labelled, langid, quality, toxicity

PARTS = {"aa": "the of and ing tion er re".split(), "bb": "le de ion que ment eau ai".split(), "cc": "der sch ung keit ein ver ge".split()}
BAD = ["dreadful", "vilest", "stinker"]


def text_in(language, rng, n=60):
    return " ".join("".join(rng.choices(PARTS[language], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        language = rng.choice(list(PARTS))
        words = text_in(language, rng).split()
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        words = words if good else [w.upper() + "!!" for w in words[:8] * 6]
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        docs.append((i, text, language, "s", len(text)))
        labels.append((i, good, toxic))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(9000, None, None, None, None), (9001, "", "aa", "s", 0), (9002, "1234 -- !!", "aa", "s", 9), (None, "the of and", "aa", "s", 3), (9003, "theof " * 30_000, "aa", "s", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs + EDGE + EDGE[:1], DOCS).cache(), spark.createDataFrame([*labels, (9001, 1, 0), (9001, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").cache()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("operator", "column"), [(toxicity, 2), (quality, 1)])
def test_held_out_accuracy_and_edge_rows(operator, column, tables):
    docs, labels = tables
    truth = {r[0]: r[column] for r in corpus()[1]}
    got = operator.score(docs, labels).collect()
    assert len(got) == 400 + len(EDGE) + 1
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and held(r.doc_id))
        assert r.predicted == int(r.score >= (0.5 if operator is toxicity else 0.3))
    out = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 40 and np.mean(out) >= 0.97
    empty = {r.score for r in got if r.doc_id in (9000, 9001)}
    assert len(empty) == 1


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_no_labels_or_documents(operator, spark, tables):
    docs, labels = tables
    assert {r.score for r in operator.score(docs, labels.limit(0)).collect()} == {0.5}
    assert operator.score(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark, tables):
    docs, labels = tables
    changed = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    for operator in (toxicity, quality):
        first, second = ({(r.doc_id, round(r.score, 9)) for r in operator.score(docs, x).collect()} for x in (labels, changed))
        assert first == second


def test_sample_is_bounded_and_whole(tables):
    docs, labels = tables
    found = labelled.sample(docs, labels, "toxic", per_label=20)
    assert (found.groupby("y").size() == 20).all()
    assert set(found["text"]) <= {r[1] for r in corpus()[0]}


def test_trees_walk_as_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.grow(x, y, np.ones(500))
    assert ((quality.walk(model, x) > 0.5) == y).mean() > 0.97

    def slow(row):
        z = model.bias
        for f, b, v in zip(model.feature, model.bound, model.value, strict=True):
            node = 0
            while node < len(f):
                code = np.searchsorted(model.edges[f[node]], row[f[node]], "left")
                node = 2 * node + 1 + int(code > b[node])
            z += v[node - len(f)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(quality.walk(model, x[:40]), [slow(r) for r in x[:40]])


def naive_phrases(text, training):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in training:
            k += 1
        n, i = n + 1, i + k - 1
        if i < len(text) and text[i] not in training:  # belongs to the phrase that it ends
            i += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    texts = {k: text_in(k, rng, 80) for k in ("aa", "bb")}
    model = langid.fit(texts)
    for text in (text_in("aa", rng, 20), "zzz the ofx", texts["bb"][5:90], "a"):
        text = text[: langid.BLOCK]
        codes = np.full((1, langid.BLOCK), langid.PAD, np.int32)
        codes[0, : len(text)] = model.code[[ord(c) for c in text]]
        as_codes = lambda t: "".join(chr(65 + model.code[ord(c)]) for c in t)
        assert langid.phrases(model, codes, np.array([len(text)]))[:, 0].tolist() == [naive_phrases(as_codes(text), as_codes(texts[k])) for k in ("aa", "bb")]


def test_double_array_holds_all_transitions():
    rng = random.Random(1)
    moves = langid.suffix_automaton(np.array([3 + rng.randrange(k) for k in (2, 30, 500) for _ in range(700)], np.int32))
    numbers, owner, target = langid.double_array(moves, 503)
    assert len(set(numbers.tolist())) == len(moves)
    for s, move in enumerate(moves):
        for c in range(503):
            cell = numbers[s] + c
            assert (owner[cell] == numbers[s]) == (c in move)
            if c in move:
                assert target[cell] == numbers[move[c]]


SCRIPTS = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "".join(map(chr, range(0x430, 0x450))), "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 1500))), "ko": "".join(map(chr, range(0xAC00, 0xAC00 + 900))), "ja": "".join(map(chr, range(0x3041, 0x3097))) + "".join(map(chr, range(0x4E00, 0x4E00 + 300)))}


def test_many_scripts_together(spark):
    rng = random.Random(6)
    lexicon = {k: ["".join(rng.choices(v, k=rng.randint(1, 4))) for _ in range(300)] for k, v in SCRIPTS.items()}
    rows = [(i, " ".join(rng.choices(lexicon[k], k=rng.randint(20, 120))), k) for i, k in enumerate(k for k in SCRIPTS for _ in range(60))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    wrong = [(k, got[i].lang_pred) for i, _, k in rows if got[i].held_out and got[i].lang_pred != k]
    assert not wrong and all(r.score > 0.02 for r in got.values())


def test_languages_of_long_texts_only(spark):
    rng = random.Random(9)
    rows = [(i, text_in("aa" if i % 2 else "bb", rng, 9000 if i % 2 else 30), "aa" if i % 2 else "bb", 5) for i in range(60)]
    rows += [(7, rows[7][1], "aa", 5)] * 300  # a repeated row takes one place
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    assert all(len(t) > 20_000 for i, t, *_ in rows if i % 2)
    got = langid.identify(docs).collect()
    assert len(got) == 360 and all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in got)
    few = labelled.least_by_hash(docs.selectExpr("doc_id", "lang"), "lang", 4).collect()
    assert len(few) == 8 and len({tuple(r) for r in few}) == 8


def test_labelled_sample_takes_parts_of_long_texts(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, text_in("aa", rng, 9000), "x") for i in range(1, 20)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, toxic int")
    found = labelled.sample(docs, labels, "toxic", max_chars=500)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) > 10 and set(found.y) == {0, 1} and all(len(t) == 500 and any(t in x for x in texts.values()) for t in found.text)


def test_languages(tables):
    docs, _ = tables
    truth = {r[0]: r[2] for r in corpus()[0]}
    got = langid.identify(docs).collect()
    assert len(got) == 400 + len(EDGE) + 1
    out = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(out) >= 0.95
    for r in got:
        if r.doc_id in (9000, 9001, 9002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1 and (r.lang_pred in PARTS or r.lang_pred == "und")
    assert {r.lang_pred for r in got if r.doc_id == 9003} == {"aa"}


def test_languages_without_training(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 1)], DOCS)
    assert [tuple(r) for r in langid.identify(docs).collect()] == [(1, False, "und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0


def test_filters_keep_columns(spark, tables):
    docs, labels = tables
    model = langid.learn(docs)
    kept = langid.keep_certain(docs, model, 0.02)
    assert kept.columns == docs.columns and not {9000, 9001, 9002} & {r.doc_id for r in kept.select("doc_id").collect()}
    good = quality.keep_good(docs, quality.learn(docs, labels))
    assert good.columns == docs.columns and not {9000, 9001} & {r.doc_id for r in good.select("doc_id").collect()}


def test_score_of_a_batch_is_that_of_its_rows():
    docs, labels = corpus(80, 7)
    texts, y = [d[1] for d in docs], np.array([x[2] for x in labels])
    model = toxicity.fit(texts, y, 0.3, rounds=20)
    trees = quality.fit(texts, np.array([x[1] for x in labels]), 0.7)
    for score in (lambda t: toxicity.score_array(model, pa.array(t, pa.string())), lambda t: quality.score_array(trees, pa.array(t, pa.string()))):
        assert np.allclose(score(texts), np.concatenate([score([t]) for t in texts]))


def test_toxicity_scores_by_brute_force():
    """Each n-gram of a text that the model has counts once."""
    docs, labels = corpus(60, 3)
    texts = [d[1] for d in docs] + ["", "ab", "Éé x y z" * 3]
    model = toxicity.fit(texts[:60], np.array([x[2] for x in labels]), 0.3, rounds=10)

    def bucket(gram):
        code = 0
        for c in gram:
            code = (code * 0x100000001B3 + ord(c) + 1) % 2**64
        return ((code * 0x9E3779B97F4A7C15 + ((len(gram) - 1) << 50)) * 0xD6E8FEB86659FD93) % 2**64 >> 64 - toxicity.BITS

    def slow(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        grams = {low[i : i + k] for k in toxicity.ORDERS for i in range(len(low) - k + 1)}
        features = {int(model.index[bucket(g)]) for g in grams} - {-1}
        return 1 / (1 + np.exp(-(sum(float(model.weights[f]) for f in features) + model.bias)))

    assert np.allclose(toxicity.score_array(model, pa.array(texts, pa.string())), [slow(t) for t in texts], atol=1e-5)


def test_statistics_by_brute_force():
    rng = random.Random(5)
    texts = ["", "a", "One two. Two one!!\n1 2 3 | ##", *("".join(rng.choices("abcAB 12.!|#%\n", k=rng.randint(1, 400))) for _ in range(30))]
    data = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = quality.statistics(np.frombuffer(data, np.uint8), off)
    at = {name: k for k, name in enumerate(quality.NAMES)}
    for row, text in zip(found, texts, strict=True):
        size, words = len(text), text.split()
        assert np.isclose(row[at["log_chars"]], np.log1p(size)) and np.isclose(row[at["log_words"]], np.log1p(len(words)))
        for name, test in (("upper", str.isupper), ("digit", str.isdigit), ("lower", str.islower)):
            assert np.isclose(row[at[name]], sum(map(test, text)) / max(size, 1))
        assert np.isclose(row[at["distinct_words"]], len({w.lower() for w in words}) / max(len(words), 1))
