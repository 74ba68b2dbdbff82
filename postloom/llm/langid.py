"""Language by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A document is parsed, from left to right, into the longest
pieces that occur in a language's text (a character that the text hasn't ends its phrase and belongs to it); the language
that needs the fewest phrases, normalised by what a phrase's place in its text costs, is the prediction. All letters of the
labelled texts are told apart. The automata's transitions share one double array (a transition's cell is the sum of its
state and its character), and numpy parses blocks of many documents in step, for all languages at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import labelled
from postloom.llm.base import characters, crc_mod, lean, shared, text_chunks, with_empty_text

UNKNOWN = "und"
#: Characters of a language's automaton, documents that they may come from, and characters of one document.
TRAINING_CHARS, TRAINING_DOCS, PART_CHARS = 24_000, 32, 3_000
#: Characters of a block: parsing starts anew at each block's beginning, for every language alike.
BLOCK = 256
PAD, BLANK, OTHER = 0, 1, 2


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        now = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(move)
                move.append(move[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return move


def double_array(moves: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each state, and two arrays by the sum of a state's number and a code: whose cell it is and where it leads."""
    used, taken = bytearray(alphabet + 64), bytearray(alphabet + 64)
    number, many, one = [0] * len(moves), 1, 1
    for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        codes = list(moves[s])
        at = many if len(codes) > 1 else one
        while True:
            if at + alphabet >= len(used):
                used, taken = used + bytearray(len(used)), taken + bytearray(len(taken))
            if not taken[at] and not any(used[at + c] for c in codes):
                break
            at += 1
        if len(codes) > 1:
            many = max(many, at - 32)  # cells further back are left to states of one transition
        else:
            one = at
        number[s] = at
        taken[at] = 1
        for c in codes:
            used[at + c] = 1
    numbers = np.array(number, np.int32)
    size = int(numbers.max(initial=0)) + alphabet + 1
    owner, target = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for s, move in enumerate(moves):
        for c, t in move.items():
            owner[number[s] + c], target[number[s] + c] = number[s], number[t]
    return numbers, owner, target


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # of each code point
    owner: np.ndarray  # of a cell of the double array: the state whose transition it is
    target: np.ndarray  # and the state where it leads
    roots: np.ndarray  # start of each language
    enter: np.ndarray  # state of each language after each code from its start
    cost: np.ndarray  # bits for a phrase of each language


def fit(texts: dict[str, str]) -> Model:
    languages = sorted(texts)
    letters = sorted({c.lower()[0] for text in texts.values() for c in set(text) if c.isalpha()})
    names = {c: 3 + i for i, c in enumerate(letters)}
    code = np.full(0x110000, BLANK, np.int32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            code[p] = names.get(c.lower()[0], OTHER)
    moves: list[dict[int, int]] = []
    first, cost = [], []
    for language in languages:
        text, states = texts[language], len(moves)
        own = suffix_automaton(code[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)])
        moves += [{c: states + t for c, t in move.items()} for move in own]
        first.append(states)
        cost.append(np.log2(len(text) + 2))
    numbers, owner, target = double_array(moves, 3 + len(letters))
    roots = numbers[first]
    enter = np.repeat(roots[:, None], 3 + len(letters), 1)
    for k, s in enumerate(first):
        for c, t in moves[s].items():
            enter[k, c] = numbers[t]
    return Model(languages, code, owner, target, roots, enter, np.array(cost))


def phrases(model: Model, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Phrases of each block (a row of codes, of which the first ``size`` count) for each language."""
    order = np.argsort(-size, kind="stable")
    columns = np.ascontiguousarray(codes[order].T)
    running = np.searchsorted(-size[order], -np.arange(codes.shape[1]), "left")  # blocks of more than so many codes
    n = len(codes)
    state = np.repeat(model.roots[:, None], n, 1)
    count = np.zeros((len(model.languages), n), np.int32)
    for column, m in zip(columns, running.tolist(), strict=True):
        if not m:
            break
        now, here = state[:, :m], column[:m]
        cell = now + here
        following = model.target[cell]
        language, block = np.nonzero(model.owner[cell] != now)
        if len(block):
            count[language, block] += 1
            following[language, block] = model.enter[language, here[block]]
        state[:, :m] = following
    count += state != model.roots[:, None]
    out = np.empty_like(count)
    out[:, order] = count
    return out


def predict(model: Model, array: pa.Array) -> tuple[list[str], np.ndarray]:
    found, scores = [], np.zeros(len(array))
    for i, j, data, off in text_chunks(array):
        points, at = characters(data, off, fold=False)
        codes = model.code[np.minimum(points, 0x10FFFF)]
        size = np.diff(at)
        if not model.languages or not len(codes):
            found += [UNKNOWN] * (j - i)
            continue
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(j - i), blocks)
        start = np.repeat(at[:-1], blocks) + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        place = start[:, None] + np.arange(BLOCK)
        cells = np.where(place < np.repeat(at[1:], blocks)[:, None], codes[np.minimum(place, len(codes) - 1)], PAD)
        count = phrases(model, cells, np.minimum(np.repeat(at[1:], blocks) - start, BLOCK))
        bits = np.stack([np.bincount(owner, c, j - i) for c in count]) * model.cost[:, None] / np.maximum(size, 1)
        letters = np.bincount(np.repeat(np.arange(j - i), size)[codes >= OTHER], minlength=j - i) > 0
        best = bits.argmin(0)
        least = np.sort(bits, 0)
        found += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        scores[i:j] = np.where(letters, 1 - least[0] / np.maximum(least[1], 1e-9) if len(least) > 1 else 1.0, 0.0)
    return found, np.clip(scores, 0, 1)


def learn(docs: DataFrame, *, chars: int = TRAINING_CHARS, per_language: int = TRAINING_DOCS, part_chars: int = PART_CHARS) -> Model:
    """Automata of at most ``chars`` characters a language, from at most ``per_language`` documents, the smallest by a hash of the id.

    A document gives at most ``part_chars`` characters, a longer one those at a place drawn by the hash, so each language
    that has a document can be learned. Held-out documents and those without id, lang or a letter aren't learned from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod("doc_id", labelled.FOLDS) != labelled.HELD_OUT))
    chosen = labelled.least_by_hash(rows.select("doc_id", "lang"), "lang", per_language)
    parts = rows.withColumn("text", labelled.part("text", part_chars))
    found = parts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"), F.min(F.xxhash64("doc_id")).alias("h")).collect()  # per_language rows a language
    texts: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h, r.doc_id)):
        texts[r.lang] = (texts[r.lang] + "\n" + r.text if r.lang in texts else r.text)[:chars]
    return fit(texts)


def _predict(model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            found, scores = predict(model.value, batch.column(k))
            others = [(batch.schema.names[i], batch.column(i)) for i in range(batch.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([*(c for _, c in others), pa.array(found, pa.string()), pa.array(scores)], names=[*(x for x, _ in others), "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (how much fewer bits than the next language needs, 0 to 1) of every document.

    Whole texts are parsed, long ones in blocks. Null, empty and letterless texts are ``und`` with score 0, and so is
    everything if no document can be learned from. Ties go to the first language by name. Rows that repeat stay; a null
    id stays null and isn't held out; other columns are left out, whatever their names; an empty table gives no rows.
    """
    model = shared(docs.sparkSession, learn(docs))
    rows = with_empty_text(docs, F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out().alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep_certain(model, least: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = predict(model.value, batch.column("text"))
            yield batch.filter(pa.array((np.array(found, object) != UNKNOWN) & (scores >= least)))

    return run


def keep_certain(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose whole text has a language, by a margin of ``least`` or more over the next one, unchanged."""
    return docs.mapInArrow(_keep_certain(shared(docs.sparkSession, model), least), docs.schema)
