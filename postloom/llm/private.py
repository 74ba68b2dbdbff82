"""Personal data by candidates and boosted trees: e-mail and network addresses, payment cards, telephone numbers.

Two kinds of spans are found. Base spans are matches of fixed patterns and always stay. Beside them, generators of high recall
propose further, overlapping spans: addresses with spelled-out marks, and every run of digit groups that might be a number. Trees
over their format and context give each a score, isotonic regression on held-out examples makes it a probability, and a
threshold for each kind, at which examples show few false ones, selects what is redacted too. Trees, calibration and thresholds come
from sums over all examples.

There are no labels for such data, so the corpus's own base spans are the positive examples, as they are and rewritten in the ways
people write them; the same spans with a defect (a false check digit, a part too many, letters beside), made-up counts, dates
and versions, and the corpus's other candidates are the negative ones; a candidate that would be a base span if it stood alone is neither.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.base import checkpoint, lean, shared, text_chunks
from postloom.llm.quality import Trees, binned, walk

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
#: Trees: bins of a feature, trees, their depth, the learning rate, and the fewest examples in a leaf.
BINS, TREES, DEPTH, RATE, LEAST = 32, 60, 4, 0.2, 5
#: Parts of a unit that derivatives are rounded to, so that their sums over any partitioning are exact and the same.
UNIT = float(1 << 24)
#: Examples of a block, about; blocks' scores are written anew after so many trees; tasks of a pass, at most.
BLOCK, RENEWED, TASKS = 1 << 16, 10, 64
#: Characters beside a span that features see.
BESIDE = 32
#: Share of right ones among the examples over a threshold, and the most false ones among the other candidates.
PRECISION, FALSE_RATE = 0.98, 0.002

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")


def digits_of(span: str) -> str:
    return "".join(re.findall("[0-9]+", span))


def luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (double + sum(map(int, digits[::-2]))) % 10 == 0


def octets(span: str) -> bool:
    """Whether no number in it is over 255."""
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in re.findall("[0-9]+", span))


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outward, so long words cost nothing."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start, low = low + len(text[low:at].rstrip(LOCAL)), at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, low := m.end()))
        at = text.find("@", low)
    return found


def base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end in code points) of the fixed patterns' matches that pass their checks, by start and kind."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _RUN.search(text):
        return found
    for m in _DOTTED.finditer(text):
        runs = [r.span() for r in _RUN.finditer(text, *m.span())] if m[0].count(".") > 2 else []
        found += [("ip", a, b) for (a, _), (_, b) in zip(runs[::4], runs[3::4], strict=False) if octets(text[a:b])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_MARK = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s@\s?|@\s|\s(?:at|AT)\s(?=[A-Za-z0-9-]{1,63}(?:\s(?:dot|DOT)\s|\s?[\[({<]))|@")
_LOOSE = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]{1,63}){1,6}")
_SIGNS = ("@", "at]", "AT]", "at)", "AT)", "at}", "AT}", "at>", "AT>", " dot ", " DOT ")
_PARTS = re.compile(r"[0-9]++(?:(?:\s?\.\s?|[\[({]\s?(?:\.|dot)\s?[\])}]|\sdot\s)[0-9]++)*+")
_CHAIN = re.compile(r"[0-9]++(?:[ ().\-/_]{1,3}+[0-9]++)*+")


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data, overlapping ones too; their number follows the text's length."""
    if any(s in text for s in _SIGNS):
        for m in _MARK.finditer(text):
            before = text[max(0, m.start() - 64) : m.start()]
            own = len(before) - len(before.rstrip(LOCAL))
            if own and (d := _LOOSE.match(text, m.end())):
                yield "email", m.start() - own, d.end()
    if not _RUN.search(text):
        return
    for m in _PARTS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        runs = [r.span() for r in _RUN.finditer(text, *m.span())]
        for four in zip(runs, runs[1:], runs[2:], runs[3:], strict=False):
            if all(b - a <= 3 for a, b in four):
                yield "ip", four[0][0], four[3][1]
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        runs = [r.span() for r in _RUN.finditer(text, *m.span())]
        for i, (start, _) in enumerate(runs):
            n = 0
            for k in range(i, min(i + 6, len(runs))):
                end = runs[k][1]
                n += end - runs[k][0]
                if n > 19:
                    break
                if n >= 13 and k < i + 5 and end - start <= 29:
                    yield "card", start, end
                if 7 <= n <= 15 and (k > i or n >= 10):
                    yield "phone", _opened(text, start, end), end


def _opened(text: str, start: int, end: int) -> int:
    """The start of a number with its bracket and plus."""
    if start and text[start - 1] == "(" and ")" in text[start:end]:
        start -= 1
    return start - 1 if start and text[start - 1] == "+" else start


#: Words before a span that tell its kind.
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile")}


def _beside(c: str) -> int:
    """A character's class: none, white space, letter, digit, full stop, other sentence mark, other."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c == "." else 5 if c in ",;:!?'\")(" else 6


def features(left: str, span: str, right: str) -> list[float]:
    """Format of the span and what stands beside it; numbers of four digits and more are rounded to three, so that few values differ."""
    groups = _RUN.findall(span)
    digits, sizes = "".join(groups), [len(g) for g in groups] or [0]
    seps = _RUN.split(span)[1:-1]
    letters = sum(c.isalpha() for c in span)
    head, _, tail = span.partition("@")
    label = re.split(r"[^A-Za-z0-9]+", span)[-1]
    close, before = left.lower()[-24:], left[-16:]
    found = [
        len(span), len(digits), len(groups), sizes[0], sizes[-1], min(sizes), max(sizes), len(set(seps)), len(set(sizes)),
        sum(map(len, seps)), span.count(" "), span.count("."), span.count("-"), span.count("(") + span.count("["), span.count("/") + span.count("_"),
        span[:1] == "+", span[:1] == "(", digits[:2] == "00", bool(digits) and luhn(digits), max((int(g[:18]) for g in groups), default=0), octets(span),
        any(len(g) > 1 and g[0] == "0" for g in groups), int(digits[:1] or 0), int(digits[:2] or 0), len(set(digits)), letters, "@" in span, len(head) if tail else 0,
        len(label), label.isalpha(), len(re.findall(r"\bdot\b|\bDOT\b|\.", span)), len(re.findall(r"\bat\b|\bAT\b|@", span)),
        _beside(left[-1:]), _beside(right[:1]), _beside(left[-2:-1]), _beside(right[1:2]), sum(c.isdigit() for c in before), sum(c.isdigit() for c in right[:16]),
        *(any(w in close for w in CUES[k]) for k in KINDS),
    ]
    return [float(v if v < 1000 else f"{v:.2e}") for v in found]


# ---- examples ----


def _again(span: str, rng: random.Random) -> str:
    """The span with other digits."""
    return re.sub("[0-9]", lambda m: str(rng.randrange(10)), span)


def _checked(digits: str) -> str:
    """The digits with the last one such that they pass the check."""
    return next(digits[:-1] + c for c in "0123456789" if luhn(digits[:-1] + c))


def rewritten(kind: str, span: str, rng: random.Random) -> list[str]:
    """The same data in other ways that people write it."""
    if kind == "email":
        name, host = span.rsplit("@", 1)
        spelled = lambda at, dot: f"{name}{at}{host.replace('.', dot)}"
        return [spelled(" (at) ", "."), spelled("[at]", "."), spelled("[at]", "[dot]"), spelled(" at ", " dot "), spelled(" (at) ", " (dot) "), f"{name} @ {host}"]
    if kind == "ip":
        parts = ".".join(str(rng.randrange(256)) for _ in range(4))
        return [parts.replace(".", s) for s in ("[.]", "(.)", " . ", "[dot]", " dot ")] + [parts[::-1].replace(".", "].[", 1)[::-1].replace("].[", "[.]")]
    digits = digits_of(_again(span, rng))
    if kind == "card":
        digits = _checked("45"[rng.randrange(2)] + digits[1:])
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [s.join(fours) for s in (".", "/", "_", "  ", " - ")]
    own = digits[-10:].rjust(10, "5")
    area, first, rest = own[:3], own[3:6], own[6:]
    return [f"({area}) {first}-{rest}", f"{area}-{first}-{rest}", f"{area}.{first}.{rest}", f"1-{area}-{first}-{rest}", f"001 {area} {first} {rest}", f"+1/{area}/{first}/{rest}", f"1 ({area}) {first}-{rest}"]


def run_on(kind: str, span: str, rng: random.Random) -> list[tuple[str, str, str]]:
    """(further left, span, further right): numbers that a fixed pattern would take together."""
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    if kind == "card":
        return [(f"+1 ({number(3)}) {number(3)}-{number(4)} ", span, ""), (f"{number(16)} ", span, ""), ("", span, f" {number(16)}"), ("", span, f" {number(4)}")]
    if kind == "phone":
        return [("", span, f" {number(16)}"), ("", span, f" {number(4)} {number(4)}"), ("", span, f" {number(3)}.{number(2)}.{number(1)}.{number(3)}")]
    return []


def defective(kind: str, span: str, rng: random.Random) -> list[tuple[str, str, str]]:
    """(further left, span, further right) that aren't such data."""
    r = rng.randrange
    if kind == "email":
        name, host = span.rsplit("@", 1)
        return [("", f"{name} @ {host.split('.')[0]}.{r(10)}", ""), ("", f"{name} at {host.split('.')[0]}[{r(9)}]", ""), ("", f"{name}(at){host.split('.')[0]}.{r(10**3)}", "")]
    if kind == "ip":
        part = [str(r(256)) for _ in range(4)]
        over = [*part[:3], str(256 + r(700))]
        rng.shuffle(over)
        return [("", s.join(over), "") for s in (".", " . ", "[.]", " dot ")] + [(f"{r(99)}{s}", s.join(part), "") for s in (" . ", ". ", ".")] + [("", s.join(part), f"{s}{r(99)}") for s in (" . ", ". ", ".")]
    if kind == "card":
        digits = digits_of(_again(span, rng))
        false = digits[:-1] + str((int(_checked(digits)[-1]) + 1 + r(9)) % 10)
        fours = [false[i : i + 4] for i in range(0, len(false), 4)]
        right = _checked(digits)
        return [("", s.join(fours), "") for s in ("", " ", ".", "/", "_", "-")] + [("abcdef"[r(6)], right, ""), ("", right, "abcdef"[r(6)]), ("", ".".join(right[i : i + 3] for i in range(0, len(right), 3)), ""), (f"{r(10**4)}.", ".".join(right[i : i + 4] for i in range(0, len(right), 4)), "")]
    year = 1970 + r(80)
    date, clock = f"{1 + r(12):02}-{1 + r(28):02}", f"{r(24):02}.{r(60):02}.{r(60):02}"
    run = "".join(str(r(10)) for _ in range(10 + r(6)))
    groups = " ".join(str(r(10 ** (1 + r(5)))) for _ in range(5))
    return [("", run, ""), ("abcdef"[r(6)], run[:10], ""), ("", f"{year}-{date} {clock}", ""), ("", f"{year}/{date.replace('-', '/')}", f" {clock}"), ("", f"{r(999)}.{r(1000):03}.{r(1000):03}.{r(1000):03}", ""), ("", groups, f" {r(99)}"), (f"{r(99)}-", f"{100 + r(900)}-{100 + r(900)}-{1000 + r(9000)}", f"-{r(99)}"), (f"{r(99)} ", f"{r(10**4)} {r(10**3)} {r(10**4)}", f" {r(10**3)}")]


def examples(rows: list[tuple[str, bool, str, str, str]], kind: str, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and origin (0 base, 1 rewritten, 2 defective, 3 another candidate) of one kind."""
    x, y, origin = [], [], []
    for own, is_base, left, span, right in rows:
        if own != kind:
            continue
        rng = random.Random(f"{seed}{left}\x00{span}\x00{right}")
        if not is_base and base(span) == [(kind, 0, len(span))]:
            continue  # alone it would be a base span, so it isn't known to be none
        made = [(left, span, right, 0 if is_base else 3)]
        if is_base:
            made += [(left + a, s, b + right, 1) for a, s, b in run_on(kind, span, rng)[rng.randrange(4) :][:1]]
            made += [(left, s, right, 1) for s in rng.sample(rewritten(kind, span, rng), 3)]
            made += [(left + a, s, b + right, 2) for a, s, b in rng.sample(defective(kind, span, rng), 3)]
        for a, s, b, from_ in made:
            x.append(features(a[-BESIDE:], s, b[:BESIDE]))
            y.append(from_ < 2)
            origin.append(from_)
    return np.array(x, float).reshape(len(y), len(x[0]) if x else 0), np.array(y, float), np.array(origin, int)


@dataclass
class Detector:
    """For each kind: trees, the calibration's steps (score, probability), the threshold on the probability, and the number of examples."""

    trees: dict[str, Trees] = field(default_factory=dict)
    steps: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)
    examples: dict[str, int] = field(default_factory=dict)

    def probability(self, kind: str, x: np.ndarray) -> np.ndarray:
        at, value = self.steps[kind]
        return value[np.maximum(np.searchsorted(at, score_steps(walk(self.trees[kind], x)), "right") - 1, 0)]


def score_steps(p: np.ndarray) -> np.ndarray:
    """Scores as whole numbers, 64 steps to a unit of log odds: of any number of examples at most 2,065 differ."""
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return np.rint(64 * np.log(p / (1 - p)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores at which the probability steps up, and the probabilities: neighbours are pooled until they rise."""
    weight = np.ones(len(y)) if weight is None else weight
    at, first = np.unique(score, return_inverse=True)
    total, hits = np.bincount(first, weight), np.bincount(first, y * weight)
    pools: list[list[float]] = []  # score, hits, total
    for a, h, n in zip(at, hits, total, strict=True):
        pools.append([a, h, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, h2, n2 = pools.pop()
            pools[-1][1] += h2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def cut(p: np.ndarray, y: np.ndarray, other: np.ndarray, weight: np.ndarray, precision: float = PRECISION, false_rate: float = FALSE_RATE) -> float:
    """The least probability from which on examples are right often enough; infinite if there is none."""
    for t in np.unique(p):
        chosen = np.where(p >= t, weight, 0)
        if t > 0.5 and (y * chosen).sum() >= precision * (chosen.sum() + 1) and (other * chosen).sum() <= false_rate * max((other * weight).sum(), 1):
            return float(t)
    return float("inf")


# ---- trees from all examples ----


def quantiles(value: np.ndarray, n: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Inner quantiles of values with counts, interpolated as ``numpy.quantile`` does."""
    order = np.argsort(value)
    value, upto = value[order], np.cumsum(n[order])
    at = np.arange(1, bins) / bins * (upto[-1] - 1)
    low, high = (value[np.searchsorted(upto, r, "right")] for r in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def _held(left: str, span: str, right: str) -> bool:
    """Whether an example is one of the third that calibrates."""
    return zlib.crc32(f"{left}{span}{right}".encode("utf-8", "surrogatepass")) % 3 == 0


def _made(batch: pa.RecordBatch) -> Iterator[tuple[str, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """kind, whether held out, features, labels and origins of the examples of a batch of rows (kind, base, left, span, right)."""
    rows = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
    held = [_held(*r[2:]) for r in rows]
    for kind in KINDS:
        for apart in (False, True):
            x, y, origin = examples([r for r, h in zip(rows, held, strict=True) if h == apart], kind)
            if len(y):
                yield kind, apart, x, y, origin


@lean
def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each value of each feature is among the examples that aren't held out; labels of all are feature -1 (-2: held out)."""
    seen: dict[tuple[str, int, float], int] = {}
    for batch in batches:
        for kind, apart, x, y, _ in _made(batch):
            for k, column in [(-2 if apart else -1, y)] + ([] if apart else list(enumerate(x.T))):
                for v, n in zip(*(a.tolist() for a in np.unique(column, return_counts=True)), strict=True):
                    seen[kind, k, v] = seen.get((kind, k, v), 0) + n
    if seen:
        kind, k, v = zip(*seen, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(k, pa.int32()), pa.array(v, pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["kind", "feature", "value", "n"])


_BLOCK = "kind string, held boolean, codes binary, y binary, origin binary, z binary"


def _blocks(model: dict[str, Trees]):
    """Examples as bins of their features, in blocks of one kind."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[tuple[np.ndarray, ...]]] = {}

        def block(key: tuple[str, bool]) -> pa.RecordBatch:
            codes, y, origin = (np.concatenate(a) for a in zip(*held.pop(key), strict=True))
            z = np.full(len(y), model[key[0]].bias)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), *(pa.array([a.tobytes()], pa.binary()) for a in (codes, y, origin, z))], names=["kind", "held", "codes", "y", "origin", "z"])

        for batch in batches:
            for kind, apart, x, y, origin in _made(batch):
                if kind in model:
                    held.setdefault((kind, apart), []).append((binned(x, model[kind].edges).astype(np.uint8), y.astype(np.uint8), origin.astype(np.uint8)))
                    if sum(len(a[1]) for a in held[kind, apart]) >= BLOCK:
                        yield block((kind, apart))
        for key in list(held):
            yield block(key)

    return run


def _down(model: Trees, t: int, codes: np.ndarray, levels: int) -> np.ndarray:
    """The node, counted within its level, that each row comes to in a tree after so many levels."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for level in range(levels):
        own = 2**level - 1 + node
        node = 2 * node + (codes[rows, model.feature[t, own]] > model.bound[t, own])
    return node


def _scored(model: Trees, codes: np.ndarray, z: bytes, first: int, end: int) -> np.ndarray:
    """Log odds after the trees up to ``end``, from those after the trees up to ``first``."""
    z = np.frombuffer(z).copy()
    for t in range(first, end):
        z += model.value[t, _down(model, t, codes, DEPTH)]
    return z


def _read(batches: Iterator[pa.RecordBatch], held: bool, model: dict[str, Trees]) -> Iterator[tuple[str, np.ndarray, dict]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}
            if row["held"] == held:
                yield row["kind"], np.frombuffer(row["codes"], np.uint8).reshape(-1, len(model[row["kind"]].edges)), row


def _sums(model: dict[str, Trees], first: int, t: int, level: int):
    """Sums of both derivatives and counts of a task's examples by node, feature and bin at one level of the ``t``-th tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for kind, codes, row in _read(batches, False, model):
            m, width = codes.shape[1], 2**level
            p = 1 / (1 + np.exp(-_scored(model[kind], codes, row["z"], first, t)))
            y = np.frombuffer(row["y"], np.uint8)
            cell = _down(model[kind], t, codes, level) * BINS
            weights = [np.rint(v * UNIT) for v in (y - p, p * (1 - p))] + [None]
            part = np.array([[np.bincount(cell + codes[:, k], w, width * BINS).reshape(width, BINS) for k in range(m)] for w in weights]).transpose(0, 2, 1, 3)
            total[kind] = total[kind] + part if kind in total else part
        for kind, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part.tobytes()], pa.binary())], names=["kind", "sums"])

    return run


def _renewed(model: dict[str, Trees], first: int, end: int):
    """The blocks with the scores after the trees up to ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [_scored(model[r["kind"]], codes, r["z"], first, end).tobytes() for k in range(batch.num_rows) for held in (False, True) for _, codes, r in _read(iter([batch.slice(k, 1)]), held, model)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], names=batch.schema.names)

    return run


def _split(model: Trees, t: int, level: int, sums: np.ndarray) -> None:
    """Sets the best split of each node of a level, and behind the last one the leaves' values; as ``quality.grow``."""
    width, bins = 2**level, sums.shape[-1]
    total = sums / np.array([UNIT, UNIT, 1]).reshape(3, 1, 1, 1)
    (gl, hl, cl), (ga, ha, ca) = np.cumsum(total, 3), total.sum(3, keepdims=True)
    gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
    gain[(cl < LEAST) | (ca - cl < LEAST)] = 0
    gain = gain.reshape(width, -1)
    rows, best = np.arange(width), gain.argmax(1)
    good = gain[rows, best] > 1e-6
    at = slice(width - 1, 2 * width - 1)
    feature = model.feature[t, at] = np.where(good, best // bins, 0)
    model.bound[t, at] = np.where(good, best % bins, bins)
    if level == DEPTH - 1:
        split = np.where(good, best % bins, bins - 1)  # without a split all go to the first leaf
        g, h = gl[rows, feature, split], hl[rows, feature, split]
        ga, ha = ga[rows, feature, 0], ha[rows, feature, 0]
        model.value[t] = RATE * (np.stack([g, ga - g], 1) / (np.stack([h, ha - h], 1) + 1)).ravel()


def _calibration(model: dict[str, Trees], first: int):
    """How many held-out examples of each origin have each score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, codes, row in _read(batches, True, model):
            step = score_steps(1 / (1 + np.exp(-_scored(model[kind], codes, row["z"], first, TREES))))
            found, n = np.unique(np.stack([step, np.frombuffer(row["origin"], np.uint8)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n)), pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(n, pa.int64())], names=["kind", "step", "origin", "n"])

    return run


def train(rows: DataFrame) -> Detector:
    """A detector from all rows (kind, whether base, left, span, right); a kind without base spans has none. A third calibrates.

    Bins, trees, calibration and thresholds come from sums over all examples, which stay with the tasks: of each level of each tree
    the driver gets the sums by node, feature and bin of at most TASKS tasks. All kinds' trees are grown in the same passes.
    """
    found = Detector()
    rows = rows.select("kind", "base", "left", "span", "right")
    counts: dict[tuple[str, int], tuple[list[float], list[int]]] = {}
    for r in rows.mapInArrow(_values, "kind string, feature int, value double, n long").groupBy("kind", "feature", "value").agg(F.sum("n").alias("n")).collect():  # values of three digits
        values, n = counts.setdefault((r.kind, r.feature), ([], []))
        values.append(r.value)
        n.append(r.n)
    size = 0
    for kind in KINDS:
        labels = [dict(zip(*counts.get((kind, k), ((), ())), strict=True)) for k in (-1, -2)]
        found.examples[kind] = sum(sum(x.values()) for x in labels)
        if not all(x.get(1.0) for x in labels):
            continue
        size += found.examples[kind]
        share = float(np.clip(labels[0][1.0] / sum(labels[0].values()), 1e-4, 1 - 1e-4))
        edges = np.array([quantiles(*map(np.array, counts[kind, k])) for k in range(sum(a == kind and b >= 0 for a, b in counts))])
        found.trees[kind] = Trees(edges, np.zeros((TREES, 2**DEPTH - 1), np.int64), np.full((TREES, 2**DEPTH - 1), BINS, np.int64), np.zeros((TREES, 2**DEPTH)), float(np.log(share / (1 - share))))
    model = found.trees
    if not model:
        return found
    blocks, first = checkpoint(rows.mapInArrow(_blocks(model), _BLOCK)).coalesce(min(-(-size // (2 * BLOCK)), TASKS)), 0
    for t in range(TREES):
        if t - first == RENEWED:
            blocks, first = checkpoint(blocks.mapInArrow(_renewed(model, first, t), _BLOCK)), t
        for level in range(DEPTH):
            total: dict[str, np.ndarray] = {}
            for kind, part in blocks.mapInArrow(_sums(model, first, t, level), "kind string, sums binary").collect():
                total[kind] = total.get(kind, 0) + np.frombuffer(part).reshape(3, 2**level, -1, BINS)
            for kind, sums in total.items():
                _split(model[kind], t, level, sums)
    steps = blocks.mapInArrow(_calibration(model, first), "kind string, step double, origin int, n long").groupBy("kind", "step", "origin").agg(F.sum("n").alias("n")).collect()  # 2,065 steps, four origins
    for kind in model:
        step, origin, n = (np.array(a) for a in zip(*(r[1:] for r in steps if r.kind == kind), strict=True))
        y = (origin < 2).astype(float)
        at, value = found.steps[kind] = isotonic(step, y, n)
        found.threshold[kind] = cut(value[np.searchsorted(at, step, "right") - 1], y, origin == 3, n)
    return found


# ---- over texts ----


def apart(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return all(end <= a or start >= b for a, b in spans)


class _Covered:
    """Spans met in order of start, asked whether another one overlaps any."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts = np.array([s for _, s, _ in spans], np.int64)
        self.ends = np.maximum.accumulate(np.array([e for *_, e in spans], np.int64)) if spans else self.starts

    def free(self, start: int, end: int) -> bool:
        k = int(np.searchsorted(self.starts, end, "left"))  # spans that begin before its end
        return k == 0 or int(self.ends[k - 1]) <= start


def others(text: str, own: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans that overlap no base span, once each."""
    covered = _Covered(own)
    return [s for s in dict.fromkeys(proposed(text)) if covered.free(s[1], s[2])]


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BESIDE) : start], text[start:end], text[end : end + BESIDE]


def select(text: str, own: list[tuple[str, int, int]], model: Detector) -> list[tuple[str, int, int]]:
    """Further spans at or over their kind's threshold: the likeliest first, then the longest; none overlap."""
    by_kind: dict[str, list[tuple[int, int]]] = {}
    for kind, start, end in others(text, own):
        if model.threshold.get(kind, np.inf) <= 1:
            by_kind.setdefault(kind, []).append((start, end))
    likely = []
    for kind, spans in by_kind.items():
        p = model.probability(kind, np.array([features(*around(text, *s)) for s in spans], float))
        likely += [(-q, s - e, s, e, kind) for q, (s, e) in zip(p.tolist(), spans, strict=True) if q >= model.threshold[kind]]
    taken: set[int] = set()
    chosen = []
    for _, _, start, end, kind in sorted(likely):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            chosen.append((kind, start, end))
    return chosen


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _texts(array: pa.Array) -> Iterator[tuple[int, str]]:
    """Row and whole text, null as empty, decoded some at a time."""
    for i, j, *_ in text_chunks(array):
        for k, text in enumerate(array.slice(i, j - i).to_pylist(), i):
            yield k, text or ""


def spans_of(text: str, model: Detector) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether base) by start, then kind."""
    own = base(text)
    found = [(*s, True) for s in own] + [(*s, False) for s in select(text, own, model)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _mapped(model, column: int, result: Callable[[str, list], object], kind: pa.DataType, name: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [result(text, spans_of(text, model.value)) for _, text in _texts(batch.column(column))]
            columns = [pa.array(made, kind) if k == column else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=[name if k == column else n for k, n in enumerate(batch.schema.names)])

    return run


@lean
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and other candidates of all texts with what is beside them, and a digest; equal ones of a batch once."""
    for batch in batches:
        found: dict[tuple[str, bool, str, str, str], int] = {}
        for _, text in _texts(batch.column(0)):
            own = base(text)
            for is_base, spans in ((True, own), (False, others(text, own))):
                for kind, start, end in spans:
                    parts = around(text, start, end)
                    digest = hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    found[(kind, is_base, *parts)] = int.from_bytes(digest, "little", signed=True)
        if found:
            kind, is_base, left, span, right = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(is_base), pa.array(list(found.values()), pa.int64()), pa.array(left), pa.array(span), pa.array(right)], names=["kind", "base", "h", "left", "span", "right"])


def learn(docs: DataFrame, *, text: str = "text", per_class: int | None = None) -> Detector:
    """A detector from all base spans and all other candidates of all texts.

    With ``per_class``, from so many of each kind at most, those of the least digests. Equal spans with equal surroundings, as in
    copies of a text, count once.
    """
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_candidates, "kind string, base boolean, h long, left string, span string, right string")
    rows = checkpoint(rows.repartition(TASKS, "h").dropDuplicates(["kind", "base", "h", "left", "span", "right"]))  # few rows, but much work for each
    if per_class is not None:
        rows = reduce(DataFrame.unionByName, [rows.filter((F.col("kind") == k) & (F.col("base") == b)).orderBy("h", "left", "span", "right").limit(per_class) for k in KINDS for b in (True, False)])
    return train(rows)


def find(docs: DataFrame, model: Detector, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (kind, start and end in code points, whether base) of every whole text.

    Spans stand by start, then kind, then end. Null and empty texts have none. Repeated rows stay, a null key stays null, other
    columns are left out, and no rows give none. Base spans of different kinds may overlap; further ones overlap nothing. A
    text of any length is worked on whole, in time that follows its length, and one batch's texts are in memory.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("spans"))
    return rows.mapInArrow(_mapped(shared(docs.sparkSession, model), 1, lambda _, spans: [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans], _SPAN, "spans"), f"{key} long, spans {SPANS}")


def hidden(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with ``[KIND]`` in place of each span; spans that overlap are one, of the first one's kind."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Detector, *, text: str = "text") -> DataFrame:
    """The rows with personal data replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; other columns stay, null texts become empty."""
    columns = docs.columns
    rows = docs.withColumn(text, F.col(text).cast("string"))
    return rows.mapInArrow(_mapped(shared(docs.sparkSession, model), columns.index(text), hidden, pa.string(), text), rows.schema)


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the number of base spans of each kind, the digest of all base spans, all spans as text, and how many the trees added."""
    own = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(own, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select(key, *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(own)).cast("long").alias("n_added"))
