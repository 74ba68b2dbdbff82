"""Repair of conversation structure: the cheapest edits that give roles the form ``(s?(ua)+)?``.

``repair`` finds each turn's fault, hash-partitions the turns by conversation and sorts them. Every task hands them to DuckDB in batches of ``BATCH`` turns. There a recursive query advances one turn of every conversation at each
recursion and keeps, for each state of the grammar, the least cost and the ASCII-least audit of that cost. A conversation
that a batch's end cuts goes on from its states in the next batch. Audits of one cost in one state are never one the beginning of the
other (an insertion more costs more), so the least of them stays least whatever follows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.base import lean

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns that one recursive query takes.
BATCH = 8192
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
LAST = (START, ASSISTANT)
#: Moves on a role's initial.
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FAULTS = ("blank", "duplicate", "truncated")
LONG = (-(1 << 63), (1 << 63) - 1)
COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after no insertion or more; a third would only come back to a state."""
    found, at = [(state, 0, "")], [(state, 0, "")]
    for _ in range(2):
        at = [(GRAMMAR[s, r], cost + INSERT, audit + "I") for s, cost, audit in at for r in "ua" if (s, r) in GRAMMAR]
        found += [x for x in at if x[0] not in {f[0] for f in found}]
    return found


def moves() -> list[tuple[int, str | None, bool, int, int, str]]:
    """(state, initial that is needed or None, whether the turn stays, state after it and insertions behind it, cost, audit)."""
    found = []
    for state in range(4):
        steps = [(None, False, state, DELETE, "D")]
        steps += [(r, True, to, 0, "K") for (s, r), to in GRAMMAR.items() if s == state]
        steps += [(None, True, to, REROLE, "R") for (s, r), to in GRAMMAR.items() if s == state and r in "ua"]
        found += [(state, need, stays, to, cost + more, edit + audit) for need, stays, via, cost, edit in steps for to, more, audit in inserted(via)]
    return found


RECURSION = f"""
WITH RECURSIVE path(conv, state, pos, best) USING KEY (conv, state) AS (
  SELECT conv, state, CAST(0 AS BIGINT), {{'cost': cost, 'audit': audit, 'begun': state0}} FROM seeds
  UNION
  SELECT p.conv, m.upto, any_value(t.pos), min({{'cost': p.best.cost + m.cost + CASE WHEN m.stays AND t.fault = 3 THEN {TRUNCATED} ELSE 0 END, 'audit': p.best.audit || m.audit, 'begun': p.best.begun}})
  FROM path p JOIN turns t ON t.conv = p.conv AND t.pos = p.pos + 1 JOIN moves m ON m.state = p.state
  WHERE (m.need IS NULL OR m.need = t.initial) AND NOT (m.stays AND t.fault IN (1, 2))
  GROUP BY p.conv, m.upto
)
SELECT p.conv, p.state, p.best.cost AS cost, p.best.audit AS audit, p.best.begun AS begun
FROM path p JOIN (SELECT conv, max(pos) AS pos FROM path GROUP BY conv) l ON l.conv = p.conv AND l.pos = p.pos
ORDER BY p.conv, p.state
"""


def connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.execute("CREATE TABLE moves(state INTEGER, need VARCHAR, stays BOOLEAN, upto INTEGER, cost BIGINT, audit VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    return con


class Path:
    """The best edits that end in one state: cost, audit, and the digest of what they give so far."""

    __slots__ = ("audit", "cost", "digest", "out", "state")

    def __init__(self, state: int = START, cost: int = 0, audit: str = "", digest=None, out: int = 0):
        self.state, self.cost, self.audit, self.digest, self.out = state, cost, audit, digest or hashlib.sha256(), out

    def then(self, state: int, cost: int, edits: str, turns: Iterator[tuple[str, str]]) -> Path:
        """Go on by ``edits`` over ``turns``."""
        new = Path(state, cost, self.audit + edits, self.digest.copy(), self.out)
        at = self.state
        for edit in edits:
            role, text = next(turns) if edit != "I" else ("", "")
            if edit == "D":
                continue
            if edit == "K":
                initial = role[:1]
            else:
                initial = "a" if at == USER else "u"
                role = "assistant" if initial == "a" else "user"
            at = GRAMMAR[at, initial]
            new.digest.update(f"{chr(10) if new.out else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            new.out += 1
        return new


class Conversation:
    """What is known of a conversation whose turns have come so far."""

    def __init__(self, key: tuple[bool, int]):
        self.key = key
        self.paths = [Path().then(state, cost, audit, iter(())) for state, cost, audit in inserted(START)]
        self.counts = np.zeros(5, np.int64)  # faults by FAULTS, illegal pairs, distinct turns
        self.least = self.most = None
        self.turns = 0

    def row(self) -> tuple:
        best = min((p for p in self.paths if p.state in LAST), key=lambda p: (p.cost, p.audit))
        gaps = 0 if self.least is None else self.most - self.least + 1 - int(self.counts[4])
        return (None if self.key[0] else self.key[1], min(gaps, LONG[1]), *self.counts[:4].tolist(), best.cost, best.audit, best.digest.hexdigest())


def advance(con, batch: pa.Table, found: list[Conversation], heads: np.ndarray) -> None:
    """Move the conversations on by the batch's turns; ``heads``: where each one's turns begin, in order of ``found``."""
    sizes = np.diff(np.append(heads, batch.num_rows))
    conv = np.repeat(np.arange(len(found)), sizes)
    turns = pa.table({"conv": conv, "pos": np.arange(batch.num_rows) - np.repeat(heads, sizes) + 1, "initial": batch["initial"], "fault": batch["fault"]})
    base = [min(p.cost for p in c.paths) for c in found]
    # a shared beginning of the audits changes no comparison
    begun = [len(_shared([p.audit for p in c.paths])) for c in found]
    seeds = [(i, p.state, p.cost - base[i], p.audit[begun[i] :], p.state) for i, c in enumerate(found) for p in c.paths]
    table = pa.table({k: pa.array(v, t) for (k, t), v in zip((("conv", pa.int64()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("state0", pa.int32())), zip(*seeds, strict=True), strict=True)})
    con.register("turns", turns)
    con.register("seeds", table)
    rows = con.execute(RECURSION).fetchall()
    con.unregister("turns")
    con.unregister("seeds")
    role, text = batch["role"].to_pylist(), batch["text"].to_pylist()
    ended: list[list[Path]] = [[] for _ in found]
    ends = {i: min((r[2], r[3]) for r in group if r[1] in LAST) for i, group in itertools.groupby(rows, lambda r: r[0])}
    for i, state, cost, audit, start in rows:
        if i < len(found) - 1 and (state not in LAST or (cost, audit) != ends[i]):  # only the last conversation may have more turns
            continue
        before = next(p for p in found[i].paths if p.state == start)
        edits = audit[len(before.audit) - begun[i] :]
        ended[i].append(before.then(state, cost + base[i], edits, zip(role[heads[i] : heads[i] + sizes[i]], text[heads[i] : heads[i] + sizes[i]], strict=True)))
    fault, illegal, fresh, turn = (np.asarray(batch[k].fill_null(0)) for k in ("fault", "illegal", "fresh", "turn"))
    known = np.asarray(batch["turn"].is_valid())
    for i, c in enumerate(found):
        own = slice(heads[i], heads[i] + sizes[i])
        c.paths = ended[i]
        c.counts += [*((fault[own] == k).sum() for k in (1, 2, 3)), illegal[own].sum(), fresh[own].sum()]
        if known[own].any():
            some = turn[own][known[own]]
            c.least = int(some.min()) if c.least is None else min(c.least, int(some.min()))
            c.most = int(some.max()) if c.most is None else max(c.most, int(some.max()))
        c.turns += int(sizes[i])


def _shared(audits: list[str]) -> str:
    low, high = min(audits), max(audits)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    return low[:n]


def _work(most: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, open_ = connect(), None
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                none, conv = np.asarray(batch["none"].cast(pa.int8())), np.asarray(batch["conv"])
                new = np.ones(len(conv), bool)
                new[1:] = (conv[1:] != conv[:-1]) | (none[1:] != none[:-1])
                heads = np.flatnonzero(new)
                found = [Conversation((bool(none[h]), int(conv[h]))) for h in heads]
                done = []
                if open_ is not None and open_.key == found[0].key:
                    found[0] = open_
                elif open_ is not None:
                    done.append(open_)
                left = np.asarray(batch["left"].cast(pa.int8())) > 0  # a dropped turn only says that there is such a conversation
                if left.any():
                    table = pa.Table.from_batches([batch.filter(pa.array(left))])
                    owner = (np.cumsum(new) - 1)[left]
                    some = np.flatnonzero(np.diff(owner, prepend=-1))
                    advance(con, table, [found[i] for i in owner[some]], some)
                open_ = found.pop()
                done += found
                if done:
                    yield _rows(done)
        if open_ is not None:
            yield _rows([open_])

    return run


def _rows(done: list[Conversation]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*(c.row() for c in done), strict=True), kinds, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])


def _plain(turns: DataFrame, *more: Column) -> DataFrame:
    """conv_id and turn as longs, role and text (null: one space), and ``more``."""
    texts = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts, *more)


def damage(turns: DataFrame) -> DataFrame:
    """The turns with faults by crc32(``conv_id:turn``) % 20, and ``left``: false for a turn that is dropped.

    0 drops it, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's. In the digest a null is one space too.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _plain(turns).withColumn("k", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("left"), F.when(F.col("k") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("_t", F.explode(F.sequence(F.lit(1), "times"))).drop("_t", "times")


def _solid(text: Column) -> Column:
    """The last character that isn't ASCII white space, or an empty text."""
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))


def repair(turns: DataFrame, *, batch: int = BATCH) -> DataFrame:
    """conv_id, counts of gaps and faults, cost, audit and the digest of the repaired ``role:text`` lines, for each conversation.

    Rows of a conversation are taken by turn (nulls first), then role and text, so the result doesn't depend on their order;
    repeated rows are turns like others. Null roles and texts are one space. A null conv_id is a conversation of its own. Where
    there is a column ``left``, rows in which it is false are no turns, but their conversation has its row, of zeros. Other columns
    are left out; no rows give none. Texts are whole, one batch's at a time.

    A turn's first fault counts: blank, duplicate (role and text seen earlier), truncated (its last character other than white space is
    not ``.``, ``!`` or ``?``). A turn may be kept, given the role user or assistant, or deleted, which blank and duplicate ones must be;
    an empty user or assistant turn may be inserted anywhere. Of edits of one cost the ASCII-least audit is taken.

    A conversation is one task's: its digest needs its turns in order. They are streamed; the audit alone is held whole.
    """
    left = F.coalesce(F.col("left"), F.lit(False)) if "left" in turns.columns else F.lit(True)
    rows = _plain(turns, left.alias("left")).select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", "role", "text", "left")
    key = ["none", "conv", "left"]
    by_turn = [F.col("turn").asc_nulls_first(), "role", "text"]
    same, inside = Window.partitionBy(*key, "role", "text").orderBy(F.col("turn").asc_nulls_first()), Window.partitionBy(*key).orderBy(*by_turn, "nth")
    last = _solid(F.col("text"))
    rows = rows.repartition("none", "conv").withColumn("nth", F.row_number().over(same)).withColumn("initial", F.substring("role", 1, 1))
    fault = F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    before = F.lag("initial").over(inside)
    illegal = before.isNotNull() & ~F.concat(before, F.col("initial")).isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(inside))
    rows = rows.select("none", "conv", "left", "turn", "role", "text", "nth", "initial", fault.alias("fault"), illegal.cast("int").alias("illegal"), fresh.cast("int").alias("fresh"))
    return rows.sortWithinPartitions("none", "conv", "left", *by_turn, "nth").mapInArrow(_work(batch), COLUMNS)
