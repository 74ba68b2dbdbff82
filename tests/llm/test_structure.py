import hashlib
import itertools
import random
import re
import zlib

import pytest

from postloom.llm import queries, structure

COLUMNS = "conv_id long, turn long, role string, text string, cost string"
SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for c, t, r, x, *_ in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x, k != 0)] * (2 if k == 3 else 1)
    return out


def faults(turns):
    seen, found = set(), []
    for _, role, text in turns:
        last = text.rstrip(SPACE)[-1:]
        found.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    return found


def cheapest(turns, found):
    """Dynamic programme over (turns taken, lines made), with whole results."""
    n = len(turns)
    best = {(0, ""): (0, "", [])}
    for i in range(n + 1):
        for _ in range(4):  # insertions
            for (j, made), (cost, audit, lines) in list(best.items()):
                if j == i:
                    for role in ("user", "assistant"):
                        to = step(made, role[0])
                        if to is not None:
                            put(best, (i, to), (cost + 2, audit + "I", [*lines, f"{role}:"]))
        if i == n:
            break
        _, role, text = turns[i]
        for (j, made), (cost, audit, lines) in list(best.items()):
            if j != i:
                continue
            put(best, (i + 1, made), (cost + 3, audit + "D", lines))
            if found[i] in (1, 2):
                continue
            more = cost + (found[i] == 3)
            if (to := step(made, role[:1])) is not None:
                put(best, (i + 1, to), (more, audit + "K", [*lines, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if (to := step(made, other[0])) is not None:
                    put(best, (i + 1, to), (more + 2, audit + "R", [*lines, f"{other}:{text}"]))
    return min((v for (j, made), v in best.items() if j == n and made in ("", "a")), key=lambda v: v[:2])


def step(made, initial):
    """The last initial, if the form allows it behind ``made``."""
    return initial if (made, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None


def put(best, key, value):
    if key not in best or value[:2] < best[key][:2]:
        best[key] = value


def brute(rows, spoil=True):
    rows = damaged(rows) if spoil else [(c, t, " " if r is None else r, " " if x is None else x, True) for c, t, r, x, *_ in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r, x) for c, t, r, x, left in rows if c == conv and left), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        found = faults(turns)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest(turns, found)
        out[conv] = (gaps, *(found.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None, "User", "system2"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3, turn * 5 - 4]), role, rng.choice(["hi.", "well?", "no end", "", None, " \t\x0b", "é 😀!", " ", "x. \n", "hi."]), "clash"))
    rows += [(None, 1, "user", "no id.", ""), (None, None, None, None, ""), (7000, None, "user", "a.", ""), (7000, None, "assistant", "b.", "")]
    rows += [(7001, -(2**63), "user", "far.", ""), (7001, 2**63 - 1, "assistant", "away.", "")]
    return rows


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_equals_a_slow_programme(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, COLUMNS)
    expected = brute(rows)
    expected[7001] = (2**63 - 1, *expected[7001][1:]) if expected[7001][0] > 2**63 - 1 else expected[7001]
    assert result(structure.repair(structure.damage(df))) == expected
    assert result(structure.repair(df)) == {k: v if k != 7001 else (2**63 - 1, *v[1:]) for k, v in brute(rows, False).items()}


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_conversations_go_on_in_the_next_batch(spark, batch):
    rng = random.Random(batch)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}!", f"{t}?"]), "") for c in range(3) for t in range(40)]
    assert result(structure.repair(spark.createDataFrame(rows, COLUMNS).coalesce(1), batch=batch)) == brute(rows, False)


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}." + "x" * (t % 50 == 0), "") for t in range(3000)]
    got = result(structure.repair(spark.createDataFrame(rows, COLUMNS), batch=700))[1]
    assert got[3:7] == (60, 0, 60, "K" * 3000)
    assert got[7] == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x, _ in rows).encode()).hexdigest()


def test_nothing_left_and_no_rows(spark):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.", "")], COLUMNS)
    assert result(structure.repair(structure.damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert result(structure.repair(structure.damage(df.limit(0)))) == {}


def test_query_over_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_conversation_repair(spark, data)) == brute(rows)
