import hashlib
import random

from pyspark.sql import functions as F

from postloom.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nx", "a\\b\\\\", "<", "<|", "\\<|end|>", "[INST]", "<<SYS>>", "|>", "é😀\n\n", "", None, "$1 \\1", "x" * 5000, "<end_of_turn>", "<eos><pad>", "<\\|end|>\n" * 900, "é😀<" * 700]
COLUMNS = "conv_id long, turn long, role string, text string, formatted string, run int"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, *_ in rows if c == conv))
        lines = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(1)
    rows = []
    for conv in range(12):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", f"rules {rng.choice(NASTY)}", "", 1))
        rows += [(conv, t, "user" if t % 2 else "assistant", rng.choice(NASTY), "", 1) for t in range(1, rng.randrange(2, 40))]
    rows += [(None, 1, "user", "no id", "", 1), (50, None, "user", "null turn", "", 1), (50, 1, None, "null role", "", 1)]
    rows += [(60, 1, "assistant", "same", "", 1)] * 3
    rows += [(70, t, "assistant" if t % 2 else "user", f"turn {t}", "", 1) for t in range(3000)]
    return rows


def test_round_trip(spark):
    rows = conversations()
    got = {r[0]: tuple(r)[1:5] for r in chat.digests(chat.format_windows(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert got == brute(rows)


def test_windows_keep_to_the_budget(spark):
    rows = [r for r in conversations() if r[0] is not None]
    rows += [(80, 0, "system", "s" * 2000, "", 1), (80, 1, "user", "hello", "", 1), (80, 2, "assistant", "é" * 3000, "", 1)]
    windows = chat.read_back(chat.format_windows(spark.createDataFrame(rows, COLUMNS), budget=200, history_tokens=60, history_turns=2)).collect()
    own = 0
    for w in windows:
        own += w.n_turns
        assert w.n_tokens <= 200
        assert w.n_context <= 3
        assert w.formatted.count(chat.END) + w.formatted.count(chat.MORE) == w.n_context + len(w.turns)
        assert [t.text for t in w.turns if t.role == "assistant"] == list(w.loss_texts)
        assert all(t.ends for t in w.turns) or len(w.turns) == 1
    assert own == len(rows)
    systems = {r[0] for r in rows if r[2] == "system"}
    for w in windows:
        if w.conv_id in systems:  # cut to half the budget where it is longer, but always there
            assert w.formatted.startswith("<|system|>\n")
    assert max(w.piece for w in windows) > 0


def test_turn_numbers_do_not_cut_windows(spark):
    """Consecutive, millisecond, repeated and null turn numbers give the same windows."""
    base = [(f"turn {t:04}", "user" if t % 2 else "assistant") for t in range(1200)]
    numbers = {1: lambda t: t, 2: lambda t: 1_700_000_000_000 + 60_000 * t, 3: lambda t: 5, 4: lambda t: None, 5: lambda t: -(1 << 62) + t}
    rows = [(c, f(t), "user" if c in (3, 4) else role, text) for c, f in numbers.items() for t, (text, role) in enumerate(base)]
    got = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=100_000).collect()
    assert len(got) == 5 and all(w.n_turns == 1200 for w in got)
    found = {}
    for w in chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        found.setdefault(w.conv_id, []).append((w.span, w.n_turns))
    assert sorted(found[1]) == sorted(found[2]) == sorted(found[5]) and sorted(found[3]) == sorted(found[4])
    assert sum(n for _, n in found[3]) == 1200


def test_a_conversation_of_many_turns(spark):
    turns = spark.range(100_000).selectExpr("9L AS conv_id", "id * 1000 AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "CAST(id AS STRING) AS text", "'x' AS span", "1 AS none")
    r = chat.digests(chat.format_windows(turns)).first()
    assert (r.n_turns, r.loss_chars) == (100_000, sum(len(str(i)) for i in range(1, 100_000, 2)))
    assert r.turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\n{i}\n" for i in range(100_000)).encode()).hexdigest()


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("\\<>[]|/sIe\n$1a") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.t == r.u and not any(x in r.e for x in ("<|", "|>", "[INST]", "[/INST]", "</s>", "<s>", "<e", "</", "<I"))


def test_no_rows(spark):
    assert chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def estimate(role, text):
    return -(-(len(role.encode()) + len(text.encode())) // 4) + 4


def pieces_of(role, text, limit, measured=64):
    """Parts of a few characters, joined while they fit."""
    empty, out, load = estimate(role, ""), [""], 0
    for i in range(0, len(text), measured):
        more = estimate(role, text[i : i + measured]) - empty
        if load + more > limit - empty and load:
            out, load = [*out, ""], 0
        out[-1] += text[i : i + measured]
        load += more
    return out


def windows_of(turns, budget, history_tokens, history_turns):
    """(context texts, own texts, tokens) of each window of one conversation's turns (role, text), by plain loops."""
    size = [estimate(*t) for t in turns]
    led = turns[0][0] == "system"
    shown = pieces_of(*turns[0], budget // 2)[0] if led and size[0] > budget // 2 else turns[0][1] if led else None
    room = budget - (min(size[0], budget // 2) if led else 0)
    out, at = [], 0
    while at < len(turns):
        limit = budget if at == 0 else room
        context = [shown] if led and at else []
        if size[at] > limit:
            for cut in pieces_of(*turns[at], limit):
                out.append((context, [cut]))
            at += 1
            continue
        history = 0
        for k in range(1, history_turns + 1):
            if at and at - k >= int(led) and sum(size[at - k : at]) <= min(history_tokens, limit - size[at]):
                history = k
        end, load = at, sum(size[at - history : at])
        while end < len(turns) and load + size[end] <= limit:
            load += size[end]
            end += 1
        out.append((context + [t for _, t in turns[at - history : at]], [t for _, t in turns[at:end]]))
        at = end
    return out


def test_windows_equal_plain_loops(spark):
    rng = random.Random(8)
    data, want = [], {}
    for conv in range(60):
        turns = [("system", "s" * rng.choice([5, 300, 700, 1500]))] if conv % 2 else []
        turns += [(rng.choice(["user", "assistant"]), f"{t} " + rng.choice(["x", "é", "😀"]) * rng.choice([1, 20, 100, 300, 500, 1500])) for t in range(rng.randrange(1, 25))]
        data += [(conv, t, *x) for t, x in enumerate(turns)]
        want[conv] = windows_of(turns, 200, 60, 2)
    got = {}
    windows = chat.read_back(chat.format_windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), budget=200, history_tokens=60, history_turns=2))
    for w in windows.orderBy("conv_id", "span", "piece").collect():
        parts = [chat_text for chat_text in w.formatted.split("<|end|>\n")]
        context = [p.split("|>\n", 1)[1] for p in parts[: w.n_context]]
        got.setdefault(w.conv_id, []).append((context, [t.text for t in w.turns]))
        assert w.n_tokens <= 200
    assert got == want


def test_a_turn_that_fits_is_one_window(spark):
    text = "x" * (4 * (894 - 4) - 4)
    rows = [(1, 0, "user", text), (2, 0, "system", "s" * 2400), (2, 1, "user", "hi"), *((2, t, "user" if t % 2 else "assistant", "y" * 1500) for t in range(2, 9))]
    got = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "span").collect()
    assert [(w.n_turns, w.n_tokens) for w in got if w.conv_id == 1] == [(1, 894)]
    later = [w for w in got if w.conv_id == 2][1:]
    assert later and all(w.formatted.startswith("<|system|>\nsssss") and w.n_tokens <= 1024 for w in later)
