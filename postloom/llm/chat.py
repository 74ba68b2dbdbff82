"""Conversations as training windows, with DataFrame functions only.

A conversation's turns are ranked, prefix sums of their tokens choose spans of whole turns within a budget, and each span
becomes a window: the system turn, a limited history of what is left beside it, then the span's own turns. The loss mask covers the assistant's
texts among a window's own turns, so repeated ones are masked.

Template: ``<|role|>\\n`` text ``<|end|>\\n`` for each turn; a turn that no window can hold whole is cut into pieces, and each
but its last ends with ``<|more|>\\n``. In roles and texts a backslash is doubled, and one is put behind every ``<`` that
something but a backslash follows, behind ``[`` before a capital letter or a slash, and behind ``|`` before ``>`` or ``|``, so that no control
string of this template or of the usual ones, which begin with ``<`` or are like ``[INST]``, is left in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END, MORE = "<|end|>\n", "<|more|>\n"
#: Tokens of a window, of its repeated history, and turns of that history.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1024, 192, 2


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"(<(?=[^\\])|\[(?=[A-Z/])|\|(?=[|>]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_estimate(role: Column, text: Column) -> Column:
    """Tokens of a formatted turn, about: a token for four bytes, and the marks."""
    return F.ceil((F.octet_length(role) + F.octet_length(text)) / 4).cast("long") + F.lit(4)


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))


#: Characters of the parts in which a long turn is measured to be cut.
MEASURED = 64


def _cut(role: Column, text: Column, limit: Column, tokens, measured: int) -> Column:
    """The text in pieces (array) of at most ``limit`` tokens each, as long as ``measured`` characters have no more.

    Parts of ``measured`` characters are counted by what they add to an empty turn, and joined while their sum fits.
    """
    empty = tokens(role, F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{measured}}}"), F.lit(0))
    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"))

    def add(acc: Column, part: Column) -> Column:
        more = tokens(role, part) - empty
        over = (acc["sum"] + more > limit - empty) & (acc["sum"] > 0)
        return F.struct(
            F.when(over, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(over, more).otherwise(acc["sum"] + more).cast("long").alias("sum"),
            (acc["at"] + 1).alias("at"),
        )

    starts = F.aggregate(parts, first, add, lambda acc: acc["starts"])
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(parts)))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), ""))


def format_windows(turns: DataFrame, *, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, tokens=token_estimate, measured: int = MEASURED) -> DataFrame:
    """conv_id, span, piece, n_context, n_turns, n_tokens, formatted, loss_spans (start and length in code points).

    Rows are ordered by turn (null first), then role and text, whatever the turns' numbers are; null roles and texts are
    empty; a null conv_id is a conversation of its own; repeated rows are turns like others. The system turn is the first
    one, if its role is ``system``; every later window repeats it, cut to half the budget if it is longer. A span begins with as
    many of the last ``history_turns`` turns as fit ``history_tokens`` and leave room for its first turn, and goes on with whole turns
    while they fit. Only a turn that doesn't fit a window beside the system turn is cut; each of its pieces (numbered by ``piece``) has a
    window of its own, without history; ``n_turns`` counts turns that end in the window. No window is over the budget, as
    long as ``measured`` characters of text and a role fit half of it and ``tokens`` of two texts are at least those of both joined. Other columns are left
    out, whatever their names; no rows give none. A conversation's turns are sorted by one task, which spills; its numbers of
    tokens, but never its texts, are in one row. A long turn's text is in one row, and its pieces are.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    key = ["none", "conv"]  # a null conv_id can't be joined
    rows = turns.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ordered = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.repartition(*key).withColumn("tokens", tokens(F.col("role"), F.col("text"))).withColumn("rank", F.row_number().over(ordered))
    sums = rows.withColumn("upto", F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    system = F.max(F.when((F.col("rank") == 1) & (F.col("role") == "system"), F.least("tokens", F.lit(budget // 2))))
    convs = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "upto", "tokens"))).alias("sums"), system.alias("shown"))
    convs = convs.select(*key, "sums", F.col("shown").isNotNull().cast("int").alias("led"), (F.lit(budget) - F.coalesce("shown", F.lit(0))).cast("long").alias("room"))
    start = F.struct(F.array(F.struct(F.lit(1).alias("rank"), F.lit(0).alias("history"))).alias("starts"), F.lit(0).cast("long").alias("base"), F.lit(budget).cast("long").alias("room"))

    def step(acc: Column, t: Column) -> Column:
        before = t["upto"] - t["tokens"]
        limit = F.least(F.lit(history_tokens).cast("long"), F.col("room") - t["tokens"])
        upto = lambda k: F.coalesce(F.get("sums", t["rank"] - 2 - k)["upto"], F.lit(0).cast("long"))  # noqa: E731  of the turn k before the last
        history = F.lit(0)
        for k in range(1, history_turns + 1):  # a longer one takes the place of a shorter one
            history = F.when((t["rank"] - k > F.col("led")) & (before - upto(k) <= limit), k).otherwise(history)
        taken = F.when(history > 0, before - F.coalesce(F.get("sums", t["rank"] - 2 - history)["upto"], F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
        opened = F.struct(F.concat(acc["starts"], F.array(F.struct(t["rank"].alias("rank"), history.alias("history")))).alias("starts"), before.alias("base"), (F.col("room") - taken).alias("room"))
        return F.when((t["upto"] - acc["base"] > acc["room"]) & (t["rank"] > 1), opened).otherwise(acc)

    convs = convs.select(*key, "room", F.size("sums").alias("n"), F.aggregate("sums", start, step, lambda acc: acc["starts"]).alias("starts"))
    ranks = F.transform("starts", lambda s: s["rank"])
    lengths = F.zip_with(F.concat(F.slice(ranks, 2, F.size(ranks)), F.array(F.col("n") + 1)), ranks, lambda b, a: b - a)
    convs = convs.select(*key, "room", F.transform("starts", lambda s: s["history"]).alias("histories"), F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n))).alias("spans"))
    placed = rows.join(convs, key).withColumn("span", F.element_at("spans", F.col("rank"))).select(*key, "room", "span", F.get("histories", F.col("span")).alias("history"), F.struct("rank", "role", "text", "tokens").alias("t"))
    spans = placed.groupBy(*key, "span").agg(F.first("room").alias("room"), F.first("history").alias("history"), F.array_sort(F.collect_list("t")).alias("own"))
    by_span = Window.partitionBy(*key).orderBy("span")
    tail = F.slice("own", F.greatest(F.size("own") - history_turns + 1, F.lit(1)), max(history_turns, 1))
    nothing = F.slice("own", 1, 0)
    before = F.flatten(F.array(*(F.coalesce(F.lag(tail, k).over(by_span), nothing) for k in range(max(history_turns, 1), 0, -1))))
    first = F.col("own")[0]
    led = (first["rank"] == 1) & (first["role"] == "system")
    spans = spans.select(*key, "span", "room", "history", "own", before.alias("before"), F.first(F.when(led, first)).over(by_span).alias("system"))
    recent = F.slice("before", F.greatest(F.size("before") - F.col("history") + 1, F.lit(1)), F.col("history"))
    limit = F.when(first["rank"] == 1, F.lit(budget)).otherwise(F.col("room"))
    long = (F.size("own") == 1) & (first["tokens"] > limit)
    whole = lambda t, end: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), end.alias("end"))
    some = lambda t, text, end: F.struct(t["role"].alias("role"), text.alias("text"), tokens(t["role"], text).alias("tokens"), end.alias("end"))
    led_by = F.col("system")
    short = F.when(led_by["tokens"] <= budget // 2, whole(led_by, F.lit(END))).otherwise(some(led_by, _cut(led_by["role"], led_by["text"], F.lit(budget // 2), tokens, measured)[0], F.lit(END)))
    spans = spans.withColumns({"recent": recent, "pieces": F.when(long, _cut(first["role"], first["text"], limit, tokens, measured)), "short": F.when(led_by.isNotNull() & (first["rank"] > 1), F.array(short))})
    spans = spans.select("*", F.posexplode(F.coalesce("pieces", F.array(F.lit("")))).alias("piece", "cut"))
    part = some(first, F.col("cut"), F.when(F.col("piece") + 1 < F.size("pieces"), F.lit(MORE)).otherwise(F.lit(END)))
    own = F.when(F.col("pieces").isNotNull(), F.array(part)).otherwise(F.transform("own", lambda t: whole(t, F.lit(END))))
    none_shown = F.slice(F.transform("own", lambda t: whole(t, F.lit(END))), 1, 0)
    context = F.concat(F.coalesce("short", none_shown), F.transform("recent", lambda t: whole(t, F.lit(END))))
    spans = spans.select(*key, "span", "piece", own.alias("own"), context.alias("context"))
    shown = lambda t: F.concat(_head(t["role"]), escape(t["text"]), t["end"])
    spans = spans.withColumns({"opening": F.array_join(F.transform("context", shown), ""), "marked": F.transform("own", lambda t: F.struct(t["role"].alias("role"), F.length(_head(t["role"])).alias("head"), F.length(escape(t["text"])).alias("body"), F.length(t["end"]).alias("end")))})
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))), 1, 0)
    masks = F.aggregate(
        "marked",
        F.struct(F.length("opening").alias("at"), none.alias("spans")),
        lambda acc, t: F.struct((acc["at"] + t["head"] + t["body"] + t["end"]).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    used = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return spans.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        "span",
        "piece",
        F.size("context").alias("n_context"),
        F.size(F.filter("own", lambda t: t["end"] == END)).alias("n_turns"),
        (used("context") + used("own")).alias("n_tokens"),
        F.concat("opening", F.array_join(F.transform("own", shown), "")).alias("formatted"),
        masks.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Each window's own turns (role, text, whether the turn ends there) and the texts under its loss mask, parsed from what was formatted."""
    marks = r"<\|(?:end|more)\|>\n"
    ends = F.regexp_extract_all("formatted", F.lit(r"<\|(end|more)\|>\n"), F.lit(1))
    pieces = F.arrays_zip(F.slice(F.split("formatted", marks), 1, F.size(ends)).alias("p"), ends.alias("e"))
    own = F.slice(pieces, F.col("n_context") + 1, F.size(pieces))
    part = lambda p, k: unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n(.*)$", k))
    return windows.withColumns(
        {
            "turns": F.transform(own, lambda t: F.struct(part(t["p"], 1).alias("role"), part(t["p"], 2).alias("text"), (t["e"] == "end").alias("ends"))),
            "loss_texts": F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))),
        }
    )


def digests(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, by conversation: counts and digests of turns and of text under the loss mask.

    A digest needs all text of a conversation in one row.
    """
    begins = lambda t: F.when(F.col("piece") == 0, F.concat(t["role"], F.lit("\n"))).otherwise(F.lit(""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(begins(t), t["text"], F.when(t["ends"], F.lit("\n")).otherwise(F.lit("")))), "")
    parts = read_back(windows).select("conv_id", F.size(F.filter("turns", lambda t: t["ends"])).alias("n"), F.length("formatted").alias("chars"), F.struct("span", "piece", lines.alias("lines"), F.array_join("loss_texts", "").alias("loss")).alias("part"))
    by_conv = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    whole = {k: F.array_join(F.col("parts")[k], "") for k in ("lines", "loss")}
    return by_conv.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(whole["lines"], 256).alias("turns_sha256"),
        F.length(whole["loss"]).cast("long").alias("loss_chars"),
        F.sha2(whole["loss"], 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
