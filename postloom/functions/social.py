"""Tokens of posts: marks for what isn't a word, annotations, contractions written out, tags cut into words.

One alternation finds all tokens of a text in a single pass; each token is then classed by the same patterns. Both run in the
JVM. Tags are cut by a Viterbi search over a table of word counts, for the tags alone in Arrow batches.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AMOUNT = r"[0-9]+(?:[.,][0-9]+)*"
_MONTH = r"(?:[Jj](?:an|un|ul)|[Ff]eb|[Mm]a[ry]|[Aa](?:pr|ug)|[Ss]ep|[Oo]ct|[Nn]ov|[Dd]ec)[a-z]*"
_YEAR = r"(?:19|20)[0-9]{2}"
_NAME = r"[\p{L}\p{N}_][\p{L}\p{M}\p{N}_]*"
#: Kinds of tokens that aren't plain words, in order, without look-around so that other engines read them too. Emoticons end at white space.
PATTERNS = {
    "url": r"https?://[^\s]+|www\.[^\s]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "user": r"@[A-Za-z0-9_]+",
    "hashtag": r"#[\p{L}\p{N}_][\p{L}\p{M}\p{N}_]*",
    "date": rf"{_YEAR}[/.-][0-9]{{1,2}}[/.-][0-9]{{1,2}}\b|[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-]{_YEAR}\b|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}\b|{_MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?\b(?:,? {_YEAR}\b)?|[0-9]{{1,2}}(?:st|nd|rd|th)? {_MONTH}\.? {_YEAR}\b",
    "time": r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp][Mm])?\b|[0-9]{1,2} ?[AaPp][Mm]\b",
    "percent": rf"{_AMOUNT}(?: ?%| percent\b)",
    "money": rf"[$€£¥] ?{_AMOUNT}(?:[KkMmBb]\b)?|{_AMOUNT}(?: ?[€£¥$]| (?:dollars|euros|pesos|usd|eur)\b)",
    "phone": r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b",
    "number": rf"{_AMOUNT}\b",
    "heart": r"<3",
    "happy": r"[:;=]-?[)\]dD](?:\s|$)",
    "sad": r"[:=]-?[(\[](?:\s|$)",
    "tong": r"[:;=]-?[pP](?:\s|$)",
    "annoyed": r":-?/(?:\s|$)",
    "surprise": r"[:=]-?[oO](?:\s|$)",
    "censored": r"[A-Za-z]+\*+[A-Za-z]+",
    "emphasis": r"\*[A-Za-z]+\*",
    "word": rf"{_NAME}(?:['’]\p{{L}}+)*",
    "repeated": r"!{2,}|\?{2,}|\.{2,}|[!?]{2,}",
    "other": r"[^\s]",
}
#: Kinds that become a mark of their own.
MARKS = ("url", "email", "user", "date", "time", "percent", "money", "phone", "number", "heart", "happy", "sad", "tong", "annoyed", "surprise")
_DAY = rf"(?:{_MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?\b(?:,? {_YEAR}\b)?)"
#: Any token, for engines without look-around; emoticons then hold the white space behind them.
ALTERNATION = "|".join([_DAY, *(f"(?:{p})" for p in PATTERNS.values())])
#: The same tokens, faster: plain words that nothing else can begin with come first, long runs aren't tried again, white space isn't taken.
_FAST = "|".join([r"\p{L}++(?![\p{M}\p{N}_@.%+*'’:-]| [0-9])", _DAY, *(f"(?:{p.replace(r'(?:\s|$)', r'(?=\s|$)').replace('%+-]+@', '%+-]++@')})" for p in PATTERNS.values())])
#: Texts without any of these hold plain words and marks only.
_SPECIAL = r"[0-9@#*'’<&$€£¥_]|://|[wW]{3}|[:;=]-?[)\](\[dDpPoO/]|(?i:([a-z])\1\1)|[!?.]{2}|\p{Lu}{2}"
#: Contractions of English, as patterns, and what they are short for; whole words first.
CONTRACTIONS = (
    (r"\bcan't\b", "can not"),
    (r"\bwon't\b", "will not"),
    (r"\bshan't\b", "shall not"),
    (r"\blet's\b", "let us"),
    (r"n't\b", " not"),
    (r"'re\b", " are"),
    (r"'ve\b", " have"),
    (r"'ll\b", " will"),
    (r"'d\b", " would"),
    (r"'m\b", " am"),
    (r"\b(it|he|she|that|what|there|here|who|where)'s\b", "$1 is"),
)
#: What is written for these signs in pages.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def raw_tokens(text: Column) -> Column:
    """The tokens as they are written, without white space; signs written for pages are read."""
    clean = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.regexp_extract_all(F.when(F.contains(text, F.lit("&")), clean).otherwise(text), F.lit(_FAST), F.lit(0))


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind].replace(r'(?:\s|$)', '')})$"


def _marked(t: Column, tag) -> Column:
    """One token as the tokens that stand for it."""
    lower = F.lower(t)
    one = lambda *c: F.array(*(F.lit(x) if isinstance(x, str) else x for x in c))
    known = F.replace(lower, F.lit("’"), F.lit("'"))
    apart = F.split(reduce(lambda c, s: F.regexp_replace(c, *s), CONTRACTIONS, known), " ")
    first = F.substring(t, 1, 1)
    # most tokens are settled by the first pattern: small letters, none three times in a row
    out = F.when(t.rlike(r"^(?:([a-z])(?!\1\1))++$"), one(t)).when(t.rlike(r"^[^\p{L}\p{N}]$"), one(t))
    out = out.when(lower.rlike(r"([a-z])\1\1"), one(F.regexp_replace(lower, r"([a-z])\1{2,}", "$1$1"), "<elongated>"))
    out = out.when(t.rlike(r"^\p{Lu}{2,}$"), one("<allcaps>", lower, "</allcaps>"))
    out = out.when(first == "#", F.when(t.rlike(_whole("hashtag")), F.concat(one("<hashtag>"), tag(t), one("</hashtag>"))).otherwise(one(lower)))
    rest = F.when(known.contains("'") & t.rlike(_whole("word")), apart)
    for kind, pattern in PATTERNS.items():
        if kind in MARKS:
            rest = rest.when(t.rlike(_whole(kind)), one(f"<{kind}>"))
        elif kind in ("censored", "emphasis"):
            rest = rest.when(t.rlike(_whole(kind)), one(F.replace(lower, F.lit("*"), F.lit("")) if kind == "emphasis" else lower, f"<{kind}>"))
        elif kind == "repeated":
            rest = rest.when(t.rlike(f"^(?:{pattern})$"), one(first, "<repeated>"))
    # letters without an apostrophe are words, but for dates and addresses
    return out.when(t.rlike(r"^\p{L}+$"), one(lower)).otherwise(rest.otherwise(one(lower)))


def tokens_social(text: Column, tags: Column | None = None) -> Column:
    """Lower-case tokens; null for a null text.

    Addresses, users, dates, times, percentages, money, telephone and other numbers and emoticons are replaced by ``<kind>``.
    ``<allcaps> word </allcaps>``, ``<hashtag> words </hashtag>``, ``word <elongated>`` (runs of a letter cut to two), ``word
    <emphasis>`` (written between stars), ``word <censored>`` and ``! <repeated>`` are annotated. ``tags`` (a map, see
    ``TagCutter.of``) has the words of each tag; others are one word.
    """
    plain = lambda t: F.array(F.lower(F.substring(t, F.lit(2), F.length(t))))
    tag = plain if tags is None else (lambda t: F.coalesce(F.try_element_at(tags, t), plain(t)))
    found = raw_tokens(text)
    return F.when(text.rlike(_SPECIAL), F.flatten(F.transform(found, lambda t: _marked(t, tag)))).otherwise(F.transform(found, F.lower))


def tags_of(text: Column) -> Column:
    """The distinct tags of a text as ``tokens_social`` finds them, with their signs; none for most texts at no cost."""
    return F.when(F.contains(text, F.lit("#")), F.array_distinct(F.filter(raw_tokens(text), lambda t: t.rlike(_whole("hashtag"))))).otherwise(F.array().cast("array<string>"))


# ---- words in tags ----

#: Words of the table, and letters of the longest.
MOST_WORDS, LONGEST = 200_000, 24
#: Costs are millionths of a power of ten, so that sums are exact; a letter of an unknown word costs a tenth each, a further word one millionth.
UNIT = 1_000_000


def word_counts(docs: DataFrame, text: str, most: int = MOST_WORDS) -> tuple[dict[str, int], int]:
    """Counts of the most frequent words (runs of letters in lower case, ties to the first in order), and of all words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    top = counts.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(most)  # ``most`` short words
    return {r.word: r.n for r in top.collect()}, total


class TagCutter:
    """Cuts tags into the words that are likeliest together by a table of counts."""

    def __init__(self, counts: dict[str, int], total: int):
        self.base = round(UNIT * math.log10(max(total, 1))) + 1
        self.costs = {w: round(UNIT * (math.log10(total) - math.log10(n))) + 1 for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)

    def cut(self, letters: str) -> list[str]:
        """The words of least cost, the sum of their logarithms and of one millionth each; an unknown word of n letters costs as one that was
        met 10 ** -n times. Of cuts that cost the same, the one with the longest last word, then the longest before, is taken."""
        n = len(letters)
        best, back = [0] * (n + 1), [0] * (n + 1)
        unknown, since = 0, 0  # the least of best[j] - j * UNIT, and the first j with it
        for k in range(1, n + 1):
            cost, start = unknown + self.base + k * UNIT, since
            for j in range(max(0, k - self.longest), k):
                known = self.costs.get(letters[j:k])
                if known is not None and (best[j] + known, j) < (cost, start):
                    cost, start = best[j] + known, j
            best[k], back[k] = cost, start
            if cost - k * UNIT < unknown:
                unknown, since = cost - k * UNIT, k
        out = []
        while n:
            out.append(letters[back[n] : n])
            n = back[n]
        return out[::-1]

    def words(self, tag: str) -> list[str]:
        """The words of a tag: cut where small letters meet capitals, at digits and underscores, and then by ``cut``."""
        parts, at = [], 0
        tag = tag.lstrip("#")
        kind = lambda c: "_" if c == "_" else "0" if c.isdigit() else "A" if c.isupper() else "a"
        for i in range(1, len(tag) + 1):
            if i == len(tag) or (kind(tag[i]) != kind(tag[i - 1]) and not (kind(tag[i - 1]) == "A" and kind(tag[i]) == "a")):
                parts.append(tag[at:i])
                at = i
        out: list[str] = []
        for part in parts:
            small = part.lower()
            out += [] if part[0] == "_" else [part] if part.isdigit() else self.cut(small)
        return out

    def of(self, tags: Column) -> Column:
        """A map from each tag of the array to its words, worked out in Arrow batches; a task remembers tags it has met."""
        cutter = self

        @F.pandas_udf("array<array<string>>")
        def cut_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = functools.lru_cache(100_000)(cutter.words)
            for batch in batches:
                yield batch.map(lambda found: [words(t) for t in found])

        return F.map_from_arrays(tags, cut_all(tags))


def social_rows(docs: DataFrame, text: str, cutter: TagCutter, name: str = "tokens") -> DataFrame:
    """The rows with the social tokens of a text, tags cut into words. Only tags go through Python."""
    tagged = docs.withColumn("_tags", F.coalesce(tags_of(F.col(text)), F.array().cast("array<string>")))
    return tagged.withColumn("_words", cutter.of(F.col("_tags"))).withColumn(name, tokens_social(F.col(text), F.col("_words"))).drop("_tags", "_words")
