"""Text expressions: keyword and pattern flags, cleaning, tokens and n-grams. Columns in, columns out, all in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def coalesce_text(text: Column, full_text: Column, truncated: Column) -> Column:
    """The full text of a truncated post; a null mark means not truncated."""
    return F.when(F.coalesce(truncated, F.lit(False)), full_text).otherwise(text)


def column_name(phrase: str) -> str:
    """A phrase as a column name."""
    return re.sub(r"[ ?]", "_", phrase)


def contains_flags(text: Column, phrases: list[str]) -> list[Column]:
    """One 0/1 column for each phrase that is a substring."""
    return [text.contains(p).cast("int").alias(column_name(p)) for p in phrases]


def alternation(phrases: list[str], escape: bool = False) -> str:
    """``(a)|(b)|...`` of the distinct phrases in order; by default they are patterns."""
    return "|".join(f"({re.escape(p) if escape else p})" for p in sorted({p.lower() for p in phrases}))


def regex_flag(text: Column, phrases: list[str], escape: bool = False) -> Column:
    return F.lower(text).rlike(alternation(phrases, escape)).cast("int")


def any_flag(flags: list[Column]) -> Column:
    return (reduce(Column.__add__, flags) > 0).cast("int")


def gap_pattern(parts: list[str]) -> str:
    """Parts in order with word characters, blanks and dots between them."""
    return r"[.\w\s\d]*".join(parts)


def run_pattern(parts: list[str], most: int | None = None) -> str:
    """As ``gap_pattern`` for plain parts, in one pass: it begins where a run of gap characters begins, goes to the first place of each part and never back.

    With ``most`` it begins at the first part, and gaps are no longer than that.
    """
    up_to = lambda p: rf"(?:(?!{p})[.\w\s]){'*' if most is None else f'{{0,{most}}}'}+{p}"
    return (r"(?:^|[^.\w\s])" + up_to(parts[0]) if most is None else parts[0]) + "".join(map(up_to, parts[1:]))


def ngram_gap(text: Column, parts: list[str]) -> Column:
    """One part: a substring (a pattern if it has a bar); more: in order with a gap.

    Plain parts need no backtracking over the text: short gaps are looked for first, then gaps of any length, only in texts with all parts.
    """
    if len(parts) == 1:
        return text.rlike(parts[0]) if "|" in parts[0] else text.contains(parts[0])
    if all(re.fullmatch(r"[a-zA-Z0-9 ]+", p) for p in parts):
        return reduce(Column.__and__, map(text.contains, parts)) & (text.rlike(run_pattern(parts, 200)) | text.rlike(run_pattern(parts)))
    return text.rlike(gap_pattern(parts))


def any_of(text: Column, patterns: list[str], substrings: list[str]) -> Column:
    """Any pattern matches or any substring occurs."""
    tests = [text.rlike(p) for p in patterns] + [text.contains(s) for s in substrings]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def has_tokens(tokens: Column, motif: list[str]) -> Column:
    """All motif tokens are among the tokens, in any order."""
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, motif)))) == len(set(motif))


def ordered_pattern(motif: list[str]) -> str:
    """Motif tokens as whole words in order, whatever the case."""
    return "(?i)" + ".*".join(rf"\b{re.escape(t)}\b" for t in motif)


def mask_mentions_urls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"@\w+", "@mention"), r"https?://\S+", "<url>")


def drop_links(text: Column) -> Column:
    return F.regexp_replace(text, r"http\S+", "")


#: Small letters whose stroke, hook, tail or the like isn't a mark of its own in Unicode, by their plain letter.
STROKES = {
    "a": "ᶏẚⱥ",
    "b": "ƀƃɓᵬᶀꞗ",
    "c": "ƈȼɕꞓꞔ",
    "d": "đƌȡɖɗᵭᶁᶑꟈ",
    "e": "ɇᶒⱸꬴ",
    "f": "ƒᵮᶂꞙ",
    "g": "ǥɠᶃꞡ",
    "h": "ħɦⱨꞕ",
    "i": "ɨᶖ",
    "j": "ɉʝ",
    "k": "ƙᶄⱪꝁꝃꝅꞣ",
    "l": "ŀłƚȴɫɬɭᶅⱡꝉꞎꬷꬸꬹ",
    "m": "ɱᵯᶆꬺ",
    "n": "ƞȵɲɳᵰᶇꞑꞥꬻ",
    "o": "øⱺꝋꝍ",
    "p": "ƥᵱᵽᶈꝑꝓꝕ",
    "q": "ɋʠꝗꝙ",
    "r": "ɍɼɽɾᵲᵳᶉꞧꭉ",
    "s": "ȿʂᵴᶊꞩꟊ",
    "t": "ŧƫƭȶʈᵵⱦ",
    "u": "ᶙꞹꭎꭒ",
    "v": "ʋᶌⱱⱴꝟ",
    "w": "ⱳ",
    "x": "ᶍꭖꭗꭘꭙ",
    "y": "ƴɏỿꭚ",
    "z": "ƶȥɀʐʑᵶᶎⱬ",
}
#: Letters of an alphabet of their own, though Unicode writes them as a letter and a mark or as capitals of others.
OWN_LETTERS = "ЁёЃѓЇїЌќЎўЙйϓϔ\u212bƉɊ"


@cache
def _plain_letters() -> tuple[str, str]:
    """All letters that are a plain letter with marks, or in STROKES (also as capitals), and their plain letters, in two strings."""
    plain = {marked: letter for letter, row in STROKES.items() for marked in row}
    plain |= {marked.upper(): letter.upper() for marked, letter in plain.items() if len(marked.upper()) == 1 and marked.upper() not in (marked, *OWN_LETTERS)}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and c not in OWN_LETTERS and unicodedata.category(c)[0] == "L" and min(map(unicodedata.combining, apart[1:])) >= 200:
            plain[c] = plain.get(apart[0], apart[0])
    return "".join(plain), "".join(plain.values())


def unaccent(text: Column) -> Column:
    """Combining marks dropped, letters with marks or strokes replaced by their plain letters, on all planes.

    Marks are those above, below or beside a letter; signs that are part of a letter in its script (nuktas, voicing, vowels)
    stay where they are one character with it.
    """
    return F.translate(F.regexp_replace(text, r"\p{M}", ""), *_plain_letters())


#: Accented small letters of Spanish and Portuguese that are replaced, and their plain forms.
LATIN, PLAIN = "áàãéêèíòóõúüñç", "aaaeeeiooouunc"


def unaccent_latin(text: Column, marked: str = LATIN, plain: str = PLAIN) -> Column:
    """The letters of ``marked`` replaced by those of ``plain``, all others as they are."""
    return F.translate(text, marked, plain)


def keep_alnum(text: Column) -> Column:
    return F.rtrim(F.ltrim(F.regexp_replace(text, r"[^\sa-zA-Z0-9@]", " ")))


def drop_backslash(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit(" "))


def tokens_nonword(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\W"), lambda t: t != "")


def tokens_space(text: Column) -> Column:
    return F.split(text, " ")


def skipgrams(tokens: Column, n: int, gap: int | None = None) -> Column:
    """All ``n``-token combinations in order, at most ``gap`` tokens left out between neighbours (any number if None)."""
    size = F.size(tokens)

    def extend(grams: Column) -> Column:
        def each(g: Column) -> Column:
            last = g["at"]
            stop = size if gap is None else F.least(size, last + 1 + gap)
            more = F.when(last < stop, F.sequence(last + 1, stop)).otherwise(F.array().cast("array<int>"))
            return F.transform(more, lambda i: F.struct(F.concat(g["gram"], F.array(F.element_at(tokens, i))).alias("gram"), i.alias("at")))

        return F.flatten(F.transform(grams, each))

    one = F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.array(F.element_at(tokens, i)).alias("gram"), i.alias("at")))
    return F.transform(reduce(lambda g, _: extend(g), range(n - 1), one), lambda g: g["gram"])


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams, joined by blanks; none for no tokens. The tokens are worked out ``n`` times, not once for each n-gram."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = [F.slice(tokens, k + 1, count) for k in range(n)]
    joined = reduce(lambda grams, more: F.zip_with(grams, more, lambda a, b: F.concat(a, F.lit(" "), b)), shifted)
    return F.coalesce(joined, F.array().cast("array<string>"))


def in_blocks(batch, column: int, most: int = 1 << 22):
    """Slices of an Arrow batch whose texts take about ``most`` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = load = 0
    for i, n in enumerate(sizes):
        if load and load + n > most:
            yield batch.slice(at, i - at)
            at, load = i, 0
        load += n
    if at < len(sizes):
        yield batch.slice(at)
