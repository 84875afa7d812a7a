"""Text normalisers, sentence and token rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_WORD = 900
WHITE = r"[ \t\n\x0B\f\r]"
SENTENCE_END = rf"(?<=[.!?]){WHITE}+"
#: A word of letters, marks, digits and underscores, inner hyphens and apostrophes included, or any other sign.
WORD = r"[\p{L}\p{M}\p{N}_]"
TOKEN = rf"{WORD}+(?:[-']{WORD}+)*|[^\s\p{{L}}\p{{M}}\p{{N}}_]"


def strip_title_brackets(title: Column) -> Column:
    """``[Title].`` -> ``Title.``; other titles are only trimmed."""
    return F.regexp_replace(F.trim(title), r"(?s)^\[(.*)\]\.$", "$1.")


def drop_wordless_brackets(text: Column) -> Column:
    """Brackets around nothing but non-word (ASCII) characters become a blank."""
    for opening, closing in ((r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}")):
        text = F.regexp_replace(text, rf"{opening}[\W\s]*{closing}", " ")
    return text


def strip_control(text: Column) -> Column:
    """Line and paragraph separators become blanks, control characters go, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[  ]", " "), r"\p{C}", ""))


def normalise(text: Column) -> Column:
    return strip_control(drop_wordless_brackets(text))


def sentences(text: Column) -> Column:
    """Array of sentences: cut at white space after ``.``, ``!`` or ``?``; empty pieces are left out."""
    return keep_nonempty(F.split(text, SENTENCE_END))


def tokens(sentence: Column) -> Column:
    """Tokens of a sentence; none if a word has ``LONGEST_WORD`` bytes or more."""
    too_long = F.exists(F.split(F.trim(sentence), r"\s+"), lambda w: F.octet_length(w) >= LONGEST_WORD)
    return F.when(too_long, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0)))


def lowered(words: Column) -> Column:
    return F.transform(words, F.lower)


def keep_nonempty(blocks: Column) -> Column:
    return F.filter(blocks, lambda x: F.length(x) > 0)


def long_enough(words: Column, least_bytes: int = 2) -> Column:
    """Whether tokens have more than ``least_bytes`` UTF-8 bytes together."""
    return F.aggregate(F.transform(words, F.octet_length), F.lit(0), lambda a, b: a + b) > least_bytes


def simple_year(year: Column, free_date: Column) -> Column:
    """The first four characters of the free date if there is one, else the year, else 0."""
    return F.coalesce(F.substring(free_date, 1, 4).try_cast("int"), year.try_cast("int"), F.lit(0))


def robust_year(year: Column, free_date: Column, this_year: int) -> Column:
    """Year of a free date (``d/d/yy`` or its first four digits) if there is one, else the year."""
    short = F.regexp_extract(free_date, r"\d+/\d+/(\d+)", 1)
    digits = F.regexp_extract(free_date, r"([0-9]{4})", 1)
    two = short.try_cast("int")
    century = F.when(two <= this_year - 1999, two + 2000).otherwise(two + 1900)
    found = F.when(short != "", century).otherwise(digits.try_cast("int"))
    return F.when(free_date.isNotNull(), found).otherwise(year.try_cast("int"))


def valid_year(year: Column, this_year: int) -> Column:
    return year.between(1800, this_year + 1)
