"""N-grams and tokens as Column expressions.

One pass of a look-ahead pattern per n-gram size keeps the work linear in the text,
where repeated ``substr`` would walk the string from its start for every gram.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode defines it plus the four ASCII separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
# Fixed value: a word is a run of two or more word characters.
WORD = r"(?U)\b\w\w+\b"


def _all_windows(text: Column, lo: int, hi: int) -> Column:
    """Every n-gram of sizes lo..hi: look ahead n characters, step one code point."""
    sized = [
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
        for n in range(lo, hi + 1)
    ]
    return F.flatten(F.array(*sized)) if len(sized) > 1 else sized[0]


def char_ngrams(col: Column, lo: int = 2, hi: int = 4) -> Column:
    """All character n-grams, lower-cased, runs of two or more blanks as one space."""
    return _all_windows(collapsed(col), lo, hi)


def collapsed(col: Column) -> Column:
    """Lower case, runs of two or more blanks as one space: the string whose windows are the n-grams."""
    return F.regexp_replace(F.lower(col), WHITESPACE + "{2,}", " ")


def squeeze(col: Column) -> Column:
    """Lower case, whitespace runs as one space, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(col), WHITESPACE + "+", " "))


def padded_ngram_set(col: Column, lo: int = 2, hi: int = 4) -> Column:
    """Distinct n-grams of the squeezed string with one space at either end."""
    return F.array_distinct(_all_windows(padded(col), lo, hi))


def padded(col: Column) -> Column:
    return F.concat(F.lit(" "), squeeze(col), F.lit(" "))


def word_tokens(col: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def tokens(col: Column, analyzer: str, lo: int = 2, hi: int = 4) -> Column:
    """``char`` n-grams or ``word`` unigrams."""
    if analyzer == "char":
        return char_ngrams(col, lo, hi)
    if analyzer == "word":
        if (lo, hi) != (1, 1):
            raise ValueError("the word analyzer supports unigrams only")
        return word_tokens(col)
    raise ValueError(f"analyzer {analyzer!r} is not supported, expected 'char' or 'word'")
