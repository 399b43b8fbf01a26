"""Character n-grams inside word borders, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions.text import WHITESPACE_CLASS

# Overlapping windows by look-ahead.  In a text with single spaces a window is a
# gram of one padded word exactly if it has no space inside.  The search moves
# by UTF-16 unit, so a window must not begin at the second half of a pair.
_FIRST = r"[^\x{DC00}-\x{DFFF}]"
_WINDOWS = [
    f"(?s)(?!  )(?=({_FIRST}{'[^ ]' * (size - 2)}.))"
    for size in range(fv.GRAM_MIN, fv.GRAM_MAX + 1)
]


def words(text: Column) -> Column:
    """Lower-cased words, split on any run of white space."""
    split = F.split(F.lower(text), WHITESPACE_CLASS + "+")
    return F.filter(split, lambda word: word != "")


def _grams_of_words(word_array: Column) -> Column:
    spaced = F.concat(F.lit(" "), F.array_join(word_array, " "), F.lit(" "))
    return F.concat(*[F.regexp_extract_all(spaced, F.lit(w), F.lit(1)) for w in _WINDOWS])


def char_grams(text: Column) -> Column:
    """Every gram of the text with repeats: substrings of length 2 to 4 of each
    word with one space on both sides."""
    return _grams_of_words(words(text))


def distinct_char_grams(text: Column) -> Column:
    """The set of grams of the text; repeated words are cut up once."""
    return F.array_distinct(_grams_of_words(F.array_distinct(words(text))))
