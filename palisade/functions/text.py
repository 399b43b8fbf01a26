"""Column functions on text: character classes, stripping, base64, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import fixed_values as fv

Range = tuple[int, int]


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _class_body(ranges: list[Range]) -> str:
    """Java character-class text for a list of code point ranges."""
    return "".join(
        rf"\x{{{first:X}}}" if first == last else rf"\x{{{first:X}}}-\x{{{last:X}}}"
        for first, last in ranges
    )


def _characters(ranges: list[Range]) -> str:
    return "".join(chr(cp) for first, last in ranges for cp in range(first, last + 1))


# The range test in front lets Latin text leave the class after one comparison;
# the plain union of 21 ranges costs four times as much.
_LOW = [r for r in fv.FORMAT_CHARS if r[1] < 0x600]
_REST = [r for r in fv.FORMAT_CHARS if r[1] >= 0x600]
FORMAT_CHAR_CLASS = (
    f"[{_class_body(_LOW)}[\\x{{600}}-\\x{{10FFFF}}&&[{_class_body(_REST)}]]]"
)
WHITESPACE_CLASS = f"[{_class_body(fv.PYTHON_WHITESPACE)}]"


def _unprintable() -> list[Range]:
    """The characters that Python doesn't print, by its own rule and its own version of Unicode."""
    hidden = [cp for cp in range(0xAE, 0x110000) if not chr(cp).isprintable()]
    starts = [cp for before, cp in zip([None, *hidden], hidden) if before != cp - 1]
    stops = [cp for cp, after in zip(hidden, [*hidden[1:], None]) if after != cp + 1]
    return list(zip(starts, stops))


# Java's own classes follow another version of Unicode.  Latin text leaves the class early here too.
UNPRINTABLE_CLASS = (
    rf"[\x{{0}}-\x{{1F}}\x{{7F}}-\x{{A0}}\x{{AD}}[\x{{AE}}-\x{{10FFFF}}&&[{_class_body(_unprintable())}]]]"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# A run can only start where no run character precedes, so the look-behind keeps
# the matches the same and avoids retrying at every character of a word.
BASE64_RUN = (
    r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{%d,}+" % fv.BASE64_MIN_LENGTH
)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def has_format_chars(text: Column) -> Column:
    """True where the text holds a character of category Cf (all are non-ASCII)."""
    return F.when(is_ascii(text), F.lit(False)).otherwise(text.rlike(FORMAT_CHAR_CLASS))


def drop_format_chars(text: Column) -> Column:
    return F.when(is_ascii(text), text).otherwise(
        F.regexp_replace(text, FORMAT_CHAR_CLASS, "")
    )


def strip(text: Column) -> Column:
    """Python's ``str.strip``."""
    return F.btrim(text, F.lit(_characters(fv.PYTHON_WHITESPACE)))


def clean(text: Column) -> Column:
    """The text without format characters and outer white space; words are not touched."""
    return strip(drop_format_chars(text))


def js_trim(text: Column) -> Column:
    """JavaScript's ``String.trim``."""
    return F.btrim(text, F.lit(_characters(fv.JAVASCRIPT_WHITESPACE)))


def base64_tokens(text: Column) -> Column:
    """All maximal base64-alphabet runs that decode to printable UTF-8 text."""

    def decodes(token: Column) -> Column:
        # Spark accepts a last group without its padding; strict base64 does not.
        whole_groups = F.length(token) % 4 == 0
        decoded = F.try_to_binary(token, F.lit("base64")).cast("string")
        return F.coalesce(
            whole_groups & F.is_valid_utf8(decoded) & ~decoded.rlike(UNPRINTABLE_CLASS),
            F.lit(False),
        )

    return F.filter(F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0)), decodes)


def html_escape(text: Column) -> Column:
    for raw, entity in [
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"),
    ]:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def python_repr(text: Column) -> Column:
    """Python's ``repr`` of a string."""
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    quote = F.when(single & ~double, F.lit('"')).otherwise(F.lit("'"))

    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, escape in [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        body = F.replace(body, F.lit(raw), F.lit(escape))
    body = F.when(single & double, F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body)

    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        return (
            F.when(~char.rlike(UNPRINTABLE_CLASS), char)
            .when(code <= 0xFF, F.format_string("\\x%02x", code))
            .when(code <= 0xFFFF, F.format_string("\\u%04x", code))
            .otherwise(F.format_string("\\U%08x", code))
        )

    characters = F.regexp_extract_all(body, F.lit("(?s)."), F.lit(0))
    body = F.when(
        body.rlike(UNPRINTABLE_CLASS), F.array_join(F.transform(characters, escaped), "")
    ).otherwise(body)
    return F.concat(quote, body, quote)


def excerpt(text: Column, lines: int = fv.EXCERPT_LINES) -> Column:
    """The first ``lines`` lines, joined by newlines."""
    parts = F.split(text, LINE_BREAK, lines + 1)
    closes_line = (F.size(parts) <= lines) & (F.element_at(parts, -1) == "")
    kept = F.when(closes_line, F.size(parts) - 1).otherwise(F.least(F.size(parts), F.lit(lines)))
    return F.array_join(F.slice(parts, F.lit(1), kept), "\n")


def fixed_decimals(value: Column, digits: int, ties_up: bool = False) -> Column:
    """A number from 0 to below 1024 with a fixed number of decimals, rounded from its exact binary value.

    Ties go to the even neighbour, as in Python, or up, as in JavaScript.  A double
    is a whole number of 2^-62 if it lies between 2^-9 and 1, and of 2^-52 above,
    so rounding is a division of whole numbers.  Of up to two decimals, anything
    below 2^-9 gives zero.  Other values, not-a-number included, give null.
    """
    if not 0 < digits <= 2:
        raise ValueError("one or two decimals")
    small = value < 1
    bits = F.when(small, F.lit(62)).otherwise(F.lit(52))
    whole = "decimal(38,0)"
    unit = F.when(small, F.lit(2**62)).otherwise(F.lit(2**52)).cast(whole)
    scaled = (value * F.pow(F.lit(2.0), bits)).cast("long").cast(whole) * F.lit(10**digits).cast(whole)
    rest = (scaled % unit).cast(whole)
    floor = ((scaled - rest) / unit).cast("long")
    twice = (rest * 2).cast(whole)
    up = (twice > unit) | ((twice == unit) & (F.lit(True) if ties_up else floor % 2 == 1))
    rounded = floor + up.cast("long")
    text = F.concat(
        F.floor(rounded / 10**digits).cast("string"), F.lit("."), F.lpad((rounded % 10**digits).cast("string"), digits, "0")
    )
    zero = F.lit("0." + "0" * digits)
    return F.when((value >= 0) & (value < 2.0**-9), zero).when((value >= 0) & (value < 1024), text)


def percent(score: Column) -> Column:
    """A score as a percentage with one decimal, as browsers show it."""
    return F.concat(fixed_decimals(score * 100, 1, ties_up=True), F.lit("%"))


def risk_band(score: Column) -> Column:
    return (
        F.when(score > fv.RISK_HIGH_ABOVE, "high")
        .when(score > fv.RISK_ELEVATED_ABOVE, "elevated")
        .when(score.isNotNull(), "low")
    )
