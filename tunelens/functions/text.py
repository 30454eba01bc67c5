"""Text expressions that keep Python's Unicode rules while running in the JVM.

Java and Python disagree on what a space, a digit or a word character is, so
every class is spelled out here instead of relying on bare ``\\s``, ``\\d``, ``\\w``.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer marker, the option letters and the sentence shape
# that needs no extra full stop.
ANSWER_MARK = "####"
ANSWER_LETTERS = "abcd"
OPTION_LETTERS = ("A", "B", "C", "D")
OPTION_PREFIX_LENGTH = 3

# What str.strip and str.split treat as white space, as characters and as a
# regex class body (under the UNICODE flag).
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\s\x1c-\x1f"
UNICODE = "(?U)"  # makes Java's \s follow the Unicode White_Space property
DIGIT_CLASS = r"\p{Nd}"
WORD_CLASS = r"\p{L}\p{N}_"
CLOSED_SENTENCE = rf"{UNICODE}\A[A-Z][{WORD_CLASS}{SPACE_CLASS}]+[?.!]\z"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Whitespace-separated words; blank text gives one empty word."""
    return F.split(strip(text), f"{UNICODE}[{SPACE_CLASS}]+")


def word_count(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, f"{UNICODE}[{SPACE_CLASS}]+")))


@cache
def _decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit beside its ASCII value, from the Unicode data."""
    digits = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


def ascii_digits(text: Column) -> Column:
    foreign, plain = _decimal_digits()
    return F.translate(text, foreign, plain)


@cache
def _numeric_class() -> str:
    """Regex class for str.isnumeric: number categories plus numeric ideographs.

    The intersection asks for the category first, so that most characters never
    reach the long list.
    """
    letters = [c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and unicodedata.category(c) == "Lo"]
    return r"[\p{N}[\p{Lo}&&[" + "".join(letters) + "]]]"


def marker_parts(text: Column, marker: str = ANSWER_MARK) -> Column:
    """Left-to-right split, so ``#####1`` ends in ``#1`` and not in ``1``."""
    return F.split(text, marker, -1)


def last_part(text: Column, marker: str = ANSWER_MARK) -> Column:
    return strip(F.element_at(marker_parts(text, marker), -1))


def extract_answer(text: Column, marker: str = ANSWER_MARK) -> Column:
    """Leading digits after the last marker; null without marker or digits."""
    digits = F.regexp_extract_all(last_part(text, marker), F.lit(rf"^({DIGIT_CLASS}+)"), F.lit(1))
    return F.when(F.contains(text, F.lit(marker)), F.get(digits, F.lit(0)))


def same_number(digits: Column, number: Column) -> Column:
    """Integer equality for digit strings of any length, without a cast that may overflow."""
    return F.regexp_replace(ascii_digits(digits), r"^0+(?=\d)", "") == number.cast("string")


def normalise_sentence(text: Column) -> Column:
    """One raw line as a closed sentence.

    Runs of full stops become one break: ``.`` before a numeric character,
    ``. `` otherwise; possessive quantifiers keep the two passes apart.
    """
    numeric = _numeric_class()
    pieces = F.trim(F.replace(text, F.lit("\n"), F.lit("")), F.lit("."))
    spaced = F.regexp_replace(pieces, rf"\.++(?!{numeric})", ". ")
    joined = F.regexp_replace(spaced, rf"\.++(?={numeric})", ".")
    single = F.replace(joined, F.lit("  "), F.lit(" "))
    plain = rstrip(F.replace(single, F.lit("\\'"), F.lit("'")))
    closed = F.when(F.rlike(plain, F.lit(CLOSED_SENTENCE)), plain).otherwise(F.concat(plain, F.lit(".")))
    for doubled, mark in (("?.", "?"), ("!.", "!"), ("..", ".")):
        closed = F.replace(closed, F.lit(doubled), F.lit(mark))
    return closed


def strip_option(text: Column) -> Column:
    """Drop three characters from an option that starts with A-D, prefixed or not."""
    body = F.substr(text, F.lit(OPTION_PREFIX_LENGTH + 1))
    return F.when(F.substring(text, 1, 1).isin(*OPTION_LETTERS), body).otherwise(text)


def answer_index(text: Column) -> Column:
    """0-based place of the answer line inside ``abcd``; -1 when it is not there."""
    return F.position(F.replace(text, F.lit("."), F.lit("")), F.lit(ANSWER_LETTERS)) - 1


def label_to_option(label: Column) -> Column:
    """Answer letter to 1-based option: A is 1."""
    return F.ascii(F.upper(strip(label))) - (ord("A") - 1)


def option_letter(index: Column) -> Column:
    """0-based option to its letter."""
    return F.char(index + ord("A"))


def tail(text: Column, length: int) -> Column:
    return F.right(text, F.lit(length))
