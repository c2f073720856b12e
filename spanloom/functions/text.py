"""Text expressions that stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as blank when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same in a pattern, as ranges.
BLANK = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# A unit is a run of text up to its terminators and the blanks behind them; units tile the text.
UNIT_PATTERN = f"[^.!?\n]*[.!?\n]+[{WHITESPACE}]*|[^.!?\n]+"

# The separators that end a line when a text is cut into lines.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# A token is a run of letters and digits, or one other visible character.
TOKEN_PATTERN = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{WHITESPACE}]"

# Fixed value: the words counted by the overlap scores.
ROUGE_WORD = "[a-z0-9]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def words(c: Column) -> Column:
    """Words between blanks; a blank text has none."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAKS)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def rouge_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(ROUGE_WORD), F.lit(0))


def unique_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(c, "")))


def fixed_width(c: Column, width: int) -> Column:
    """The text cut into pieces of ``width`` characters."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
