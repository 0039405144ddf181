"""String helpers shared by all operators.  Everything here is a Column -> Column function."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that count as white space when text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_ESCAPED_SPACE = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)

# Words and shapes that make a text look as if it named a date or a time.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
WEEKDAY_ABBREVIATIONS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
DATE_SHAPES = [  # behind one or two digits
    r"[/-]\d{1,2}[/-]\d{2,4}",
    r":\d{2}\s*(?:am|pm)?",
    r"(?:st|nd|rd|th)",
]

_WORDS = MONTHS + MONTH_ABBREVIATIONS + WEEKDAYS + WEEKDAY_ABBREVIATIONS
# All begin and end at the edge of a word: the edge is looked for once at each place, and what cannot begin one is passed over.
DATE_PATTERN = (
    r"(?iU)\b(?=[\d" + "".join(sorted({w[0] for w in _WORDS})) + r"])"
    r"(?:\d{1,2}(?:" + "|".join(DATE_SHAPES) + r")|(?:" + "|".join(_WORDS) + r"))\b"
)


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``: a one-element transform serves as a let.

    Without it an expression that uses its argument several times is copied at every level of nesting.
    """
    return F.transform(F.array(value), fn)[0]


def let(value: Column, body: str) -> Column:
    """``bind`` with the body written as an SQL lambda, ``v -> ...``.

    One expression text is much quicker to hand over than hundreds of column objects, so the larger
    functions are written this way.
    """
    return each_item(F.array(value), body)[0]


def each_item(items: Column, body: str) -> Column:
    """``transform`` with the body written as an SQL lambda."""
    return F.call_function("transform", items, F.expr(body))


def sql_strip(text: str) -> str:
    """``strip`` as SQL."""
    return f"btrim({text}, '{_ESCAPED_SPACE}')"


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def non_empty(col: Column) -> Column:
    """NULL for the empty string, the value otherwise."""
    return F.when(col != "", col)


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols])


def windows(text: Column, size: int) -> Column:
    """The whole text in pieces of at most ``size`` characters, each cut after the last line end that fits.

    Put together the pieces are the text; a line longer than ``size`` is cut inside.  Any two neighbours
    hold more than ``size`` characters, which bounds the steps.
    """
    at = "element_at(cuts, -1)"
    line_end = f"locate('\\n', reverse(substring(v.t, {at}, {size})))"
    width = f"CASE WHEN {at} + {size} > v.n THEN v.n - {at} + 1 ELSE {size} - greatest({line_end} - 1, 0) END"
    cuts = (
        f"aggregate(sequence(1, 2 * cast(ceil(v.n / {size}) AS int) + 1), cast(array(1) AS array<int>), "
        f"(cuts, i) -> CASE WHEN {at} > v.n THEN cuts ELSE array_append(cuts, cast({at} + {width} AS int)) END)"
    )
    pieces = "transform(slice(c, 1, size(c) - 1), (start, i) -> substring(v.t, start, c[i + 1] - start))"
    return let(F.struct(text.alias("t"), F.length(text).alias("n")), f"v -> transform(array({cuts}), c -> {pieces})[0]")


def names_a_date(col: Column) -> Column:
    """H9: does the text hold a date shape, a month, a weekday, a clock time or an ordinal?"""
    return col.rlike(DATE_PATTERN)


def replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, applied left to right."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)
