"""Small column helpers used across the function modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser counts it; Java's ``\s`` knows ASCII only.
SPACE = r"[\s\p{Z}\x{FEFF}]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The value as text, empty where it is missing."""
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(as_col(c), f"{SPACE}+", " "))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), f"^{SPACE}+|{SPACE}+\\z", "")


def norm(c: Column | str) -> Column:
    """Comparison form of page text: lower case, single blanks, trimmed."""
    return F.lower(squeeze(text(c)))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def replace_matches(c: Column, pattern: str, render: Callable[[Column], Column]) -> Column:
    """``regexp_replace`` whose replacement is computed from each match.

    The gaps and the matches are taken apart and zipped back together, so the
    whole thing stays in the JVM. Text without a match skips that work.
    """
    gaps = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pieces = F.transform(
        gaps, lambda gap, i: F.concat(gap, F.coalesce(F.when(i < F.size(hits), render(F.get(hits, i))), F.lit("")))
    )
    return F.when(c.rlike(pattern), F.array_join(pieces, "")).otherwise(c)


def decode_percent(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and gives up on broken input."""
    plain = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    broken = plain.isNull() | (plain.contains("�") & ~c.contains("�"))
    return F.when(~c.contains("%"), c).when(broken, c).otherwise(plain)


def word_tokens(c: Column, separator: str) -> Column:
    """camelCase and separated names as a list of words."""
    spaced = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, separator, -1), lambda w: w != "")


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """Position of a value in a fixed list; unknown values come last."""
    position = F.array_position(literal_array(order), c)
    return F.when(F.coalesce(position, F.lit(0)) == 0, len(order)).otherwise(position - 1).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly expression once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------- limits that a caller may ask for


def shortened(c: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or all of them."""
    return c if chars is None else F.substring(c, 1, chars)


def first_of(items: Column, n: int | None) -> Column:
    """The first ``n`` items of an array, or all of them."""
    return items if n is None else F.slice(items, 1, n)


def at_most(number: Column, n: int | None) -> Column:
    """Whether a row number is within ``n``; always without a limit."""
    return F.lit(True) if n is None else number <= n
