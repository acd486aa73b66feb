"""Organization identifiers: nine digits in many spellings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(col: Column | str, then: Callable[[Column], Column]) -> Column:
    """``then`` of the nine digits, or null. The digits are bound to a variable, as the optimizer would otherwise work the patterns out
    anew wherever they are used."""
    c = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_replace(F.trim(c), r"\.0+$|[^0-9]", "")
    return F.transform(F.array(digits), lambda d: F.when(F.length(d).between(1, 9), then(F.lpad(d, 9, "0"))))[0]


def nine_digits(col: Column | str) -> Column:
    """The nine EIN digits of any spelling, or null.

    Numbers stored as doubles lose leading zeros and gain ``.0``; both are undone. A value without
    digits, or with more than nine, is null.
    """
    return _digits(col, lambda d: d)


def standard_ein(col: Column | str) -> Column:
    """``EIN-dd-ddddddd`` of any spelling, or null."""
    return _digits(col, lambda d: F.concat(F.lit("EIN-"), F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 7)))


def priority(seed: int, *cols: Column) -> Column:
    """Seeded order key: the first 60 bits of sha256(seed:key) as a long; the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
