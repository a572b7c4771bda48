"""Clock and calendar expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format: H:M:S with an optional fraction; hours to 23, minutes and seconds to 59.
CLOCK = r"^(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9](?:\.[0-9]*)?\z"


def time_to_ms(text: Column, strict_fraction: bool = False) -> Column:
    """Milliseconds of an ``H:M:S[.fff]`` text, null where it is malformed.

    A fraction shorter than three digits is padded on the right. A longer one
    is taken as a whole number of milliseconds, which is what the published
    training tables contain; ``strict_fraction`` keeps three digits instead.
    """
    hours, after = F.substring_index(text, ":", 1), F.substring_index(text, ":", -2)
    minutes, last = F.substring_index(after, ":", 1), F.substring_index(after, ":", -1)
    whole = F.substring_index(last, ".", 1)
    digits = F.substring(last, F.length(whole) + 2, F.length(last))
    if strict_fraction:
        fraction = F.rpad(digits, 3, "0")
    else:
        fraction = F.rpad(digits, F.greatest(F.length(digits), F.lit(3)), "0")

    def number(part: Column) -> Column:
        return part.try_cast("int").cast("long")

    seconds = number(hours) * 3600 + number(minutes) * 60 + number(whole)
    # Added rather than wrapped in a condition: generated code then cuts the text
    # once and shares the parts.
    well_formed = F.when(text.rlike(CLOCK), F.lit(0))
    return F.try_add(seconds * 1000 + well_formed, fraction.try_cast("long"))


def parse_date(text: Column, strict: bool = True) -> Column:
    """A date; malformed text raises when ``strict`` and is null otherwise."""
    return F.to_date(text) if strict else text.try_cast("date")


def days_apart(a: Column, b: Column) -> Column:
    """Absolute number of days between two dates."""
    return F.abs(F.datediff(a, b))


def signed_days(later: Column, earlier: Column) -> Column:
    """Days from ``earlier`` to ``later``; negative if they are swapped."""
    return F.datediff(later, earlier)
