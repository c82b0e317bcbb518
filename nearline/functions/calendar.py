"""Month names and month arithmetic (B23, B24) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: month abbreviations and full names, in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
FULL_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august",
              "september", "october", "november", "december")
# --- end of fixed values


def normalise_month(m: Column) -> Column:
    """Trim; full name (any case) or a 3-letter prefix -> ``Jan``..``Dec``.

    Any text whose first three letters spell a month is accepted
    (``Janxyz`` -> ``Jan``); anything else comes back trimmed.
    """
    t = F.trim(m)
    low = F.lower(t)
    full = F.create_map(*[x for name, ab in zip(FULL_NAMES, MONTHS) for x in (F.lit(name), F.lit(ab))])
    m3 = F.initcap(F.substring(low, 1, 3))
    return (F.when(t == "", t)
            .when(F.element_at(full, low).isNotNull(), F.element_at(full, low))
            .when(m3.isin(*MONTHS), m3)
            .otherwise(t))


def month_index(m: Column) -> Column:
    """0-based index of a normalised month; unknown months raise."""
    idx = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), m).cast("int")
    return F.when(idx > 0, idx - 1).otherwise(
        F.raise_error(F.concat(F.lit("unknown month: "), F.coalesce(m, F.lit("NULL")))))


def add_months(year: Column, month: Column, delta: Column | int) -> tuple[Column, Column]:
    """(year, month name) shifted by ``delta`` months (floor division)."""
    d = F.lit(delta) if isinstance(delta, int) else delta
    total = year.cast("int") * 12 + month_index(normalise_month(month)) + d
    new_year = F.floor(total / 12).cast("int")
    new_month = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), (F.pmod(total, F.lit(12)) + 1).cast("int"))
    return new_year, new_month
