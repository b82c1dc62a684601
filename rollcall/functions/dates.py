"""The day a typed text means, as Column expressions, first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import as_column, cell, strip_diacritics

EPOCH = "1899-12-30"
# The patterns of the rules, in order.
SERIAL = "^\\d{5}(\\.\\d+)?$"
ISO = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})"
DAY_FIRST = "^(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{2,4})"
VIETNAMESE = "(\\d{1,2})\\s*thang\\s*(\\d{1,2})\\s*(?:nam\\s*)?(\\d{4})"
LAYOUTS = ("yyyy/MM/dd", "dd MMM yyyy", "MMM d, yyyy")


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def build_date(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is none or its year is outside 1900 to 2200."""
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    return F.when(year.between(1900, 2200) & month.between(1, 12) & day.between(1, 31), made)


def excel_serial(c: Column | str) -> Column:
    days = F.split(as_column(c), "\\.")[0].try_cast("int")
    return F.when(days.between(1, 100000), F.date_add(F.lit(EPOCH).cast("date"), days))


def event_date(c: Column | str) -> Column:
    """Serial, ISO, day first, Vietnamese, then named layouts; the first matching pattern decides even if its date is invalid."""
    v = cell(c)
    folded = F.lower(strip_diacritics(v))
    d, m, y = (_int(v, DAY_FIRST, g) for g in (1, 2, 3))
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    swap = (m > 12) & (d <= 12)
    out = F.when(v.rlike(SERIAL), excel_serial(v))
    out = out.when(v.rlike(ISO), build_date(*(_int(v, ISO, g) for g in (1, 2, 3))))
    out = out.when(v.rlike(DAY_FIRST), build_date(year, F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d)))
    out = out.when(folded.rlike(VIETNAMESE), build_date(*(_int(folded, VIETNAMESE, g) for g in (3, 2, 1))))
    return out.otherwise(F.coalesce(*(F.try_to_date(v, layout) for layout in LAYOUTS)))


def display_date(date: Column | str, raw: Column | str) -> Column:
    d, r = as_column(date), as_column(raw)
    return F.when(d.isNotNull(), F.date_format(d, "dd/MM/yyyy")).when(r != "", F.concat(r, F.lit(" (chưa nhận dạng)"))).otherwise(F.lit(""))
