"""Month and date scalars as column expressions.

Two rules for a month without a day are kept apart on purpose: dates of publication take its last day, cutoffs its first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(date: Column) -> Column:
    """Months since year 0: year * 12 + month - 1."""
    return F.year(date) * 12 + F.month(date) - 1


def month_of_index(index: Column) -> Column:
    """YYYY-MM of a month index."""
    return F.when(index.isNotNull(), F.format_string("%04d-%02d", F.floor(index / 12), index % 12 + 1))


def normalize_month(raw: Column) -> Column:
    """YYYY-MM of YYYY-MM, YYYY-MM-DD or YYMM (20YY, month 01 to 12); null for anything else."""
    t = F.trim(raw)
    short = F.concat(F.lit("20"), F.substring(t, 1, 2), F.lit("-"), F.substring(t, 3, 2))
    return F.when(t.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.substring(t, 1, 7)).when(t.rlike(r"^\d{2}(0[1-9]|1[0-2])$"), short)


def index_of_month(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def shift_month(month: Column, by: int) -> Column:
    return month_of_index(index_of_month(month) + by)


def month_start(month: Column) -> Column:
    return F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def month_end(month: Column) -> Column:
    return F.last_day(month_start(month))


def _day(raw: Column) -> Column:
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))


def _month_only(raw: Column) -> Column:
    return F.when(raw.rlike(r"^\d{4}-\d{2}$"), raw)


def published_date(raw: Column) -> Column:
    """A day; a month alone means its last day; else null."""
    t = F.trim(raw)
    return F.coalesce(_day(t), month_end(_month_only(t)))


def cutoff_date(raw: Column) -> Column:
    """A day; a month alone means its first day; else null."""
    t = F.trim(raw)
    return F.coalesce(_day(t), month_start(_month_only(t)))


def published_of_paper(published: Column, paper_id: Column, month: Column) -> Column:
    """The date given, else the last day of the month in the id's first four digits, else of the month given."""
    prefix = F.when(paper_id.rlike(r"^\d{4}\."), normalize_month(F.substring(paper_id, 1, 4)))
    return F.coalesce(published_date(published), month_end(prefix), month_end(normalize_month(month)))


def yymm(date: Column) -> Column:
    return F.date_format(date, "yyMM")


def new_york_date(utc: Column) -> Column:
    """The calendar date in New York of a moment in UTC."""
    return F.to_date(F.from_utc_timestamp(utc.cast("timestamp"), "America/New_York"))


def lead_time_fraction(published: Column, cutoff: Column, end: Column) -> Column:
    """Days after the cutoff as a share of the horizon's days, between 0 and 1; 0 where a bound is missing."""
    share = F.datediff(published, cutoff) / F.when(F.datediff(end, cutoff) > 0, F.datediff(end, cutoff))
    return F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
