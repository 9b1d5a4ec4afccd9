"""Date and time expressions. ``as_of`` always stands in for the wall clock."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

from reachlens.fixed_values import TENANT_ZONE, TIME_BUCKETS, WEEKDAYS

AsOf = dt.date | dt.datetime | str


def to_moment(as_of: AsOf) -> dt.datetime:
    """``as_of`` as a zone-less moment; a plain day means its midnight."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo is not None:
            raise ValueError("as_of must not carry a time zone")
        return as_of
    return dt.datetime.combine(as_of, dt.time())


def to_day(as_of: AsOf) -> dt.date:
    """The calendar day of ``as_of``."""
    return to_moment(as_of).date()


def local_day(utc_moment: AsOf, zone: str = TENANT_ZONE) -> dt.date:
    """The day it is in ``zone`` at a UTC moment, for use as ``as_of``."""
    return to_moment(utc_moment).replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone)).date()


def day_sql(day: dt.date) -> str:
    return f"DATE '{day.isoformat()}'"


def moment_sql(moment: dt.datetime) -> str:
    return f"TIMESTAMP_NTZ '{moment.isoformat(sep=' ')}'"


def as_date(as_of: AsOf) -> Column:
    """The calendar day of ``as_of`` as a literal."""
    return F.expr(day_sql(to_day(as_of)))


def days_before(as_of: AsOf, days: int) -> Column:
    """A literal, so partitions and row groups can be pruned by it."""
    return F.expr(day_sql(to_day(as_of) - dt.timedelta(days)))


def days_after(as_of: AsOf, days: int) -> Column:
    return days_before(as_of, -days)


def yesterday_in_zone(utc_moment: Column, zone: str = TENANT_ZONE) -> Column:
    """The day before the local day that ``utc_moment`` falls on in ``zone``."""
    return F.date_sub(F.to_date(F.from_utc_timestamp(utc_moment, zone)), 1)


def month_start(as_of: AsOf) -> Column:
    return as_date(to_day(as_of).replace(day=1))


def iso_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def parse_time(text: Column, fmt: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """Timestamp from text; null when the text does not follow the format."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def time_bucket(moment: str) -> Column:
    """Posting-time label: single hours from 9 AM to midnight, one label for 1-8 AM.

    ``moment`` is a column name; a missing time has no label.
    """
    hour = f"hour({moment})"
    return F.expr(f"""
        CASE WHEN {hour} = 0 THEN '12 AM' WHEN {hour} < 9 THEN '1-8 AM'
             WHEN {hour} < 12 THEN concat({hour}, ' AM') WHEN {hour} = 12 THEN '12 PM'
             WHEN {hour} > 12 THEN concat({hour} - 12, ' PM') END""")


def weekday_name(moment: Column) -> Column:
    """English weekday name, looked up by number so no locale can change it."""
    names = F.array(*[F.lit(day) for day in WEEKDAYS])
    return F.get(names, F.weekday(moment))


CATEGORY_LABELS = {"time_bucket": TIME_BUCKETS, "weekday": WEEKDAYS}
