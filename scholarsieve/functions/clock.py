"""Times as UTC wall clock (TIMESTAMP_NTZ), independent of the session zone."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

SHANGHAI = "Asia/Shanghai"


def utc(moment: datetime) -> Column:
    """A literal UTC time; naive datetimes are taken as UTC already."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """ISO 8601 with a zone to UTC; naive or malformed text gives null."""
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    instant = F.when(zoned, F.try_to_timestamp(text))
    # An instant cast to NTZ shows the session's wall clock; shift that to UTC.
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def iso(time: Column) -> Column:
    """Python isoformat of a UTC time: microseconds only when present."""
    micros = F.date_format(time, "SSSSSS")
    head = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(head, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def local_time(time: Column, zone: str = SHANGHAI) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), time)


def local_day(time: Column, zone: str = SHANGHAI) -> Column:
    return local_time(time, zone).cast("date")


def minute(time: Column) -> Column:
    return F.date_trunc("minute", time).cast("timestamp_ntz")


def query_stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMddHHmm")


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """First and last microsecond, in UTC, of a local calendar day."""
    def at_midnight(d):
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz"))

    return at_midnight(day), at_midnight(F.date_add(day, 1)) - F.expr("interval 1 microsecond")


def moment(text: Column, end_of_day: bool = False) -> Column:
    """A bare date covers its whole UTC day; anything else must carry a zone."""
    day = F.when(F.length(text) == 10, text.try_cast("date"))
    start, end = day_bounds(day, "UTC")
    return F.coalesce(end if end_of_day else start, parse_time(text))
