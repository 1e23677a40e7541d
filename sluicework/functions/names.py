"""Names of runs, and times that logs tell, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions.text import strip

AGAIN = "try again at "


def run_name(value: Column) -> Column:
    """A name in lower case, with single underscores for hyphens, spaces and runs of them, and none at the ends; null if nothing
    is left, or anything but ASCII letters, digits and underscores is."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(strip(value)), "[- ]", "_"), "_+", "_")
    plain = F.regexp_replace(plain, "^_|_$", "")
    return F.when(plain.rlike("^[a-z0-9_]+$"), plain)


def retry_at(log: Column, now: Column) -> Column:
    """When a log's last "try again at h:mm AM" comes next after ``now``, at 30 seconds: today, or tomorrow if that is past.
    Null without such a time. Any case; a stop may follow."""
    rest = F.regexp_extract(log, rf"(?is)^.*{AGAIN}([^\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]*)", 1)
    time = F.regexp_replace(strip(rest), r"\.+$", "")
    form = r"(?i)^(1[0-2]|0?[1-9]):([0-5]?[0-9])(?U:\s+)([ap])m$"
    hour, minute, half = (F.regexp_extract(time, form, k) for k in (1, 2, 3))
    hours = hour.try_cast("int") % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)
    today = F.date_trunc("day", now) + F.make_interval(hours=hours, mins=minute.try_cast("int"), secs=F.lit(30))
    at = F.when(today <= now, today + F.expr("interval 1 day")).otherwise(today)
    return F.when(time.rlike(form), at)
