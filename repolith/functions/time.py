"""Instants, months and weeks as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(c: Column | str) -> Column:
    """The instant named by ISO 8601 text in any notation and offset.

    Text without an offset is UTC; null, blank or unreadable text gives null.
    """
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    whole = F.when(text.rlike(r":[0-9]{2}(?:[.][0-9]+)?(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"), text).when(text.contains(":"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt ]|$)"), whole).try_cast("timestamp")  # a time alone would be today's


def iso_seconds(c: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of an instant (the session's zone is UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_iso() -> Column:
    """This instant as ``YYYY-MM-DDTHH:MM:SSZ``."""
    return iso_seconds(F.current_timestamp())


def month_key(c: Column | str) -> Column:
    """``YYYY-MM``: the first seven characters of ISO text."""
    return F.substring(c, 1, 7)


def month_index(month: Column) -> Column:
    """Months since year 0 of ``YYYY-MM`` text; null where it is not one."""
    ok = month.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$")
    return F.when(ok, F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1)


def week_start(ts: Column) -> Column:
    """ISO text of the Monday of the week in UTC; empty text where there is no instant."""
    return F.coalesce(F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd"), F.lit(""))
