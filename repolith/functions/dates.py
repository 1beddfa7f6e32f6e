"""Time ranges in questions (Chinese and ISO), as a driver function and a column function."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _month(y: int, m: int) -> tuple[date, date] | None:
    if not (1 <= m <= 12 and 1 <= y <= 9999):
        return None
    return date(y, m, 1), date(y, m, monthrange(y, m)[1])


def _back(day: date, months: int) -> date:
    """The day some months earlier, or that month's last day if it has none."""
    at = day.year * 12 + day.month - 1 - months
    y, m = divmod(at, 12)
    return date(y, m + 1, min(day.day, monthrange(y, m + 1)[1]))


def _year(y: int) -> tuple[date, date] | None:
    return (date(y, 1, 1), date(y, 12, 31)) if y else None


def _months_ago(day: date, n: int) -> tuple[date, date] | None:
    return _month(_back(day, n).year, _back(day, n).month)


# Each rule: a pattern, and the range that it names. The first rule that matches decides.
RULES = [
    (r"(\d{4})-(\d{1,2})(?![\d-])", lambda m, t: _month(int(m[1]), int(m[2]))),
    (r"(\d{4})\s*年", lambda m, t: _year(int(m[1]))),
    (r"^(?:(?!最近).)*?(?<![\d近])(\d{1,2})月份?", lambda m, t: _month(t.year, int(m[1]))),
    (r"去年", lambda m, t: _year(t.year - 1)),
    (r"今年", lambda m, t: _year(t.year)),
    (r"上个?月", lambda m, t: _months_ago(t, 1)),
    (r"[本这]个?月", lambda m, t: _months_ago(t, 0)),
    (r"上半年", lambda m, t: (date(t.year, 1, 1), date(t.year, 6, 30))),
    (r"下半年", lambda m, t: (date(t.year, 7, 1), date(t.year, 12, 31))),
    (r"近(\d{1,5})[天日]", lambda m, t: (t - timedelta(days=int(m[1])), t)),
    (r"近(\d{1,4})周", lambda m, t: (t - timedelta(weeks=int(m[1])), t)),
    (r"近(\d{1,4})个?月", lambda m, t: (_back(t, int(m[1])), t)),
]
COMPILED = [(re.compile(p), f) for p, f in RULES]


def parse_range(question: str | None, today: date) -> tuple[date, date] | None:
    """The first and last day that a question names; None where it names none that exists."""
    for pattern, made in COMPILED:
        if m := pattern.search(question or ""):
            try:
                return made(m, today)
            except (ValueError, OverflowError):
                return None
    return None


def range_of(question: Column, today: date) -> Column:
    """A struct (first, last) of ISO dates for a column of questions; null where there is no range."""

    @F.pandas_udf("first string, last string")
    def made(questions: pd.Series) -> pd.DataFrame:
        found = [parse_range(q, today) for q in questions]
        return pd.DataFrame({"first": [f and f[0].isoformat() for f in found], "last": [f and f[1].isoformat() for f in found]})

    return made(question)
