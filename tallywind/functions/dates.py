"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_date(c: Column) -> Column:
    """F-40: an ISO date or epoch milliseconds; what is neither is null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), F.timestamp_millis(c.try_cast("bigint")).cast("date"))


def period(c: Column, unit: str) -> Column:
    """F-41: the first day of the week (Monday), month or quarter."""
    return F.date_trunc(unit, c).cast("date")


def issue_date(c: Column) -> Column:
    """F-42: `issue: date: February 21, 1998, page: 0038`."""
    return F.to_date(F.regexp_extract(c, r"([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1), "MMMM d, yyyy")


def half_year(c: Column) -> Column:
    """F-43: `1990:1` is January, `1990:2` July."""
    return F.make_date(F.split(c, ":")[0].cast("int"), F.when(F.split(c, ":")[1] == "2", 7).otherwise(1), F.lit(1))


def crisis_token(c: Column, month: int) -> Column:
    """F-44, SRC-28: `yyyy-MM`, or a year that takes a default month; other lengths are an error."""
    ok = F.when(F.length(c).between(4, 7), c).otherwise(F.raise_error(F.concat(F.lit("not a month: "), c)).cast("string"))
    return F.to_date(F.when(F.contains(ok, F.lit("-")), F.concat(ok, F.lit("-01"))).otherwise(F.concat(ok, F.lit(f"-{month:02d}-01"))), "yyyy-M-dd")


def js_date(c: Column) -> Column:
    """F-48: `/Date(ms)/`."""
    return F.timestamp_millis(F.regexp_extract(c, r"/Date\((-?[0-9]+)\)/", 1).try_cast("bigint"))


def month_starts(start: Column, end: Column) -> Column:
    """F-46."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
