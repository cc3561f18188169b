"""Decision times, session clocks and local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class LookaheadError(AssertionError):
    """A decision at or before the information that it uses."""


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hhmm(text: str) -> int:
    h, m = text.split(":")
    return int(h) * 3600 + int(m) * 60


def session_bucket(ts: Column, opens: str = "09:30", closes: str = "16:00") -> Column:
    t = seconds_of_day(ts)
    return F.when(ts.isNull(), "missing").when(t < hhmm(opens), "pre_open").when(t > hhmm(closes), "after_close").otherwise("intraday")


def decision_intent(ts: Column, has_time: Column, opens: str = "09:30", minutes: int = 75) -> tuple[Column, Column]:
    """(rule, date): the day itself if the event ends before the open at a trusted time, else the next day; null without a time."""
    early = has_time & (seconds_of_day(ts) < hhmm(opens) - 60 * minutes)
    rule = F.when(ts.isNull(), "no_timestamp").when(early, "same_open").otherwise("next_open")
    day = F.to_date(ts)
    return rule, F.when(rule == "same_open", day).when(rule == "next_open", F.date_add(day, 1))


def open_instant(day: Column, zone: str = "US/Eastern", opens: str = "09:30") -> Column:
    local = (F.unix_seconds(F.to_timestamp(day)) + hhmm(opens)).cast("timestamp")
    return F.to_utc_timestamp(local, zone)


def localise(local: Column, zone: str = "US/Eastern") -> Column:
    """UTC of a local time; null where it came twice, moved on to the next full hour where it never came."""
    hour = F.expr("INTERVAL 1 HOUR")
    a, b = F.to_utc_timestamp(local, zone), F.to_utc_timestamp(local + hour, zone)
    return F.when(b > a + hour, None).when(b < a + hour, F.date_trunc("hour", a)).otherwise(a)


def assert_no_lookahead(df: DataFrame, decided: str, known: str) -> DataFrame:
    """df, if every decision comes after what it knows; rows with a null pass."""
    bad = df.filter(F.col(decided) <= F.col(known)).limit(5).collect()
    if bad:
        raise LookaheadError(f"{decided} not after {known}, such as {bad}")
    return df


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), 2))


def cuts(first, last, months: int = 3) -> list:
    """Ends of periods of `months` months from first to last (dates), for walking forward; the last day of each period's last month."""
    import datetime as dt

    out, ym = [], first.year * 12 + (first.month - 1) // months * months + months - 1
    while True:
        after = dt.date((ym + 1) // 12, (ym + 1) % 12 + 1, 1)
        if after - dt.timedelta(1) > last:
            return out
        out.append(after - dt.timedelta(1))
        ym += months


def gap_days(later: Column, earlier: Column) -> Column:
    return F.datediff(F.to_date(later), F.to_date(earlier))
