"""Holidays by rule: fixed dates, days relative to Easter, bridges and long weekends."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (month, day) and days after Easter Sunday of the public holidays of a country.
CALENDARS = {
    "CH": (((1, 1), (8, 1), (12, 25)), (39,)),
    "DE": (((1, 1), (5, 1), (10, 3), (12, 25), (12, 26)), (-2, 1, 39, 50)),
    "FR": (((1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)), (1, 39, 50)),
    "IT": (((1, 1), (1, 6), (4, 25), (5, 1), (6, 2), (8, 15), (11, 1), (12, 8), (12, 25), (12, 26)), (1,)),
}

# What a part of a country has besides, in the same form.
PARTS = {
    ("CH", "TI"): (((1, 6), (3, 19), (5, 1), (6, 29), (8, 15), (11, 1), (12, 8), (12, 26)), (1, 50, 60)),
    ("CH", "ZH"): (((5, 1), (12, 26)), (-2, 1, 50)),
    ("DE", "BW"): (((1, 6), (11, 1)), (60,)),
    ("DE", "BY"): (((1, 6), (8, 15), (11, 1)), (60,)),
    ("DE", "HE"): ((), (60,)),
    ("DE", "NW"): (((11, 1),), (60,)),
    ("DE", "RP"): (((11, 1),), (60,)),
    ("DE", "SL"): (((8, 15), (11, 1)), (60,)),
}


def easter(year: int) -> date:
    """The Sunday after the full moon of the Gregorian computus."""
    golden, century = year % 19, year // 100
    epact = (19 * golden + century - century // 4 - (8 * century + 13) // 25 + 15) % 30
    moon = epact - (epact // 28) * (1 - (29 // (epact + 1)) * ((21 - golden) // 11))
    shift = moon - (year + year // 4 + moon + 2 - century + century // 4) % 7
    month = 3 + (shift + 40) // 44
    return date(year, month, shift + 28 - 31 * (month // 4))


def codes(country: str, first: date, last: date, part: str | None = None) -> dict[date, int]:
    """3 a holiday; 2 a weekend day next to one; 1 a bridge: a working day between days off, one of them a holiday's. Others have no entry."""
    fixed, moving = CALENDARS[country]
    if part is not None:
        fixed, moving = (own + more for own, more in zip(CALENDARS[country], PARTS[country, part], strict=True))
    free = {date(y, m, d) for y in range(first.year - 1, last.year + 2) for m, d in fixed} | {easter(y) + timedelta(k) for y in range(first.year - 1, last.year + 2) for k in moving}
    off = lambda d: d in free or d.weekday() > 4
    out = {}
    for k in range((last - first).days + 1):
        d = first + timedelta(k)
        near = [d + timedelta(s) for s in (-1, 1)]
        if d in free:
            out[d] = 3
        elif d.weekday() > 4:
            weekend = [d - timedelta(d.weekday() - 5), d - timedelta(d.weekday() - 6)]
            if any(x in free for x in (weekend[0] - timedelta(1), weekend[1] + timedelta(1), *weekend)):
                out[d] = 2
        elif all(map(off, near)) and any(x in free for x in near):
            out[d] = 1
    return out


def add_holidays(df: DataFrame, country: str = "CH", *, part: str | None = None, ts: str = "ts") -> DataFrame:
    """Column ``holiday``: 0 none, 1 bridge, 2 long weekend, 3 holiday. The calendar has a row a special day of the span, so it is small by nature."""
    lo, hi = df.agg(F.to_date(F.min(ts)), F.to_date(F.max(ts))).first()
    if lo is None:
        return df.withColumn("holiday", F.lit(0))
    days = codes(country, lo - timedelta(2), hi + timedelta(2), part)
    calendar = df.sparkSession.createDataFrame([*days.items()] or [(date(1, 1, 1), 0)], "_day date, holiday int")
    return df.withColumn("_day", F.to_date(ts)).join(F.broadcast(calendar), "_day", "left").withColumn("holiday", F.coalesce("holiday", F.lit(0))).drop("_day")
