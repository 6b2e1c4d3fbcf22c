"""Season and date columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Season limits as month * 100 + day, first day of each.
SEASONS = {"Spring": 320, "Summer": 621, "Autumn": 922, "Winter": 1221}
FIRE_SEASONS = [(302, "on_season"), (501, "core_season"), (901, "on_season"), (1001, "off_season")]
MONTH_SEASONS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Fall": [9, 10, 11]}
SEASON_NAMES = sorted(SEASONS)
FIRE_SEASON_NAMES = ["core_season", "off_season", "on_season"]


def month_day(date: Column | str = "date") -> Column:
    return F.month(date) * 100 + F.dayofmonth(date)


def season(date: Column | str = "date") -> Column:
    """Season between solstices and equinoxes (northern hemisphere); Feb 29 is in Winter."""
    day, out = month_day(date), F.lit("Winter")
    for name, first in SEASONS.items():
        out = F.when(day >= first, name).otherwise(out)
    return F.when(day.isNotNull(), out)


def fire_season(date: Column | str = "date") -> Column:
    """``off_season`` Oct 1 - Mar 1, ``core_season`` May 1 - Aug 31, ``on_season`` between them."""
    day, out = month_day(date), F.lit("off_season")
    for first, name in FIRE_SEASONS:
        out = F.when(day >= first, name).otherwise(out)
    return F.when(day.isNotNull(), out)


def month_season(date: Column | str = "date") -> Column:
    out = F.lit(None).cast("string")
    for name, months in MONTH_SEASONS.items():
        out = F.when(F.month(date).isin(months), name).otherwise(out)
    return out


def date_parts(date: Column | str = "date") -> dict[str, Column]:
    return {"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)}


def is_leap_day(date: Column | str = "date") -> Column:
    return month_day(date) == 229


def parse_date(text: Column | str, formats=("yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
                                            "yyyy/MM/dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")) -> Column:
    """Timestamp from text in any of several formats; NULL when none fits."""
    return F.coalesce(*[F.try_to_timestamp(F.col(text) if isinstance(text, str) else text, F.lit(f))
                        for f in formats])
