"""Small column helpers: cleaning, thresholds, risk classes, payload parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Limits of the displayed risk classes; feature-point payload; tag rules.
RISK_BOUNDS = [0.05, 0.15, 0.25, 0.35, 0.45, 0.6]
ELEMENTS = "struct<elements: array<struct<lat: double, lon: double, center: struct<lat: double, lon: double>>>>"
TAG_RULES = {
    "railway": ("railway", "^rail$"),
    "power_line": ("power", "^line$"),
    "highway": ("highway", "^(motorway|trunk|primary|secondary)$"),
    "aeroway": ("aeroway", "^aerodrome$"),
    "waterway": ("waterway", None),
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite_or_zero(x: Column | str) -> Column:
    """NaN, infinities and NULL become 0."""
    x = _c(x).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(x)


def over_threshold(p: Column | str, threshold: float = 0.515, inclusive: bool = False) -> Column:
    return ((_c(p) >= threshold) if inclusive else (_c(p) > threshold)).cast("int")


def risk_class(p: Column | str, bounds: Sequence[float] = tuple(RISK_BOUNDS)) -> Column:
    """Class 0 below the first bound up to ``len(bounds)`` from the last; a bound opens its class."""
    p = _c(p)
    return sum([(p >= b).cast("int") for b in bounds[1:]], (p >= bounds[0]).cast("int"))


def round_coordinate(x: Column | str) -> Column:
    return F.round(_c(x), 2)


def tag_category(tags: Column | str) -> dict[str, Column]:
    """Whether a tags map matches each feature category."""
    out = {}
    for name, (tag, pattern) in TAG_RULES.items():
        value = _c(tags)[tag]
        out[name] = F.coalesce(value.rlike(pattern), F.lit(False)) if pattern else value.isNotNull()
    return out


def categories_of_tags(tags: Column | str) -> Column:
    """All categories a tags map belongs to."""
    flags = tag_category(tags)
    return F.array_compact(F.array(*[F.when(flag, name) for name, flag in flags.items()]))


def element_points(payload: Column | str) -> Column:
    """``array<struct<lat, lon>>`` of a JSON payload: own coordinates, else the centre, else skipped."""
    items = F.from_json(_c(payload), ELEMENTS)["elements"]
    points = F.transform(items, lambda e: F.when(
        e["lat"].isNotNull() & e["lon"].isNotNull(), F.struct(e["lat"].alias("lat"), e["lon"].alias("lon"))
    ).otherwise(F.struct(e["center"]["lat"].alias("lat"), e["center"]["lon"].alias("lon"))))
    return F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def strip_suffix(text: Column | str, suffix: str) -> Column:
    text = _c(text)
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)
