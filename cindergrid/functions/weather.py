"""Weather columns. All functions take and return columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZERO_C = 273.15


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def celsius(kelvin: Column | str, offset: float = 0.0) -> Column:
    return _c(kelvin) - ZERO_C + offset


def millimetres(metres: Column | str) -> Column:
    return _c(metres) * 1000


def _saturation(t: Column) -> Column:
    return F.exp(17.625 * t / (243.04 + t))


def humidity_from_celsius(temp: Column | str, dew: Column | str) -> Column:
    """Relative humidity in percent (Magnus form) from temperature and dew point in Celsius."""
    return 100 * (_saturation(_c(dew)) / _saturation(_c(temp)))


def relative_humidity(t2: Column | str = "`2t`", d2: Column | str = "`2d`") -> Column:
    """Relative humidity in percent from temperature and dew point in Kelvin."""
    return humidity_from_celsius(celsius(t2), celsius(d2))


def atmospheric_dryness(t2: Column | str = "`2t`", d2: Column | str = "`2d`") -> Column:
    """Spread between temperature and dew point."""
    return _c(t2) - _c(d2)


def wind_speed(u: Column | str = "`10u`", v: Column | str = "`10v`") -> Column:
    """Wind speed in km/h from components in m/s."""
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v)) * 3.6


def temp_humidity(t2: Column | str, humidity: Column | str) -> Column:
    return _c(t2) * _c(humidity)


def lightning_product(count="lightning_count", strength="absv_strength_sum") -> Column:
    return _c(count) * _c(strength)


def lightning_ratio(count="lightning_count", strength="absv_strength_sum") -> Column:
    """Mean strength per strike, 0 where nothing struck."""
    return F.coalesce(F.try_divide(_c(strength), _c(count)), F.lit(0.0))


def fire_index_inputs(temp_offset: float = 0.0) -> dict[str, Column]:
    """Standard names and units for the fire-weather codes from raw reanalysis columns."""
    t, d = celsius("`2t`", temp_offset), celsius("`2d`", temp_offset)
    return {"temp_c": t, "humidity": humidity_from_celsius(t, d), "wind_kmh": wind_speed(),
            "rain_mm": millimetres("tp")}
