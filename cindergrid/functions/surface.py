"""Vegetation, soil and terrain columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Vegetation and soil codes of the input data, soil layer depths in cm, gravity.
LOW_FUEL = [1, 7, 10, 16, 17, 19]
HIGH_FUEL = [3, 4, 5, 6, 18]
SOIL = {"Non-soil": [0], "Coarse": [1, 2], "Medium": [3, 4, 5], "Organic": [6, 7]}
LAYERS = [7, 28, 100, 289]
TARGET_DEPTHS = 10
GRAVITY = 9.8067


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _member(code: Column, codes: list[int]) -> Column:
    return F.coalesce(code.isin(codes).cast("int"), F.lit(0))


def fuel_low(tvl: Column | str = "tvl") -> Column:
    return _member(_c(tvl), LOW_FUEL)


def fuel_high(tvh: Column | str = "tvh") -> Column:
    return _member(_c(tvh), HIGH_FUEL)


def soil_class(slt: Column | str = "slt") -> Column:
    """Soil class by code, NULL for an unknown code."""
    out = F.lit(None).cast("string")
    for name, codes in SOIL.items():
        out = F.when(_c(slt).isin(codes), name).otherwise(out)
    return out


def depth_weights(layers=tuple(LAYERS), n: int = TARGET_DEPTHS) -> list[list[float]]:
    """Linear interpolation from layer depths to ``n`` even depths, as one weight row per depth.

    Above the first layer its value holds.
    """
    rows = []
    for i in range(n):
        depth = layers[-1] * i / (n - 1)
        row = [0.0] * len(layers)
        below = next(j for j, d in enumerate(layers) if depth <= d)
        if below == 0:
            row[0] = 1.0
        else:
            top, bottom = layers[below - 1], layers[below]
            row[below] = (depth - top) / (bottom - top)
            row[below - 1] = 1.0 - row[below]
        rows.append(row)
    return rows


def at_depths(columns: list[str]) -> list[Column]:
    """The layered quantity at each target depth, as 32-bit floats."""
    out = []
    for row in depth_weights():
        terms = [F.col(c) * F.lit(w) for c, w in zip(columns, row) if w]
        out.append(sum(terms[1:], terms[0]).cast("float"))
    return out


def depth_waterheat() -> dict[str, Column]:
    """Sums of soil water and temperature over the target depths and their ratio at each depth."""
    water = at_depths([f"swvl{i}" for i in range(1, 5)])
    heat = at_depths([f"stl{i}" for i in range(1, 5)])
    features = {"daily_water_sum": sum(water[1:], water[0]), "daily_temp_sum": sum(heat[1:], heat[0])}
    for i, (w, t) in enumerate(zip(water, heat)):
        features[f"surface_water_heat_{i}"] = F.when(t == 0, F.lit(0.0).cast("float")).otherwise(
            F.try_divide(w, t).cast("float"))
    return features


def elevation(z: Column | str = "z") -> Column:
    return _c(z) / GRAVITY
