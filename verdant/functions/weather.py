"""Weather expressions: reference evapotranspiration and solar geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reference_et0(mean: Column, high: Column, low: Column, radiation: Column) -> Column:
    """Temperature-based evapotranspiration, mm per day."""
    spread = F.greatest(F.lit(1.0), high - low)
    return 0.0023 * (mean + 17.8) * F.sqrt(spread) * (radiation * 0.408)


def solar_radiation(latitude: Column, day: Column) -> Column:
    """Extraterrestrial radiation for a latitude in degrees and a day of the year, within [10, 45]."""
    turn = F.lit(2 * math.pi / 365) * day
    phi = F.radians(latitude)
    declination = 0.409 * F.sin(turn - 1.39)
    cos_sunset = -F.tan(phi) * F.tan(declination)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_sunset)))
    distance = 1.0 + 0.033 * F.cos(turn)
    daily = sunset * F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.sin(sunset)
    radiation = F.lit(24 * 60 / math.pi) * 0.0820 * distance * daily
    return F.greatest(F.lit(10.0), F.least(F.lit(45.0), radiation))
