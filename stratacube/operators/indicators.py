"""Derived daily and hourly indicators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the hourly reference evapotranspiration equation.
LATENT_HEAT, SPECIFIC_HEAT, MOLECULAR_RATIO = 2.45, 1.013e-3, 0.622
NIGHT = {"cd": 0.24, "soil": 0.1}
DAY = {"cd": 0.96, "soil": 0.5}


def water_balance(tp_m: Column, pet_mm: Column) -> Column:
    """Rain in m/day to mm/day, plus the (negative) evapotranspiration."""
    return tp_m * 1e3 + pet_mm


def reference_evapotranspiration(t2m: Column, u10: Column, v10: Column, sp: Column, snr: Column, vpd: Column, lsm: Column, night: dict = NIGHT, day: dict = DAY) -> Column:
    """Hourly Penman-Monteith reference evapotranspiration in mm, as an upward (negative or zero) flux.

    K, m/s, m/s, Pa, J/m2, hPa, land share.  Hours of negative net radiation use the ``night`` constants.  Null
    where any input is null.
    """
    t = t2m - 273.15
    wind = F.sqrt(u10 * u10 + v10 * v10) * F.lit(4.87) / F.log(F.lit(67.8 * 10 - 5.42))
    rn, kpa, deficit = snr / 1e6, sp / 1000.0, vpd / 10.0
    dark = rn < 0.0
    ground = F.when(lsm > 0.5, F.when(dark, rn * night["soil"]).otherwise(rn * day["soil"])).otherwise(0.0)
    cd = F.when(dark, F.lit(night["cd"])).otherwise(day["cd"])
    gamma = kpa * SPECIFIC_HEAT / (MOLECULAR_RATIO * LATENT_HEAT)
    slope = F.lit(4098.0) * (F.lit(0.6108) * F.exp(t * 17.27 / (t + 237.3))) / ((t + 237.3) * (t + 237.3))
    et = (F.lit(0.408) * slope * (rn - ground) + gamma * (F.lit(37.0) / (t + 273.0)) * wind * deficit) / (slope + gamma * (F.lit(1.0) + cd * wind))
    some_null = t2m.isNull() | u10.isNull() | v10.isNull() | sp.isNull() | snr.isNull() | vpd.isNull() | lsm.isNull()
    return F.when(~some_null, -F.greatest(F.lit(0.0), et))
