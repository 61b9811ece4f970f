"""Distance, ground motion and intensity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M, FALLBACK_COLOR, MMI_BAND_LEVELS, MMI_CLASSES, MMI_COLORS, PGA_RANGES_MG


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on a sphere. A spheroid differs by up to about 0.5 %."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def lambert_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the WGS84 spheroid by Lambert's formula with reduced latitudes; metres exact over some 1000 km."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b1, b2 = F.atan(F.tan(F.radians(lat1)) * (1 - f)), F.atan(F.tan(F.radians(lat2)) * (1 - f))
    half = F.pow(F.sin((b2 - b1) / 2), F.lit(2.0)) + F.cos(b1) * F.cos(b2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    sigma = F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * 2
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q) / F.cos(sigma / 2), F.lit(2.0))
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q) / F.sin(sigma / 2), F.lit(2.0))
    return F.when(sigma == 0, 0.0).otherwise((sigma - (x + y) * (f / 2)) * a)


def hypocentral_km(dist_m: Column, depth_m: Column) -> Column:
    return F.greatest(F.sqrt(dist_m * dist_m + depth_m * depth_m) / 1000, F.lit(1e-6))


def site_factor(vs30: Column) -> Column:
    return F.pow(F.lit(10.0), 1.35 - F.log10(vs30) * 0.47)


def bedrock_pga_gal(dist_m: Column, depth_m: Column, mag: Column) -> Column:
    r = hypocentral_km(dist_m, depth_m)
    return F.pow(F.lit(10.0), 0.49 + (mag - 6) * 0.23 - F.log10(r) - r * 0.0027) * 1.385 * 980


def pga_gal(dist_m: Column, depth_m: Column, mag: Column, vs30: Column) -> Column:
    """Peak ground acceleration in gal: attenuation on bedrock times the site's amplification."""
    return bedrock_pga_gal(dist_m, depth_m, mag) * site_factor(vs30)


def pga_to_mmi(pga: Column) -> Column:
    """Modified Mercalli intensity in [1, 10]: two straight pieces over log10 of the acceleration, joined at 5."""
    x = F.log10(F.greatest(pga, F.lit(1e-6)))
    low = x * 2.20 + 1.00
    return F.least(F.greatest(F.when(low <= 5, low).otherwise(x * 3.66 - 1.66), F.lit(1.0)), F.lit(10.0))


def band_of(mmi: Column, surface_max: Column) -> Column:
    """The highest level that ``mmi`` reaches among those below the surface's maximum; null under all."""
    levels = F.array(*[F.lit(x) for x in MMI_BAND_LEVELS])
    return F.array_max(F.filter(levels, lambda x: (x <= mmi) & (x < surface_max)))


def _lookup(level: Column, table: dict, default: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, level), default)


def mmi_class_label(level: Column) -> Column:
    return _lookup(level, {k: f"{r} ({d})" for k, (r, d) in MMI_CLASSES.items()}, level.cast("string"))


def band_color(level: Column) -> Column:
    return _lookup(level, MMI_COLORS, F.lit(FALLBACK_COLOR))


def band_upper(level: Column) -> Column:
    return F.least(level + 1, F.lit(10))


def pga_class(pga: Column) -> Column:
    """The class (1 to 10) whose closed range of mg holds the acceleration; null in the gaps and outside."""
    mg = pga / 0.980665
    out = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(PGA_RANGES_MG, 1):
        out = F.when(mg.between(lo, hi), F.lit(k)).otherwise(out)
    return out
