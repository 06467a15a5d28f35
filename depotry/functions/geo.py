"""Distances and coordinates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depotry.schema import RUPEE, Profile


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, profile: Profile = RUPEE) -> Column:
    """Great-circle km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(p1) * F.cos(p2) * t * t
    if profile.arc == "asin":
        return F.lit(2 * profile.radius_km) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return F.lit(profile.radius_km) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def to_plane(lat: Column, lon: Column, lat0: Column, lon0: Column, profile: Profile = RUPEE) -> tuple[Column, Column]:
    """(x, y) km east and north of an origin on its tangent plane."""
    step = F.radians(F.lit(1.0)) * profile.radius_km
    return (lon - lon0) * step * F.cos(F.radians(lat0)), (lat - lat0) * step


def from_plane(x: Column, y: Column, lat0: Column, lon0: Column, profile: Profile = RUPEE) -> tuple[Column, Column]:
    """(lat, lon) of a point of the tangent plane."""
    step = F.radians(F.lit(1.0)) * profile.radius_km
    return lat0 + y / step, lon0 + x / (step * F.cos(F.radians(lat0)))


def mulberry(seed: int | Column, turn: Column) -> Column:
    """Draw number ``turn`` (from 1) in [0, 1) of the 32-bit generator; a pure function of both, so rows draw in any order."""
    mask = F.lit(0xFFFFFFFF).cast("long")

    def times(a: Column, b: Column) -> Column:
        """Low 32 bits of a product, by 16-bit halves so that nothing overflows."""
        low, high = b.bitwiseAND(F.lit(0xFFFF).cast("long")), F.shiftright(b, 16)
        return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)).bitwiseAND(mask)

    # The generator's increment and shifts.
    start = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    t = (start + turn.cast("long") * F.lit(0x6D2B79F5).cast("long")).bitwiseAND(mask)
    u = times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1).cast("long")))
    v = u.bitwiseXOR((u + times(u.bitwiseXOR(F.shiftright(u, 7)), u.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))
    return v.bitwiseXOR(F.shiftright(v, 14)).bitwiseAND(mask).cast("double") / F.lit(4294967296.0)
