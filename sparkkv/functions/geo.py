"""Distances, geohash cells and boxes on a sphere, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in metres, and the geohash alphabet.
EARTH_RADIUS = 6_371_000.0
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """The cell's name, in closed form: both coordinates as whole numbers of halved ranges, whose bits alternate, longitude first."""
    if not 1 <= precision <= 12:
        raise ValueError("precision is 1 to 12")
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2

    def steps(x: Column, low: float, span: float, n: int) -> Column:
        return F.least(F.floor((x - low) / span * float(1 << n)), F.lit((1 << n) - 1)).cast("long")

    x, y = steps(lon, -180.0, 360.0, n_lon), steps(lat, -90.0, 180.0, n_lat)

    def bit(i: int) -> Column:
        """The i-th bit from the left."""
        source, n = (x, n_lon) if i % 2 == 0 else (y, n_lat)
        return F.shiftright(source, n - 1 - i // 2).bitwiseAND(F.lit(1).cast("long"))

    chars = []
    for c in range(precision):
        place = sum((bit(5 * c + k) * (16 >> k) for k in range(1, 5)), bit(5 * c) * 16)
        chars.append(F.substring(F.lit(ALPHABET), place.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Edges included. A box does not reach over the 180th meridian."""
    return lat.between(south, north) & lon.between(west, east)


def near_box(lat: Column, lon: Column, centre_lat: float, centre_lon: float, metres: float) -> Column:
    """A box that holds every point within the distance: plain comparisons, which reach the scan."""
    import math

    d = math.degrees(metres / EARTH_RADIUS) * 1.000001 + 1e-9
    box = lat.between(centre_lat - d, centre_lat + d)
    top = max(abs(centre_lat - d), abs(centre_lat + d))
    if top >= 90:
        return box
    w = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(d, 90))) / math.cos(math.radians(centre_lat))))) * 1.000001 + 1e-9
    if w >= 180 or centre_lon - w < -180 or centre_lon + w > 180:
        return box
    return box & lon.between(centre_lon - w, centre_lon + w)
