"""Coordinates: areas of interest, UTM zones and projections as column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Box(NamedTuple):
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def __str__(self) -> str:
        return ",".join(str(v) for v in self)


def _positions(shape: Any) -> list[tuple[float, float]]:
    if isinstance(shape, dict):
        kind = shape.get("type")
        if kind == "FeatureCollection":
            return [p for f in shape["features"] for p in _positions(f)]
        if kind == "Feature":
            return _positions(shape["geometry"])
        if kind == "GeometryCollection":
            return [p for g in shape["geometries"] for p in _positions(g)]
        return _positions(shape["coordinates"])
    if shape and isinstance(shape[0], (int, float)):
        return [(float(shape[0]), float(shape[1]))]
    return [p for part in shape for p in _positions(part)]


def area_of_interest(what: str | Sequence[float] | dict | DataFrame) -> Box:
    """Bounding box of four numbers, of their text, of GeoJSON (as a dict or a local file), or of a table with x and y."""
    if isinstance(what, DataFrame):
        return Box(*what.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())
    if isinstance(what, dict):
        xs, ys = zip(*_positions(what))
        return Box(min(xs), min(ys), max(xs), max(ys))
    if isinstance(what, str):
        if what.lower().endswith((".geojson", ".json")):
            with open(what, encoding="utf-8") as f:
                return area_of_interest(json.load(f))
        what = [float(x) for x in what.split(",")]
    if isinstance(what, Sequence) and len(what) == 4:
        return Box(*map(float, what))
    raise TypeError("an area of interest is a box, its text, GeoJSON or a table of points")


def utm_zone(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone, as text; latitudes beyond 80 S and 84 N are an error."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    code = F.when(lat >= 0, F.format_string("EPSG:326%02d", zone)).otherwise(F.format_string("EPSG:327%02d", zone))
    return F.when((lat >= -80) & (lat <= 84), code).otherwise(F.raise_error(F.concat(F.lit("no UTM zone at latitude "), lat.cast("string"))))


def utm_code(lat: float, lon: float) -> str:
    if not -80 <= lat <= 84:
        raise ValueError(f"no UTM zone at latitude {lat}")
    return f"EPSG:{326 if lat >= 0 else 327}{int((lon + 180) / 6) + 1:02d}"


#: Fixed values of WGS 84 and UTM.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _zone(epsg: int | Column) -> tuple[float | Column, float | Column]:
    if isinstance(epsg, Column):
        known = epsg.between(32601, 32660) | epsg.between(32701, 32760)
        code = F.when(known | epsg.isNull(), epsg).otherwise(F.raise_error(F.concat(F.lit("EPSG:"), epsg.cast("string"), F.lit(" is not a UTM zone"))).cast("int"))
        return F.radians((code % 100) * 6 - 183), F.when(code >= 32700, 1e7).otherwise(0.0)
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"EPSG:{epsg} is not a UTM zone")
    return math.radians((epsg % 100) * 6 - 183), 1e7 if epsg >= 32700 else 0.0


def to_utm(lon: Column, lat: Column, epsg: int | Column) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series, to well under a millimetre within the zone."""
    mid, north = _zone(epsg)
    e = 2 * math.sqrt(_N) / (1 + _N)
    s, dl = F.sin(F.radians(lat)), F.radians(lon) - mid
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + _K0 * _R * x, north + _K0 * _R * y


def from_utm(x: Column, y: Column, epsg: int | Column) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM point."""
    mid, north = _zone(epsg)
    xi, eta = (y - north) / (_K0 * _R), (x - 500_000) / (_K0 * _R)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u)) + mid), F.degrees(lat)


def reproject(points: DataFrame, source: int | Column, target: int | Column) -> DataFrame:
    """Points (x, y) from one EPSG code to another: the same, WGS 84 (4326) or UTM. A column gives each point its own UTM code."""
    fixed = lambda code: None if isinstance(code, Column) else code
    if source is target or fixed(source) is not None and fixed(source) == fixed(target):
        return points
    lon, lat = (F.col("x"), F.col("y")) if fixed(source) == 4326 else from_utm(F.col("x"), F.col("y"), source)
    x, y = (lon, lat) if fixed(target) == 4326 else to_utm(lon, lat, target)
    return points.withColumns({"x": x, "y": y})
