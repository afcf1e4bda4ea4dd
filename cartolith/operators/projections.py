"""Coordinate systems: geographic ones, Web Mercator, UTM. Datum shifts are not approximated but refused."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CoordinateSystemError
from ..functions import geometry as g
from ..functions.kernels.geodesic import A, F_
from ..model import FeatureFrame
from ..settings import Extent

#: Codes and the datum that they share; transformations within a datum are exact.
GEOGRAPHIC = {"EPSG:4326": "wgs84", "EPSG:4269": "nad83", "EPSG:4617": "nad83csrs", "EPSG:4171": "rgf93"}
#: Conic systems: kind, datum, standard parallels, origin (latitude, longitude), false easting and northing.
CONIC = {
    "EPSG:3347": ("lambert", "nad83", 49.0, 77.0, 63.390675, -91.86666666666666, 6_200_000.0, 3_000_000.0),
    "EPSG:3978": ("lambert", "nad83", 49.0, 77.0, 49.0, -95.0, 0.0, 0.0),
    "EPSG:2154": ("lambert", "rgf93", 49.0, 44.0, 46.5, 3.0, 700_000.0, 6_600_000.0),
    "EPSG:5070": ("albers", "nad83", 29.5, 45.5, 23.0, -96.0, 0.0, 0.0),
    "EPSG:3005": ("albers", "nad83", 50.0, 58.5, 45.0, -126.0, 1_000_000.0, 0.0),
}
#: UTM zones (north) of the Canadian realisation.
_CSRS = {2955: 11, 2956: 12, 2957: 13, 2958: 17, 2959: 18, 2960: 19, 2961: 20, 2962: 21, 3154: 7, 3155: 8, 3156: 9, 3157: 10, 3158: 14, 3159: 15, 3160: 16}


def _utm(code: str) -> tuple[str, int, bool] | None:
    if zone := _CSRS.get(int(code.split(":")[1]) if code.startswith("EPSG:") and code[5:].isdigit() else -1):
        return "nad83csrs", zone, False
    for pattern, datum, south in ((r"EPSG:326(\d\d)", "wgs84", False), (r"EPSG:327(\d\d)", "wgs84", True), (r"EPSG:269(\d\d)", "nad83", False)):
        found = re.fullmatch(pattern, code)
        if found and 1 <= int(found[1]) <= 60:
            return datum, int(found[1]), south
    return None


def normal(code) -> str:
    """``4326``, ``epsg:4326`` and ``EPSG:4326`` are one."""
    text = str(code).strip().upper()
    return text if ":" in text else f"EPSG:{text}"


def datum(code: str) -> str:
    code = normal(code)
    if code in GEOGRAPHIC:
        return GEOGRAPHIC[code]
    if code == "EPSG:3857":
        return "wgs84"
    if code in CONIC:
        return CONIC[code][1]
    if found := _utm(code):
        return found[0]
    raise CoordinateSystemError(f"unsupported coordinate system {code}")


def is_geographic(code: str | None) -> bool:
    return code is not None and normal(code) in GEOGRAPHIC


# Krueger series for the transverse Mercator projection
_N = F_ / (2 - F_)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * math.sqrt(_N) / (1 + _N)


_E2 = F_ * (2 - F_)


def _t(s, m):
    """The isometric part of a latitude with sine ``s``: exp of the negative isometric latitude."""
    return m.exp(_E * m.atanh(_E * s) - m.atanh(s))


def _q(s, m):
    """The authalic part of a latitude with sine ``s``."""
    return (1 - _E2) * (s / (1 - _E2 * s * s) + m.atanh(_E * s) / _E)


def _cone(code: str):
    """Constants of a conic: exponent, scale, and radius of the origin."""
    kind, _, p1, p2, lat0, _, _, _ = CONIC[code]
    s1, s2, s0 = (math.sin(math.radians(v)) for v in (p1, p2, lat0))
    m1, m2 = (math.cos(math.radians(v)) / math.sqrt(1 - _E2 * math.sin(math.radians(v)) ** 2) for v in (p1, p2))
    if kind == "lambert":
        n = math.log(m1 / m2) / math.log(_t(s1, _Floats) / _t(s2, _Floats))
        f = m1 / (n * _t(s1, _Floats) ** n)
        return n, f, A * f * _t(s0, _Floats) ** n
    n = (m1 * m1 - m2 * m2) / (_q(s2, _Floats) - _q(s1, _Floats))
    c = m1 * m1 + n * _q(s1, _Floats)
    return n, c, A * math.sqrt(c - n * _q(s0, _Floats)) / n


def _to_conic(code: str, lon, lat, m):
    kind, _, _, _, _, lon0, fe, fn = CONIC[code]
    n, c, r0 = _cone(code)
    s = m.sin(lat * (math.pi / 180))
    r = A * c * _t(s, m) ** n if kind == "lambert" else A / n * (c - n * _q(s, m)) ** 0.5
    theta = (lon - lon0) * (n * math.pi / 180)
    return r * m.sin(theta) + fe, r0 - r * m.cos(theta) + fn


def _from_conic(code: str, x, y, m):
    kind, _, _, _, _, lon0, fe, fn = CONIC[code]
    n, c, r0 = _cone(code)
    dx, dy = x - fe, (y - fn) * -1 + r0
    r2 = dx * dx + dy * dy
    lon = m.atan2(dx, dy) * (180 / math.pi / n) + lon0
    if kind == "lambert":
        aux = math.pi / 2 - m.atan((r2 ** 0.5 * (1 / (A * c))) ** (1 / n)) * 2  # the conformal latitude
        series = _DELTA
    else:
        aux = m.asin((r2 * (-n * n / (A * A)) + c) * (1 / (n * _q(1.0, _Floats))))  # the authalic latitude
        series = (_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780, 761 * _E2**3 / 45360)
    lat = aux
    for k, d in enumerate(series, 1):
        lat = lat + d * m.sin(2 * k * aux)
    return lon, lat * (180 / math.pi)


class _Columns:
    sin, cos, tan, atan, atan2, sinh, cosh, atanh, asin, exp, log, where = F.sin, F.cos, F.tan, F.atan, F.atan2, F.sinh, F.cosh, F.atanh, F.asin, F.exp, F.log, staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))


class _Floats:
    sin, cos, tan, atan, atan2, sinh, cosh, atanh, asin, exp, log = math.sin, math.cos, math.tan, math.atan, math.atan2, math.sinh, math.cosh, math.atanh, math.asin, math.exp, math.log


def _forward(code: str, lon, lat, m):
    """From degrees to the projected system; ``m`` gives the functions, for columns or for floats."""
    rad = math.pi / 180
    if code == "EPSG:3857":
        return lon * (A * rad), A * m.log(m.tan(lat * (rad / 2) + math.pi / 4))
    if code in CONIC:
        return _to_conic(code, lon, lat, m)
    _, zone, south = _utm(code)
    lam = (lon - (zone * 6 - 183)) * rad
    s = m.sin(lat * rad)
    t = m.sinh(m.atanh(s) - _E * m.atanh(_E * s))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / (1 + t * t) ** 0.5)
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + a * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        y = y + a * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
    return x * (0.9996 * _RADIUS) + 500_000, y * (0.9996 * _RADIUS) + (10_000_000 if south else 0)


def _backward(code: str, x, y, m):
    deg = 180 / math.pi
    if code == "EPSG:3857":
        return x * (deg / A), m.atan(m.exp(y * (1 / A))) * (2 * deg) - 90
    if code in CONIC:
        return _from_conic(code, x, y, m)
    _, zone, south = _utm(code)
    xi = (y - (10_000_000 if south else 0)) * (1 / (0.9996 * _RADIUS))
    eta = (x - 500_000) * (1 / (0.9996 * _RADIUS))
    u, v = xi, eta
    for k, b in enumerate(_BETA, 1):
        u = u - b * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
        v = v - b * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
    chi = m.asin(m.sin(u) / m.cosh(v))
    lat = chi
    for k, d in enumerate(_DELTA, 1):
        lat = lat + d * m.sin(2 * k * chi)
    return m.atan2(m.sinh(v), m.cos(u)) * deg + (zone * 6 - 183), lat * deg


def transform(source: str, target: str, x, y, floats: bool = False):
    """Coordinates of one system in another, as columns or as floats."""
    source, target = normal(source), normal(target)
    if datum(source) != datum(target):
        raise CoordinateSystemError(f"no transformation from {source} to {target} without a datum shift")
    m = _Floats if floats else _Columns
    if source == target:
        return x, y
    if source not in GEOGRAPHIC:
        x, y = _backward(source, x, y, m)
    return (x, y) if target in GEOGRAPHIC else _forward(target, x, y, m)


def bounds_in(extent: Extent, crs: str | None) -> tuple[float, float, float, float]:
    """The bounds of an extent in another system (of its four corners and the middles of its sides)."""
    if not extent.crs or not crs or normal(extent.crs) == normal(crs):
        return extent.xmin, extent.ymin, extent.xmax, extent.ymax
    xs, ys = (extent.xmin, (extent.xmin + extent.xmax) / 2, extent.xmax), (extent.ymin, (extent.ymin + extent.ymax) / 2, extent.ymax)
    found = [transform(extent.crs, crs, x, y, floats=True) for x in xs for y in ys]
    return min(x for x, _ in found), min(y for _, y in found), max(x for x, _ in found), max(y for _, y in found)


def project(source: FeatureFrame, coordinate_system: str, transform_: str | None = None) -> FeatureFrame:
    """Every vertex in another coordinate system, in Catalyst expressions; features that become invalid go."""
    if source.meta.crs is None:
        raise CoordinateSystemError("the layer has no coordinate system")
    target = normal(coordinate_system)

    def move(v: Column) -> Column:
        x, y = transform(source.meta.crs, target, v["x"], v["y"])
        return g.vertex(x, y, v["z"], v["m"])

    geom = source.meta.geom
    moved = F.transform(source.geom, lambda p: F.transform(p, lambda r: F.transform(r, move)))
    df = source.df.drop("bbox").withColumn(geom, moved)
    bad = F.exists(g.vertices(F.col(geom)), lambda v: F.isnan(v["x"]) | F.isnan(v["y"]) | (F.abs(v["x"]) == float("inf")) | (F.abs(v["y"]) == float("inf")))
    return source.with_df(df.where(~g.is_empty(F.col(geom)) & ~bad), crs=target, rectangles=False)


def define_projection(source: FeatureFrame, coordinate_system: str) -> FeatureFrame:
    """Another label; coordinates stay."""
    target = normal(coordinate_system)
    datum(target)
    return source.with_df(source.df, crs=target)
