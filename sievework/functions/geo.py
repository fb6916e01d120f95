"""Projection parameters, inverse transverse Mercator, boxes and rings."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the projection text.
DEFAULT_AXIS = 6378137.0
DEFAULT_INV_FLATTENING = 298.257222101
DEFAULT_SCALE = 0.9996
VIEW_PADDING = 0.3
_DEG = pi / 180


def projection_of(wkt: Column) -> Column:
    """Projection parameters from the text of a ``.prj`` part.

    ``kind`` is ``tmerc`` or ``geographic``; null when it is neither.
    """
    number = r"\s*,\s*(-?[0-9.eE+]+)"

    def parameter(name: str) -> Column:
        return F.regexp_extract(wkt, rf'(?i)PARAMETER\s*\[\s*"{name}"{number}', 1).try_cast("double")

    spheroid = r'(?i)SPHEROID\s*\[\s*"[^"]*"\s*,\s*([0-9.eE+]+)\s*,\s*([0-9.eE+]+)'
    axis = F.regexp_extract(wkt, spheroid, 1).try_cast("double")
    inverse = F.regexp_extract(wkt, spheroid, 2).try_cast("double")
    lon0 = F.coalesce(parameter("central_meridian"), parameter("longitude_of_center"))
    projected = wkt.rlike("(?i)PROJCS")
    transverse = projected & wkt.rlike("(?i)Transverse_Mercator") & lon0.isNotNull()
    kind = F.when(transverse, "tmerc").when(~projected & wkt.rlike("(?i)GEOGCS"), "geographic")
    return F.when(kind.isNotNull(), F.struct(
        kind.alias("kind"), F.coalesce(axis, F.lit(DEFAULT_AXIS)).alias("a"),
        F.coalesce(F.when(inverse > 0, inverse), F.lit(DEFAULT_INV_FLATTENING)).alias("inv_flattening"),
        lon0.alias("lon0"), F.coalesce(parameter("scale_factor"), F.lit(DEFAULT_SCALE)).alias("k0"),
        F.coalesce(parameter("false_easting"), F.lit(0.0)).alias("false_easting"),
        F.coalesce(parameter("false_northing"), F.lit(0.0)).alias("false_northing")))


def projection_name(wkt: Column) -> Column:
    name = F.regexp_extract(wkt, r'(?i)^\s*(?:PROJCS|GEOGCS)\s*\[\s*"([^"]+)"', 1)
    return F.when(name != "", F.replace(name, F.lit("_"), F.lit(" ")))


def ellipsoid_columns(p: Column) -> dict[str, Column]:
    """First stage of the inverse projection: constants of the ellipsoid."""
    f = F.lit(1.0) / p["inv_flattening"]
    e2 = f * 2 - f * f
    root = F.sqrt(F.lit(1.0) - e2)
    return {"e2": e2, "n": (F.lit(1.0) - root) / (root + 1)}


def inverse_mercator(df, projection: str, x: str, y: str):
    """Adds ``lon`` and ``lat`` (degrees) to a table of projected points.

    The series of the transverse Mercator inverse, laid out as a chain of
    projections so that each intermediate is computed once per row.
    """
    p = F.col(projection)
    c = F.col
    kept = df.columns
    s1 = df.withColumns({f"__{k}": v for k, v in ellipsoid_columns(p).items()})
    e2, n = c("__e2"), c("__n")
    s2 = s1.withColumns({
        "__ep2": e2 / (F.lit(1.0) - e2),
        "__mu": ((c(y) - p["false_northing"]) / p["k0"])
        / (p["a"] * (F.lit(1.0) - e2 / 4 - e2 * e2 * 3 / 64 - e2 * e2 * e2 * 5 / 256)),
    })
    mu = c("__mu")
    foot = (
        mu + (n * 3 / 2 - n * n * n * 27 / 32) * F.sin(mu * 2)
        + (n * n * 21 / 16 - n * n * n * n * 55 / 32) * F.sin(mu * 4)
        + (n * n * n * 151 / 96) * F.sin(mu * 6) + (n * n * n * n * 1097 / 512) * F.sin(mu * 8)
    )
    s3 = s2.withColumn("__foot", foot)
    s4 = s3.withColumns({
        "__c": c("__ep2") * F.cos("__foot") * F.cos("__foot"),
        "__t": F.tan("__foot") * F.tan("__foot"),
        "__w": F.lit(1.0) - e2 * F.sin("__foot") * F.sin("__foot"),
    })
    s5 = s4.withColumns({
        "__nu": p["a"] / F.sqrt("__w"),
        "__rho": p["a"] * (F.lit(1.0) - e2) / (c("__w") * F.sqrt("__w")),
    })
    s6 = s5.withColumn("__d", (c(x) - p["false_easting"]) / (c("__nu") * p["k0"]))
    d, t, q, ep2 = c("__d"), c("__t"), c("__c"), c("__ep2")
    d2 = d * d
    lat = c("__foot") - (c("__nu") * F.tan("__foot") / c("__rho")) * (
        d2 / 2
        - (t * 3 + 5 + q * 10 - q * q * 4 - ep2 * 9) * d2 * d2 / 24
        + (t * 90 + 61 + q * 298 + t * t * 45 - ep2 * 252 - q * q * 3) * d2 * d2 * d2 / 720
    )
    lon = p["lon0"] * _DEG + (
        d - (t * 2 + 1 + q) * d2 * d / 6
        + (F.lit(5.0) - q * 2 + t * 28 - q * q * 3 + ep2 * 8 + t * t * 24) * d2 * d2 * d / 120
    ) / F.cos("__foot")
    geographic = p["kind"] == "geographic"
    return s6.withColumns({
        "lon": F.when(geographic, c(x)).otherwise(lon / _DEG),
        "lat": F.when(geographic, c(y)).otherwise(lat / _DEG),
    }).select(*kept, "lon", "lat")


def is_plausible(lon: Column, lat: Column) -> Column:
    return F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def box_contains(outer: Column, inner: Column) -> Column:
    """Boxes are structs of west, south, east, north."""
    return (
        (outer["west"] <= inner["west"]) & (outer["south"] <= inner["south"])
        & (outer["east"] >= inner["east"]) & (outer["north"] >= inner["north"])
    )


def pad_box(box: Column, factor: float = VIEW_PADDING) -> Column:
    dx = (box["east"] - box["west"]) * factor
    dy = (box["north"] - box["south"]) * factor
    return F.struct(
        (box["west"] - dx).alias("west"), F.greatest(F.lit(-90.0), box["south"] - dy).alias("south"),
        (box["east"] + dx).alias("east"), F.least(F.lit(90.0), box["north"] + dy).alias("north"))


def signed_area(ring: Column) -> Column:
    """Signed area of a ring of (x, y) points; negative marks a hole."""
    n = F.size(ring)
    previous = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, n - 1))
    terms = F.zip_with(ring, previous, lambda p, q: (q["x"] - p["x"]) * (q["y"] + p["y"]))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / 2)
