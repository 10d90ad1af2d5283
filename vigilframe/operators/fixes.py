"""Where lines of sight cross: least squares over any number of rays, refusals as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import sets


def _direction(lat, lon, bearing, ref_lon) -> tuple[Column, Column]:
    theta = F.radians(bearing - geo.convergence(lat, lon, ref_lon))
    return F.sin(theta), F.cos(theta)


def cross(rays: DataFrame, key: str, min_angle: float = geo.MIN_CROSSING_DEG) -> DataFrame:
    """One row per key of rays (key, camera_id, lat, lon, bearing, sigma, range_m): refusal (null, or the first of
    TOO_FEW_RAYS, RAYS_TOO_PARALLEL, SINGULAR, BEHIND_CAMERA, BEYOND_RANGE), n_rays and, where not refused, lat, lon,
    residual_m, semi_major_m, semi_minor_m, crossing_deg.

    Normal equations are sums, and of lines sorted around the half circle the closest two are neighbours, so no key's rays
    are brought together in one row, nor paired.
    """
    half = F.pmod("bearing", F.lit(180.0))
    near = rays.withColumn("half", half).withColumn("gap", F.col("half") - F.lag("half").over(Window.partitionBy(key).orderBy("half")))
    ref = near.groupBy(key).agg(F.count("*").alias("n_rays"), F.avg("lat").alias("ref_lat"), F.avg("lon").alias("ref_lon"), F.least(F.min("gap"), F.min("half") + 180.0 - F.max("half")).alias("crossing_deg"))
    ref = ref.withColumn("crossing_deg", F.when(F.col("n_rays") > 1, F.col("crossing_deg")))
    r = rays.join(ref, key)
    ox, oy = geo.enu(*map(F.col, ("lat", "lon", "ref_lat", "ref_lon")))
    dx, dy = _direction(*map(F.col, ("lat", "lon", "bearing", "ref_lon")))
    r = r.withColumns({"ox": ox, "oy": oy, "dx": dx, "dy": dy, "w": 1.0 / F.greatest("sigma", F.lit(0.05))})
    c = F.col("dy") * F.col("ox") - F.col("dx") * F.col("oy")
    sums = r.groupBy(key).agg(F.sum(F.expr("w * dy * dy")).alias("a"), F.sum(F.expr("-w * dy * dx")).alias("b"), F.sum(F.expr("w * dx * dx")).alias("d"), F.sum(F.col("w") * F.col("dy") * c).alias("p"), F.sum(-F.col("w") * F.col("dx") * c).alias("q"))
    sums = sums.withColumn("det", F.expr("a * d - b * b"))
    sums = sums.withColumns({"east": F.when(F.abs("det") >= 1e-9, F.expr("(p * d - b * q) / det")), "north": F.when(F.abs("det") >= 1e-9, F.expr("(a * q - p * b) / det"))}).select(key, "det", "east", "north")
    r = r.join(sums, key).withColumns({"along": F.expr("(east - ox) * dx + (north - oy) * dy"), "off": F.expr("(east - ox) * dy - (north - oy) * dx")})
    wide = F.tan(F.radians("sigma")) * F.col("along")
    bad = F.when(F.col("along") <= 0, "BEHIND_CAMERA").when(F.col("along") > F.col("range_m"), "BEYOND_RANGE")
    out = r.groupBy(key).agg(*(F.first(x).alias(x) for x in ("n_rays", "ref_lat", "ref_lon", "crossing_deg", "det", "east", "north")), F.min_by(bad, F.when(bad.isNotNull(), F.col("camera_id"))).alias("bad"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("residual_m"), F.min(wide).alias("semi_minor_m"), F.max(wide).alias("widest"))
    refusal = F.when(F.col("n_rays") < 2, "TOO_FEW_RAYS").when(F.col("crossing_deg") < min_angle, "RAYS_TOO_PARALLEL").when(F.abs("det") < 1e-9, "SINGULAR").otherwise(F.col("bad"))
    lat, lon = geo.from_enu(*map(F.col, ("east", "north", "ref_lat", "ref_lon")))
    values = {"lat": lat, "lon": lon, "residual_m": F.col("residual_m"), "semi_minor_m": F.col("semi_minor_m"), "semi_major_m": F.col("widest") / F.greatest(F.sin(F.radians("crossing_deg")), F.lit(1e-3)), "crossing_deg": F.col("crossing_deg")}
    out = out.withColumn("refusal", refusal)
    return out.select(key, "n_rays", "refusal", *(F.when(F.col("refusal").isNull(), v).alias(n) for n, v in values.items()))


def meet(pairs: DataFrame, a: dict[str, Column], b: dict[str, Column], min_angle: float = geo.MIN_CROSSING_DEG) -> DataFrame:
    """pairs with refusal (as by cross), lat, lon and crossing of two rays, each given by columns lat, lon, bearing, range_m.

    Parts that several results use are worked out once a pair.
    """
    ref_lat, ref_lon = (a["lat"] + b["lat"]) / 2.0, (a["lon"] + b["lon"]) / 2.0
    parts = {"__ref_lat": ref_lat, "__ref_lon": ref_lon, "__crossing": geo.fold(geo.signed_delta(a["bearing"], b["bearing"]))}
    for n, ray in (("a", a), ("b", b)):
        east, north = geo.enu(ray["lat"], ray["lon"], ref_lat, ref_lon)
        dx, dy = _direction(ray["lat"], ray["lon"], ray["bearing"], ref_lon)
        parts |= {f"__{n}_east": east, f"__{n}_north": north, f"__{n}_dx": dx, f"__{n}_dy": dy}
    # Two lines meet in one point whatever their weights; det is 0 only where they are parallel.
    det = "__a_dx * __b_dy - __a_dy * __b_dx"
    along = {n: F.expr(f"try_divide((__b_east - __a_east) * __{o}_dy - (__b_north - __a_north) * __{o}_dx, {det})") for n, o in (("__s", "b"), ("__t", "a"))}
    rows = sets.once(sets.once(pairs, parts), along)
    refusal = F.when((F.col("__crossing") < min_angle) | F.col("__s").isNull(), "RAYS_TOO_PARALLEL")
    for n, ray in (("__s", a), ("__t", b)):
        refusal = refusal.when(F.col(n) <= 0, "BEHIND_CAMERA").when(F.col(n) > ray["range_m"], "BEYOND_RANGE")
    point = [F.expr(f"__a_{c} + __a_{d} * __s") for c, d in (("east", "dx"), ("north", "dy"))]
    lat, lon = geo.from_enu(*point, F.col("__ref_lat"), F.col("__ref_lon"))
    found = {"refusal": refusal, "lat": lat, "lon": lon, "crossing": F.col("__crossing")}
    return rows.withColumns(found).drop(*parts, *along)


#: Cells of this size hold a fifth of a usual ray's length: smaller ones copy rays, larger ones bring together what never meets.
RAY_CELL_DEG = 0.1


def walked(rays: DataFrame) -> DataFrame:
    """Each ray (lat, lon, bearing, range_m) once for each cell (ci, cj) that it passes or comes near to, row of cells by row.

    Rays that meet() finds to cross do so in a cell that both pass: what its plane, which lies between both cameras, bends a
    line is within a margin that grows with the square of the range. Longitudes wrap around.
    """
    cell = lambda x: F.floor(x / RAY_CELL_DEG)
    shrink = F.greatest(F.cos(F.radians("lat")), F.lit(0.02))
    lean = F.tan(F.radians(F.least(F.abs("lat"), F.lit(85.0))))
    margin = F.degrees((3.0 * F.col("range_m") * F.col("range_m") / geo.EARTH_RADIUS_M * (lean + 0.1) + 50.0) / geo.EARTH_RADIUS_M)
    north = F.degrees(F.cos(F.radians("bearing")) * F.col("range_m") / geo.EARTH_RADIUS_M)
    east = F.degrees(F.sin(F.radians("bearing")) * F.col("range_m") / geo.EARTH_RADIUS_M / shrink)
    r = sets.once(rays, {"__margin": margin, "__north": north, "__east": east, "__shrink": shrink})
    ends = [F.col("lat") + F.least(F.lit(0.0), F.col("__north")) - F.col("__margin"), F.col("lat") + F.greatest(F.lit(0.0), F.col("__north")) + F.col("__margin")]
    r = r.withColumn("ci", F.explode(F.sequence(*map(cell, ends))))
    share = [(F.col("ci") + k) * RAY_CELL_DEG + sign * F.col("__margin") - F.col("lat") for k, sign in ((0, -1), (1, 1))]
    flat = F.abs("__north") < 1e-9
    inside = lambda x, otherwise: F.when(flat, otherwise).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / F.col("__north"))))
    r = sets.once(r, {"__t0": inside(share[0], 0.0), "__t1": inside(share[1], 1.0)})
    reach = [F.col("lon") + f(F.col("__east") * F.col("__t0"), F.col("__east") * F.col("__t1")) + sign * F.col("__margin") * 1.05 / F.col("__shrink") for f, sign in ((F.least, -1), (F.greatest, 1))]
    columns = F.array_distinct(F.transform(F.sequence(*map(cell, reach)), lambda j: F.pmod(j, F.lit(_AROUND))))
    return r.withColumn("cj", F.explode(columns)).drop("__margin", "__north", "__east", "__shrink", "__t0", "__t1")


_AROUND = round(360 / RAY_CELL_DEG)


def in_cell(lat: Column, lon: Column) -> Column:
    """Whether a place lies in the row's cell (ci, cj): a pair of rays that meets in several common cells counts in this one."""
    return (F.floor(lat / RAY_CELL_DEG) == F.col("ci")) & (F.pmod(F.floor(lon / RAY_CELL_DEG), F.lit(_AROUND)) == F.col("cj"))


def crossings(rays: DataFrame, key: str, ident: str, keep: list[str], apart: list[str]) -> DataFrame:
    """Pairs of rays (key, ident, lat, lon, bearing, range_m, ...) of one key that meet, each once: key, a_ and b_ of ident and
    `keep`, and lat, lon of the crossing. The a side has the smaller ident; values of `apart` differ.

    An equi-join on key and cells that both rays pass, so that rays that lie apart aren't compared.
    """
    cols = list(dict.fromkeys([ident, *keep, *apart, "lat", "lon", "bearing", "range_m"]))
    cells = walked(rays.select(key, *cols))
    n = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # in full: a row becomes many
    a, b = (cells.select(key, "ci", "cj", *(F.col(c).alias(f"{p}_{c}") for c in cols)).repartition(n, key, "ci", "cj") for p in "ab")
    pairs = a.join(b, [key, "ci", "cj"]).filter(F.col(f"a_{ident}") < F.col(f"b_{ident}"))
    for c in apart:
        pairs = pairs.filter(F.col(f"a_{c}") != F.col(f"b_{c}"))
    ray = lambda p: {k: F.col(f"{p}_{k}") for k in ("lat", "lon", "bearing", "range_m")}
    met = meet(pairs, ray("a"), ray("b")).filter("refusal is null").filter(in_cell(F.col("lat"), F.col("lon")))
    return met.select(key, *(f"{p}_{c}" for p in "ab" for c in dict.fromkeys([ident, *keep])), "lat", "lon")


def approach(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """How close two rays come in front of both cameras: distance_m, corridor_m, lat, lon of the midpoint, consistent."""
    ref_lat, ref_lon = (a["lat"] + b["lat"]) / 2.0, (a["lon"] + b["lon"]) / 2.0
    (px, py), (qx, qy) = (geo.enu(r["lat"], r["lon"], ref_lat, ref_lon) for r in (a, b))
    (ux, uy), (vx, vy) = (_direction(r["lat"], r["lon"], r["bearing"], ref_lon) for r in (a, b))
    wx, wy = px - qx, py - qy
    uv, uw, vw = ux * vx + uy * vy, ux * wx + uy * wy, vx * wx + vy * wy
    uu, vv = ux * ux + uy * uy, vx * vx + vy * vy
    den = uu * vv - uv * uv
    s, t = (F.when(F.abs(den) < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), x / den)) for x in (uv * vw - vv * uw, uu * vw - uv * uw))
    ax, ay, bx, by = px + ux * s, py + uy * s, qx + vx * t, qy + vy * t
    lat, lon = geo.from_enu((ax + bx) / 2.0, (ay + by) / 2.0, ref_lat, ref_lon)
    distance = F.hypot(ax - bx, ay - by)
    corridor = F.tan(F.radians(a["sigma"])) * s + F.tan(F.radians(b["sigma"])) * t
    return {"distance_m": distance, "corridor_m": corridor, "lat": lat, "lon": lon, "consistent": distance <= corridor}


#: Rays of a key that a task compares with all others of it.
CLOSEST_ROWS = 250


def closest(rays: DataFrame, key: str, ident: str) -> DataFrame:
    """For each key of rays (key, ident, lat, lon, bearing, sigma, range_m) the two that come closest to a micrometre, ties by the
    smaller idents: key, a, b, distance_m, corridor_m, consistent.

    All pairs, quadratic by nature: a key's rays are dealt out in parts of about CLOSEST_ROWS, each of which meets all of its
    rays. The join is by merging and the aggregate by the same key and part, so pairs are neither sorted nor kept.
    """
    cols = [ident, "lat", "lon", "bearing", "range_m", "sigma"]
    n = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # in full: a row becomes many
    parts = rays.groupBy(key).agg(F.ceil(F.count("*") / CLOSEST_ROWS).alias("parts"))
    r = rays.select(key, *cols).join(parts, key)
    part = {"a": F.pmod(F.xxhash64(ident), F.col("parts")), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))}
    a, b = (r.select(key, part[p].alias("part"), *(F.col(c).alias(f"{p}_{c}") for c in cols)).repartition(n, key, "part") for p in "ab")
    pairs = a.join(b.hint("merge"), [key, "part"]).filter(F.col(f"a_{ident}") < F.col(f"b_{ident}"))
    near = approach(*({k: F.col(f"{p}_{k}") for k in ("lat", "lon", "bearing", "range_m", "sigma")} for p in "ab"))
    out = pairs.select(key, "part", F.col(f"a_{ident}").alias("a"), F.col(f"b_{ident}").alias("b"), *(near[k].alias(k) for k in ("distance_m", "corridor_m", "consistent")))
    best = F.min_by(F.struct("a", "b", "distance_m", "corridor_m", "consistent"), F.struct(F.round("distance_m", 6), "a", "b")).alias("best")
    out = out.groupBy(key, "part").agg(best).select(key, "best.*")
    return out.groupBy(key).agg(best).select(key, "best.*")
