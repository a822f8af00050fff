"""Spherical geometry on longitude/latitude structs, as Column expressions.

A point is ``struct(lon, lat)`` in degrees, a line an array of points, a ring a closed line.
Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
POINT = "struct<lon:double,lat:double>"
#: Metres per degree of latitude.
DEGREE_M = EARTH_M * 3.141592653589793 / 180.0


def point(lon: Column | float, lat: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(lon).cast("double").alias("lon"), as_col(lat).cast("double").alias("lat"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once. Within a lambda Spark works out an expression at each place that uses it; a
    lambda's own variable it only looks up."""
    return F.transform(F.array(value), f)[0]


def inline(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value as it is written: for plain columns, whose common parts Spark finds itself when it compiles them."""
    return f(value)


def points(coordinates: Column) -> Column:
    """An array of [lon, lat] arrays as an array of points."""
    return F.transform(coordinates, lambda p: point(p[0], p[1]))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards positive infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def hilbert(p: Column, bits: int = 24) -> Column:
    """The place of a point on a Hilbert curve of ``2^bits`` cells a side over all longitudes and latitudes."""
    most = (1 << bits) - 1
    cell = lambda v, low, span: F.greatest(F.lit(0), F.least(F.lit(most), F.floor((v - low) / span * (1 << bits)))).cast("long")
    state = F.struct(cell(p["lon"], -180.0, 360.0).alias("x"), cell(p["lat"], -90.0, 180.0).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(at: Column, s: Column) -> Column:
        right, up = (at["x"].bitwiseAND(s) != 0), (at["y"].bitwiseAND(s) != 0)
        quarter = F.when(right, F.when(up, 2).otherwise(3)).otherwise(F.when(up, 1).otherwise(0))
        # the lower quarters are mirrored on a diagonal
        turn = lambda v: F.when(right & ~up, F.lit(most) - v).otherwise(v)
        x, y = F.when(up, at["x"]).otherwise(turn(at["y"])), F.when(up, at["y"]).otherwise(turn(at["x"]))
        return F.struct(x.alias("x"), y.alias("y"), (at["d"] + s * s * quarter).alias("d"))

    sides = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(bits))])
    return F.aggregate(sides, state, step, lambda at: at["d"])


def haversine(a: Column, b: Column) -> Column:
    """Great-circle distance in metres."""
    lat1, lat2 = F.radians(a["lat"]), F.radians(b["lat"])
    s1, s2 = F.sin((lat2 - lat1) / 2), F.sin(F.radians(b["lon"] - a["lon"]) / 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(s1 * s1 + F.cos(lat1) * F.cos(lat2) * s2 * s2)))


def pairs(line: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of every two consecutive points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), f)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def length(line: Column) -> Column:
    return total(pairs(line, haversine))


def bearing(a: Column, b: Column) -> Column:
    """Initial bearing in [0, 360)."""
    lat1, lat2, d = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lon"] - a["lon"])
    y = F.sin(d) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest difference of two bearings, 0 to 180."""
    return F.abs(F.pmod(b - a + 540, F.lit(360.0)) - 180)


def compass(deg: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")])
    return F.element_at(names, (F.floor(F.pmod(deg, F.lit(360.0)) / 45 + 0.5) % 8 + 1).cast("int"))


def project(p: Column, a: Column, b: Column, let: Callable = inline) -> Column:
    """The nearest point of segment ab to p: ``struct(t, point, dist_m)``, on the plane that
    touches the sphere at the segment's middle latitude. Within lambdas ``let`` is ``once``."""
    shrink = F.cos(F.radians((a["lat"] + b["lat"]) / 2))

    def nearest(shrink: Column) -> Column:
        dx, dy = (b["lon"] - a["lon"]) * shrink, b["lat"] - a["lat"]
        return let(F.struct(dx.alias("x"), dy.alias("y"), (dx * dx + dy * dy).alias("square")), lambda d: on_line(shrink, d))

    def on_line(shrink: Column, d: Column) -> Column:
        along = ((p["lon"] - a["lon"]) * shrink * d["x"] + (p["lat"] - a["lat"]) * d["y"]) / F.when(d["square"] > 0, d["square"]).otherwise(F.lit(1.0))
        return let(F.when(d["square"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))).otherwise(F.lit(0.0)), at_share)

    def at_share(t: Column) -> Column:
        at = point(a["lon"] + t * (b["lon"] - a["lon"]), a["lat"] + t * (b["lat"] - a["lat"]))
        return let(at, lambda at: F.struct(t.alias("t"), at.alias("point"), haversine(p, at).alias("dist_m")))

    return let(shrink, nearest)


def distance_to_line(p: Column, line: Column) -> Column:
    """Metres from a point to the nearest place of a line of two points or more."""
    return F.array_min(pairs(line, lambda a, b: project(p, a, b, once)["dist_m"]))


def inside(p: Column, ring: Column) -> Column:
    """Even-odd rule; an edge holds its lower end in latitude but not its upper."""

    def crosses(a: Column, b: Column) -> Column:
        spans = (a["lat"] > p["lat"]) != (b["lat"] > p["lat"])
        rise = F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]).otherwise(F.lit(1.0))
        at = (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) / rise + a["lon"]
        return spans & (p["lon"] < at)

    closed = F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))
    return once(closed, lambda r: F.size(F.filter(pairs(r, crosses), lambda x: x)) % 2 == 1)


def intersection(a: Column, b: Column, c: Column, d: Column, let: Callable = inline) -> Column:
    """Where segments ab and cd meet: ``struct(t, u, point)``, ends included; null if they don't or are parallel.
    Within lambdas ``let`` is ``once``."""
    rx, ry, sx, sy = b["lon"] - a["lon"], b["lat"] - a["lat"], d["lon"] - c["lon"], d["lat"] - c["lat"]

    def shares(cross: Column) -> Column:
        safe = F.when(cross != 0, cross).otherwise(F.lit(1.0))
        t = ((c["lon"] - a["lon"]) * sy - (c["lat"] - a["lat"]) * sx) / safe
        u = ((c["lon"] - a["lon"]) * ry - (c["lat"] - a["lat"]) * rx) / safe
        return let(t, lambda t: let(u, lambda u: place(cross, t, u)))

    def place(cross: Column, t: Column, u: Column) -> Column:
        at = F.struct(t.alias("t"), u.alias("u"), point(a["lon"] + t * rx, a["lat"] + t * ry).alias("point"))
        return F.when((cross != 0) & t.between(0, 1) & u.between(0, 1), at)

    return let(rx * sy - ry * sx, shares)


def meetings(a: Column, b: Column, ring: Column) -> Column:
    """The ``intersection`` of segment ab with each side of a ring that it meets."""
    return F.filter(pairs(ring, lambda c, d: intersection(a, b, c, d, once)), lambda x: x.isNotNull())


def along(line: Column, metres: Column | float) -> Column:
    """The point so many metres along a line, at most its end."""
    goal = metres if isinstance(metres, Column) else F.lit(float(metres))
    steps = pairs(line, lambda a, b: F.struct(a.alias("a"), b.alias("b"), haversine(a, b).alias("m")))
    none = F.lit(None).cast(POINT)

    def walk(acc: Column, s: Column) -> Column:
        t = F.when(s["m"] > 0, (goal - acc["m"]) / F.when(s["m"] > 0, s["m"]).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
        here = point(s["a"]["lon"] + t * (s["b"]["lon"] - s["a"]["lon"]), s["a"]["lat"] + t * (s["b"]["lat"] - s["a"]["lat"]))
        found = F.when(acc["at"].isNull() & (acc["m"] + s["m"] >= goal), here).otherwise(acc["at"])
        return F.struct((acc["m"] + s["m"]).alias("m"), found.alias("at"))

    start = F.struct(F.lit(0.0).alias("m"), none.alias("at"))
    return F.aggregate(steps, start, walk, lambda acc: F.coalesce(acc["at"], F.element_at(line, -1)))


def leading_bearing(line: Column) -> Column:
    """Heading over the first 10 m, or over the whole line if these are no distance."""
    first, p = line[0], along(line, 10.0)
    return F.when(p == first, bearing(first, F.element_at(line, -1))).otherwise(bearing(first, p))


def trailing_bearing(line: Column) -> Column:
    last, p = F.element_at(line, -1), along(F.reverse(line), 10.0)
    return F.when(p == last, bearing(line[0], last)).otherwise(bearing(p, last))


def oriented(line: Column, from_id: Column, at: Column) -> Column:
    """The line as it is travelled from node ``at``."""
    return F.when(from_id == at, line).otherwise(F.reverse(line))


def bounds(line: Column) -> Column:
    lon, lat = line["lon"], line["lat"]  # of all its points
    return F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def vertex_mean(ring: Column, digits: int = 6) -> Column:
    """Mean of all vertices, the closing one included."""
    n = F.size(ring)
    return point(F.round(total(F.transform(ring, lambda p: p["lon"])) / n, digits), F.round(total(F.transform(ring, lambda p: p["lat"])) / n, digits))


def square_metres(ring: Column) -> Column:
    """Area of a small ring, on the plane at its middle latitude."""
    b = bounds(ring)
    shrink = F.cos(F.radians((b["min_lat"] + b["max_lat"]) / 2))
    x0, y0 = b["min_lon"], b["min_lat"]
    twice = total(pairs(ring, lambda p, q: (p["lon"] - x0) * (q["lat"] - y0) - (q["lon"] - x0) * (p["lat"] - y0)))
    return F.abs(twice) / 2 * shrink * DEGREE_M * DEGREE_M


def square_around(p: Column, area_m2: Column) -> Column:
    """A square ring of that area around a point: stands in for a footprint that isn't known."""
    half = F.sqrt(area_m2) / 2 / DEGREE_M
    wide = half / F.cos(F.radians(p["lat"]))
    corner = lambda i, j: point(p["lon"] + i * wide, p["lat"] + j * half)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def widened(ring: Column, metres: float) -> Column:
    """A ring with each vertex moved away from their mean by so many metres."""

    def out(c: Column, p: Column) -> Column:
        k = once(haversine(c, p), lambda d: 1 + metres / F.when(d > 0, d).otherwise(F.lit(1.0)))
        return once(k, lambda k: point(c["lon"] + (p["lon"] - c["lon"]) * k, c["lat"] + (p["lat"] - c["lat"]) * k))

    return once(vertex_mean(F.slice(ring, F.lit(1), F.size(ring) - 1), 9), lambda c: F.transform(ring, lambda p: out(c, p)))


def length_inside(line: Column, ring: Column) -> Column:
    """Metres of a line within a ring: its segments are cut where they cross the ring, and the
    pieces whose middle is inside count."""

    def of_segment(a: Column, b: Column) -> Column:
        cuts = F.transform(meetings(a, b, ring), lambda x: x["t"])
        ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
        at = lambda t: point(a["lon"] + t * (b["lon"] - a["lon"]), a["lat"] + t * (b["lat"] - a["lat"]))
        within = lambda s, t: once(at((s + t) / 2), lambda p: inside(p, ring))
        return once(ts, lambda ts: total(pairs(ts, lambda s, t: F.when(within(s, t), haversine(at(s), at(t))).otherwise(F.lit(0.0)))))

    def where_near(a: Column, b: Column, box: Column) -> Column:
        apart = [F.greatest(a[c], b[c]) < box[f"min_{c}"] for c in ("lon", "lat")] + [F.least(a[c], b[c]) > box[f"max_{c}"] for c in ("lon", "lat")]
        return F.when(apart[0] | apart[1] | apart[2] | apart[3], F.lit(0.0)).otherwise(of_segment(a, b))

    return once(bounds(ring), lambda box: total(pairs(line, lambda a, b: where_near(a, b, box))))


def from_wkt_point(text: Column) -> Column:
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double")
    return F.when(text.rlike(pattern), point(part(1), part(2)))


def cell(p: Column, lon_step: float, lat_step: float) -> Column:
    return F.struct(F.floor(p["lon"] / lon_step).alias("cx"), F.floor(p["lat"] / lat_step).alias("cy"))
