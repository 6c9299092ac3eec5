"""Geometry on longitude and latitude: GeoJSON rings, triangulation, distances and point tests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088

Point = tuple[float, float]


def polygons(geometry: str | None) -> list[list[list[Point]]]:
    """The polygons of a GeoJSON Polygon or MultiPolygon as rings of open point lists; [] for anything else."""
    try:
        shape = json.loads(geometry or "null") or {}
    except ValueError:
        return []
    parts = {"Polygon": lambda c: [c], "MultiPolygon": list}.get(shape.get("type"), lambda c: [])(shape.get("coordinates") or [])
    result = []
    for part in parts:
        rings = []
        for ring in part:
            points = [(float(p[0]), float(p[1])) for p in ring]
            kept = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
            if len(kept) > 1 and kept[0] == kept[-1]:
                kept.pop()
            if len(kept) >= 3:
                rings.append(kept)
        if rings:
            result.append(rings)
    return result


def turn(a: Point, b: Point, p: Point) -> float:
    """Twice the signed area of a, b, p. Exactly antisymmetric in a and b, so triangles that share an edge agree on it."""
    if b < a:
        return -((a[0] - b[0]) * (p[1] - b[1]) - (a[1] - b[1]) * (p[0] - b[0]))
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def ring_area(ring: Sequence[Point]) -> float:
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _holds(a: Point, b: Point, c: Point, p: Point) -> bool:
    return turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0


def _bridge(outer: list[Point], hole: list[Point]) -> list[Point] | None:
    """outer with a clockwise hole cut in along a segment from the hole's rightmost point to a point it can see."""
    start = max(range(len(hole)), key=lambda i: hole[i])
    hx, hy = hole[start]
    best, at = None, -1
    for i, (a, b) in enumerate(zip(outer, [*outer[1:], outer[0]], strict=True)):
        if min(a[1], b[1]) <= hy <= max(a[1], b[1]) and a[1] != b[1]:
            x = a[0] + (hy - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
            if x >= hx and (best is None or x < best):
                best, at = x, i if a[0] > b[0] else (i + 1) % len(outer)
    if best is None:
        return None
    corner = outer[at]
    if corner != (best, hy):
        low, high = sorted([(hx, hy), (best, hy), corner], key=lambda p: p[1])[::2]
        tri = [(hx, hy), (best, hy), corner] if turn((hx, hy), (best, hy), corner) > 0 else [(hx, hy), corner, (best, hy)]
        steepest = abs(corner[1] - hy) / max(corner[0] - hx, 1e-300)
        for i, p in enumerate(outer):
            if p != corner and p[0] >= hx and low[1] <= p[1] <= high[1] and _holds(*tri, p):
                slope = abs(p[1] - hy) / max(p[0] - hx, 1e-300)
                if slope < steepest or (slope == steepest and p[0] < outer[at][0]):
                    steepest, at = slope, i
    return [*outer[: at + 1], *hole[start:], *hole[: start + 1], *outer[at:]]


def _clip(ring: list[Point]) -> list[tuple[Point, Point, Point]] | None:
    after, before = [*range(1, len(ring)), 0], [len(ring) - 1, *range(len(ring) - 1)]
    triangles, left, at, idle = [], len(ring), 0, 0
    while left > 3:
        i, k = before[at], after[at]
        a, b, c = ring[i], ring[at], ring[k]
        bend = turn(a, b, c)
        ear = bend > 0
        j = after[k] if ear else i
        while ear and j != i:
            p = ring[j]
            if p not in (a, b, c) and turn(ring[before[j]], p, ring[after[j]]) <= 0 and _holds(a, b, c, p):
                ear = False
            j = after[j]
        if ear or bend == 0:
            if ear:
                triangles.append((a, b, c))
            after[i], before[k] = k, i
            left, idle, at = left - 1, 0, k
        else:
            at, idle = k, idle + 1
            if idle > left:
                return None
    i, k = before[at], after[at]
    if turn(ring[i], ring[at], ring[k]) > 0:
        triangles.append((ring[i], ring[at], ring[k]))
    return triangles


def triangulate(rings: list[list[Point]]) -> tuple[list[tuple[Point, Point, Point]], bool]:
    """Triangles of a polygon by ear clipping, holes cut in first; and whether they are to be counted by parity.

    When clipping fails or its area is not the polygon's (rings that cross themselves), the triangles are fans over
    all rings, of which a point inside lies in an odd number.
    """
    outer = rings[0] if ring_area(rings[0]) > 0 else rings[0][::-1]
    holes = [h if ring_area(h) < 0 else h[::-1] for h in rings[1:]]
    merged: list[Point] | None = outer
    for hole in sorted(holes, key=lambda h: max(h), reverse=True):
        merged = merged and _bridge(merged, hole)
    triangles = merged and _clip(merged)
    area = ring_area(outer) + sum(map(ring_area, holes))
    if triangles and abs(sum(turn(*t) for t in triangles) / 2 - area) <= 1e-9 * abs(area):
        return triangles, False
    fans = [(ring[0], a, b) for ring in rings for a, b in zip(ring[1:-1], ring[2:], strict=True)]
    return [(a, b, c) if turn(a, b, c) > 0 else (a, c, b) for a, b, c in fans if turn(a, b, c) != 0], True


def turn_column(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """turn() as a column expression."""
    forward = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    backward = -((ax - bx) * (py - by) - (ay - by) * (px - bx))
    return F.when((bx < ax) | ((bx == ax) & (by < ay)), backward).otherwise(forward)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on a sphere of the earth's mean radius."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def valid_location(lat: Column, lon: Column) -> Column:
    """Both there, in range, and not the point 0, 0. NaN is not valid."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


# Fixed value: how far a point may lie from a line and still be on it.
ON_LINE = 1e-10


def on_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a point lies on a segment."""
    cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
    return (F.abs(cross) <= ON_LINE) & (x >= F.least(x1, x2) - ON_LINE) & (x <= F.greatest(x1, x2) + ON_LINE) & (y >= F.least(y1, y2) - ON_LINE) & (y <= F.greatest(y1, y2) + ON_LINE)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against array<struct<x,y>>, the last point joined to the first; the boundary is inside, fewer than three points hold nothing."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    on = F.exists(edges, lambda e: on_segment(x, y, e["x1"], e["y1"], e["x2"], e["y2"]))
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))))
    return (F.size(ring) >= 3) & (on | (F.size(crossed) % 2 == 1))


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in no other; the boundary of a hole counts as in the hole."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return (F.size(rings) > 0) & in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda r: in_ring(x, y, r))


def in_geometry(x: Column, y: Column, parts: Column) -> Column:
    """In any of the polygons of array<array<array<struct<x,y>>>>."""
    return F.exists(parts, lambda rings: in_polygon(x, y, rings))


def segment_km(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment in a plane laid at the point: a degree is 110.57 km of latitude and 111.32 km cos(latitude) of longitude."""
    kx, ky = F.lit(111.32) * F.cos(F.radians(y)), F.lit(110.57)
    ax, ay, bx, by = (x1 - x) * kx, (y1 - y) * ky, (x2 - x) * kx, (y2 - y) * ky
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(length, F.lit(0.0)))))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


GEOMETRY_SCHEMA = "type string, coordinates string"


def parts_of(geometry: Column) -> Column:
    """GeoJSON Polygon or MultiPolygon text as array<array<array<struct<x,y>>>>, parsed on the JVM; null for other types."""
    kind = F.get_json_object(geometry, "$.type")
    text = F.get_json_object(geometry, "$.coordinates")
    multi = F.when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")).when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>")))
    return F.transform(multi, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))))


def first_property(properties: Column, *names: str) -> Column:
    """The first non-empty value of a map<string,string> under alternative names, '' when there is none."""
    return F.coalesce(*[F.nullif(F.trim(properties[n]), F.lit("")) for n in names], F.lit(""))
