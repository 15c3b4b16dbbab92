"""Polygon expressions on rings: ARRAY<ARRAY<DOUBLE>> of [lon, lat], closed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions.vectors import bind

GEOJSON = "struct<type: string, coordinates: array<array<array<string>>>>"
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def _segments(ring: Column) -> Column:
    ends = F.slice(ring, F.lit(2), F.size(ring) - 1)
    starts = F.slice(ring, F.lit(1), F.size(ring) - 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))


def signed_area(ring: Column) -> Column:
    """Planar shoelace area, positive counter-clockwise, relative to the first point."""
    x0, y0 = ring[0][0], ring[0][1]
    parts = F.transform(_segments(ring), lambda s: (s.ax - x0) * (s.by - y0) - (s.bx - x0) * (s.ay - y0))
    return F.aggregate(parts, F.lit(0.0), lambda t, p: t + p) / 2


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _meet(s: Column, t: Column) -> Column:
    """Do two segments share a point?"""
    near = (
        (F.greatest(s.ax, s.bx) >= F.least(t.ax, t.bx)) & (F.greatest(t.ax, t.bx) >= F.least(s.ax, s.bx))
        & (F.greatest(s.ay, s.by) >= F.least(t.ay, t.by)) & (F.greatest(t.ay, t.by) >= F.least(s.ay, s.by))
    )
    sides = _turn(s.ax, s.ay, s.bx, s.by, t.ax, t.ay) * _turn(s.ax, s.ay, s.bx, s.by, t.bx, t.by)
    others = _turn(t.ax, t.ay, t.bx, t.by, s.ax, s.ay) * _turn(t.ax, t.ay, t.bx, t.by, s.bx, s.by)
    return near & (sides <= 0) & (others <= 0)


def crosses_itself(ring: Column) -> Column:
    """Does a ring meet itself other than at neighbouring segments' common point?"""

    def check(segments: Column) -> Column:
        last = F.size(segments) - 1
        numbered = F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i")))

        def clash(p: Column, q: Column) -> Column:
            apart = (q.i > p.i + 1) & ~((p.i == 0) & (q.i == last))
            back = (q.i == p.i + 1) & (_turn(p.s.ax, p.s.ay, p.s.bx, p.s.by, q.s.bx, q.s.by) == 0) & (
                (p.s.bx - p.s.ax) * (q.s.bx - q.s.ax) + (p.s.by - p.s.ay) * (q.s.by - q.s.ay) < 0
            )
            return (apart & _meet(p.s, q.s)) | back

        later = lambda all_, p: F.slice(all_, p.i + 2, F.greatest(last - p.i, F.lit(0)))
        return bind(numbered, lambda all_: F.exists(all_, lambda p: F.exists(later(all_, p), lambda q: clash(p, q))))

    return bind(_segments(ring), check)


def _on_ring(point: Column, segments: Column) -> Column:
    def on(s: Column) -> Column:
        inside = point[0].between(F.least(s.ax, s.bx), F.greatest(s.ax, s.bx)) & point[1].between(F.least(s.ay, s.by), F.greatest(s.ay, s.by))
        return inside & (_turn(s.ax, s.ay, s.bx, s.by, point[0], point[1]) == 0)

    return F.exists(segments, on)


def _in_ring(point: Column, segments: Column) -> Column:
    """Is a point that is not on the ring inside it? By the number of segments a ray to the right meets."""

    def met(s: Column) -> Column:
        return ((s.ay > point[1]) != (s.by > point[1])) & (point[0] < (s.bx - s.ax) * (point[1] - s.ay) / F.nullif(s.by - s.ay, F.lit(0.0)) + s.ax)

    return F.size(F.filter(segments, met)) % 2 == 1


def _cross(s: Column, t: Column) -> Column:
    """Do two segments cross at an inner point of both?"""
    sides = _turn(s.ax, s.ay, s.bx, s.by, t.ax, t.ay) * _turn(s.ax, s.ay, s.bx, s.by, t.bx, t.by)
    others = _turn(t.ax, t.ay, t.bx, t.by, s.ax, s.ay) * _turn(t.ax, t.ay, t.bx, t.by, s.bx, s.by)
    return (sides < 0) & (others < 0)


def _part_badly(one: Column, other: Column) -> Column:
    """Do two rings cross, or touch in more than one point? Two such points, or a common line, split the interior."""
    segments, others = _segments(one), _segments(other)
    crossed = F.exists(segments, lambda s: F.exists(others, lambda t: _cross(s, t)))
    touching = F.concat(F.filter(one, lambda p: _on_ring(p, others)), F.filter(other, lambda p: _on_ring(p, segments)))
    return crossed | (F.size(F.array_distinct(touching)) > 1)


def _has_point(ring: Column, other: Column, inside: bool) -> Column:
    """Has ``ring`` a point that lies inside (or outside) ``other``, not on it?"""
    segments = _segments(other)
    return F.exists(ring, lambda p: ~_on_ring(p, segments) & (_in_ring(p, segments) if inside else ~_in_ring(p, segments)))


def _closes_a_loop(rings: Column) -> Column:
    """Do rings that touch each other in single points only together cut the interior apart?

    They do where the graph of rings and touching points has a cycle: ends of its paths are taken off
    until nothing changes, at most once per ring; what is left lies on cycles or between them.
    """

    def rounds(edges: Column) -> Column:
        def inner(kept: Column, _: Column) -> Column:
            often = lambda name: (lambda e: F.size(F.filter(kept, lambda o: o[name] == e[name])) > 1)
            return F.filter(kept, lambda e: often("ring")(e) & often("point")(e))

        left = F.aggregate(F.sequence(F.lit(0), F.size(rings)), edges, inner)
        return F.size(left) > 0

    numbered = F.transform(rings, lambda r, i: F.struct(i.alias("i"), _segments(r).alias("segments")))
    corners = F.array_distinct(F.flatten(rings))

    def meeting(all_: Column) -> Column:
        def at(p: Column, k: Column) -> Column:
            return F.transform(F.filter(all_, lambda r: _on_ring(p, r["segments"])), lambda r: F.struct(r["i"].alias("ring"), k.alias("point")))

        return F.flatten(F.filter(F.transform(corners, at), lambda on: F.size(on) > 1))

    return bind(numbered, lambda all_: bind(meeting(all_), rounds))


def bad_holes(rings: Column) -> Column:
    """Is a hole outside the exterior or across it, do holes overlap, or do they cut the interior apart, alone or together?"""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))

    def outside(hole: Column) -> Column:
        return _part_badly(rings[0], hole) | _has_point(hole, rings[0], inside=False)

    def clash(first: Column, i: Column) -> Column:
        later = F.slice(holes, i + 2, F.greatest(F.size(holes) - i - 1, F.lit(0)))
        return F.exists(later, lambda other: _part_badly(first, other) | _has_point(first, other, True) | _has_point(other, first, True))

    return F.exists(holes, outside) | F.exists(F.transform(holes, clash), lambda x: x) | ((F.size(holes) > 1) & _closes_a_loop(rings))


def planar_area(rings: Column) -> Column:
    """Exterior minus holes."""
    return F.aggregate(rings, F.lit(0.0), lambda total, r: total - F.abs(signed_area(r))) + 2 * F.abs(signed_area(rings[0]))


def numbers(geometry: Column) -> Column:
    """The rings of a parsed geometry, NULL where a coordinate is no number."""
    return geometry["coordinates"].try_cast("array<array<array<double>>>")


def polygon_error(geometry: Column, numeric: Column) -> Column:
    """G1: name of the first failure of a parsed geometry (text coordinates) with its ``numbers``, NULL when valid."""

    def point_error(p: Column) -> Column:
        lon, lat = p[0].try_cast("double"), p[1].try_cast("double")
        return (
            F.when(F.size(p) != 2, "position")
            .when(lon.isNull() | lat.isNull(), "number")
            .when(~lon.between(-180.0, 180.0), "longitude")
            .when(~lat.between(-90.0, 90.0), "latitude")
        )

    def ring_error(ring: Column) -> Column:
        first_bad = F.get(F.array_compact(F.transform(ring, point_error)), F.lit(0))
        return bind(first_bad, lambda bad: (
            F.when(F.size(ring) < 4, "ring")
            .when(bad.isNotNull(), bad)
            .when(F.element_at(ring, 1) != F.element_at(ring, -1), "closed")
        ))

    rings = geometry["coordinates"]
    shape = F.get(F.array_compact(F.transform(rings, ring_error)), F.lit(0))
    return bind(shape, lambda bad: (
        F.when(F.coalesce(geometry["type"], F.lit("")) != "Polygon", "type")
        .when(F.coalesce(F.size(rings), F.lit(0)) <= 0, "empty")
        .when(bad.isNotNull(), bad)
        .when((signed_area(numeric[0]) == 0) | (planar_area(numeric) == 0), "area")
        .when(F.exists(numeric, crosses_itself), "crossing")
        .when((F.size(numeric) > 1) & bad_holes(numeric), "hole")
    ))


def _sin_authalic(latitude: Column) -> Column:
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    s = F.sin(F.radians(latitude))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return q / _polar_q()


def _polar_q() -> float:
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    return (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))


def ring_hectares(ring: Column) -> Column:
    """Area of one ring on the ellipsoid by the authalic sphere, without sign."""
    parts = F.transform(
        _segments(ring), lambda s: F.radians(s.bx - s.ax) * (_sin_authalic(s.ay) + _sin_authalic(s.by))
    )
    radius2 = WGS84_A * WGS84_A * _polar_q() / 2
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda t, p: t + p)) * (radius2 / 2 / 10000.0)


def area_hectares(rings: Column) -> Column:
    """Exterior minus holes."""
    areas = F.transform(rings, ring_hectares)
    return 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda t, a: t + a)


def _canonical_ring(ring: Column, clockwise: Column) -> Column:
    # the sign of the wanted direction times the area is negative for a ring that runs backwards
    wanted = F.when(clockwise, -1.0).otherwise(1.0)
    turned = F.when(signed_area(ring) * wanted < 0, F.reverse(ring)).otherwise(ring)
    rounded = F.transform(turned, lambda p: F.transform(p, lambda v: F.round(v, 7)))

    def rotate(points: Column) -> Column:
        start = F.array_position(points, F.array_min(points)).cast("int")
        head = F.slice(points, start, F.size(points) - start + 1)
        return F.concat(head, F.slice(points, F.lit(1), start))

    return bind(F.slice(rounded, F.lit(1), F.size(rounded) - 1), rotate)


def canonical_rings(rings: Column) -> Column:
    """Exterior counter-clockwise, holes clockwise and sorted, each from its smallest point."""
    def order(turned: Column) -> Column:
        holes = F.array_sort(F.slice(turned, F.lit(2), F.greatest(F.size(turned) - 1, F.lit(0))))
        return F.concat(F.slice(turned, 1, 1), holes)

    return bind(F.transform(rings, lambda r, i: _canonical_ring(r, i > 0)), order)


def geometry_hash(canonical: Column) -> Column:
    """Digest of the compact JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(canonical.alias("coordinates"), F.lit("Polygon").alias("type"))), 256)


def web_mercator(rings: Column) -> Column:
    """Every point in metres."""

    def point(p: Column) -> Column:
        y = F.log(F.tan(F.radians(p[1]) / 2 + math.pi / 4)) * WGS84_A
        return F.array(F.radians(p[0]) * WGS84_A, y)

    return F.transform(rings, lambda ring: F.transform(ring, point))


def bounding_box(rings: Column) -> Column:
    """[min lon, min lat, max lon, max lat] of the exterior."""
    lons, lats = F.transform(rings[0], lambda p: p[0]), F.transform(rings[0], lambda p: p[1])
    return F.array(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))


def vertex_mean(rings: Column, axis: int) -> Column:
    """Mean of the exterior's points; the closing point counts, as the yield job expects."""
    return F.aggregate(rings[0], F.lit(0.0), lambda t, p: t + p[axis]) / F.size(rings[0])
