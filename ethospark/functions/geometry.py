"""Geometry, regions of interest, names and formats as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def wrap_angle(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def box_iou(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """IoU of axis-aligned boxes; null without area."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h
    return F.when(union > 0, w * h / union)


def rect_contains(x, y, rx, ry, rw, rh) -> Column:
    return F.coalesce((x >= rx) & (x <= rx + rw) & (y >= ry) & (y <= ry + rh), F.lit(False))


def circle_contains(x, y, cx, cy, r) -> Column:
    return F.coalesce(F.hypot(x - cx, y - cy) <= r, F.lit(False))


def polygon_contains(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a fixed polygon."""
    odd = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if ay != by:
            odd = odd + (((y < ay) != (y < by)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int")
    return F.coalesce(odd % 2 == 1, F.lit(False))


def rect_signed_distance(x, y, rx, ry, rw, rh) -> Column:
    """Distance to the border, positive inside."""
    inside = F.least(x - rx, rx + rw - x, y - ry, ry + rh - y)
    dx, dy = F.greatest(rx - x, F.lit(0.0), x - rx - rw), F.greatest(ry - y, F.lit(0.0), y - ry - rh)
    return F.when(inside >= 0, inside).otherwise(-F.hypot(dx, dy))


def circle_signed_distance(x, y, cx, cy, r) -> Column:
    return r - F.hypot(x - cx, y - cy)


def corner_distance(x, y, points: list[tuple[float, float]]) -> Column:
    return F.least(*(F.hypot(x - px, y - py) for px, py in points))


def joint_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle at b of a-b-c."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    n = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(n > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / n))))


def normalize_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def significant(x: Column, n: int) -> Column:
    """x to n significant digits; what is under 1e-9 in size, and a negative zero, becomes 0."""
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(x))))
    out = F.round(x * scale) / scale
    return F.when((F.abs(x) < 1e-9) | (out == 0), 0.0).otherwise(out)


def format_duration(seconds: Column) -> Column:
    """450 ms, 12.3 s, 4m 05s or 1h 02m; less than nothing is nothing."""
    s = F.greatest(F.lit(0.0), seconds)
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(s < 1, F.concat(F.round(s * 1000).cast("long").cast("string"), F.lit(" ms"))).when(s < 60, F.concat(F.format_string("%.1f", s), F.lit(" s"))).when(s < 3600, F.format_string("%dm %02ds", m, F.floor(s) - m * 60)).otherwise(F.format_string("%dh %02dm", h, F.floor((s - h * 3600) / 60)))


def scale_coordinate(v: Column, own: Column, ref: Column) -> Column:
    """To the reference resolution; unknown sizes change nothing."""
    return F.when((own > 0) & (ref > 0), v * ref / own).otherwise(v)


def entropy(p: Column) -> Column:
    """-sum p ln p of an array, p clipped to 1e-9..1."""
    return -F.aggregate(F.transform(p, lambda x: F.greatest(F.lit(1e-9), F.least(F.lit(1.0), x))), F.lit(0.0), lambda a, x: a + x * F.log(x))


def margin(p: Column) -> Column:
    s = F.array_sort(p)
    return F.element_at(s, -1) - F.element_at(s, -2)


Point = tuple[float, float]


def polygon_center(points: list[Point]) -> Point:
    return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)


def polygon_signed_distance(x: Column, y: Column, points: list[Point]) -> Column:
    """Distance to the nearest edge, positive inside."""
    edges = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (n or 1.0)))
        edges.append(F.hypot(x - (ax + t * (bx - ax)), y - (ay + t * (by - ay))))
    return F.least(*edges) * F.when(polygon_contains(x, y, points), 1).otherwise(-1)


def roi_center(roi: dict) -> Point:
    if roi["shape"] == "circle":
        return float(roi["cx"]), float(roi["cy"])
    if roi["shape"] == "polygon":
        return polygon_center(roi["points"])
    return roi["x"] + roi["w"] / 2, roi["y"] + roi["h"] / 2


def roi_axes(roi: dict) -> tuple[Point, Point, Point, float, float]:
    """(centre, long axis, short axis, half length, half width): of a polygon the directions in which its corners spread most and least, else of the box."""
    cx, cy = roi_center(roi)
    if roi["shape"] == "polygon" and len(roi["points"]) >= 3:
        xs, ys = [p[0] - cx for p in roi["points"]], [p[1] - cy for p in roi["points"]]
        # The larger axis of the 2 x 2 scatter matrix.
        turn = 0.5 * math.atan2(2 * sum(a * b for a, b in zip(xs, ys)), sum(a * a for a in xs) - sum(b * b for b in ys))
        long = math.cos(turn), math.sin(turn)
        short = -long[1], long[0]
        half = [max(abs(a * u + b * v) for a, b in zip(xs, ys)) or 1.0 for u, v in (long, short)]
        return (cx, cy), long, short, half[0], half[1]
    w, h = (2 * roi["r"], 2 * roi["r"]) if roi["shape"] == "circle" else (roi["w"], roi["h"])
    upright = h >= w
    return (cx, cy), (0.0, 1.0) if upright else (1.0, 0.0), (1.0, 0.0) if upright else (0.0, 1.0), max(max(w, h) / 2, 1e-6), max(min(w, h) / 2, 1e-6)


def axial_lateral(x: Column, y: Column, axes: tuple[Point, Point, Point, float, float]) -> tuple[Column, Column]:
    """Place along the long and the short axis, -1 to 1 from end to end."""
    (cx, cy), long, short, half_long, half_short = axes
    return ((x - cx) * long[0] + (y - cy) * long[1]) / half_long, ((x - cx) * short[0] + (y - cy) * short[1]) / half_short


def scale_roi(roi: dict, factor: float) -> dict:
    """Circles and polygons scale as they are; boxes are cut to whole pixels, one wide and high at least."""
    if factor == 1:
        return dict(roi)
    if roi["shape"] == "circle":
        return {"shape": "circle", **{k: roi[k] * factor for k in ("cx", "cy", "r")}}
    if roi["shape"] == "polygon":
        return {"shape": "polygon", "points": [(px * factor, py * factor) for px, py in roi["points"]]}
    return {"shape": "rect", "x": int(roi["x"] * factor), "y": int(roi["y"] * factor), "w": max(1, int(roi["w"] * factor)), "h": max(1, int(roi["h"] * factor))}


def cut_corners(points: list[Point], times: int = 2) -> list[Point]:
    """Each corner of a closed polygon becomes two, a quarter along its edges; fewer than three points stay."""
    for _ in range(times if len(points) >= 3 else 0):
        points = [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) for a, b in zip(points, points[1:] + points[:1]) for t in (0.25, 0.75)]
    return points


def simplify(points: list[Point], tolerance: float) -> list[Point]:
    """A closed polygon less the corners within tolerance of the lines that remain; three points at least, else it stays as it is.

    It is taken as two chains between the corner farthest from the middle and the one farthest from that.
    """
    if len(points) <= 3 or tolerance <= 0:
        return list(points)
    far = lambda o: max(range(len(points)), key=lambda i: math.dist(points[i], o))
    a, b = sorted((first := far(polygon_center(points)), far(points[first])))
    ring = points + points
    kept: list[Point] = []
    for chain in (ring[a : b + 1], ring[b : a + len(points) + 1]):
        keep, todo = {0, len(chain) - 1}, [(0, len(chain) - 1)]
        while todo:
            i, j = todo.pop()
            off = [_off_line(chain[k], chain[i], chain[j]) for k in range(i + 1, j)]
            if off and max(off) > tolerance:
                k = i + 1 + off.index(max(off))
                keep.add(k)
                todo += [(i, k), (k, j)]
        kept += [chain[k] for k in sorted(keep)[:-1]]
    return kept if len(kept) >= 3 else list(points)


def _off_line(p: Point, a: Point, b: Point) -> float:
    n = math.dist(a, b)
    return math.dist(p, a) if n == 0 else abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1])) / n


def region_columns(x: Column, y: Column, rois: list[dict | None], scale: float = 1.0) -> dict[str, Column]:
    """For each region inside, signed, edge and corner distance, axial and lateral place; of a region that is not there inside is 0 and the rest null, so the columns are always the same."""
    nothing, out = F.lit(None).cast("double"), {}
    for i, roi in enumerate(rois, 1):
        name = lambda k: f"roi{i}_{k}"  # noqa: B023, E731
        if roi is None:
            out |= {name(k): F.lit(0.0) if k == "inside" else nothing for k in ("inside", "signed", "edge", "corner", "axial", "lateral")}
            continue
        if roi["shape"] == "circle":
            signed, inside, corner = circle_signed_distance(x, y, roi["cx"], roi["cy"], roi["r"]), circle_contains(x, y, roi["cx"], roi["cy"], roi["r"]), nothing
        elif roi["shape"] == "polygon":
            signed, inside, corner = polygon_signed_distance(x, y, roi["points"]), polygon_contains(x, y, roi["points"]), corner_distance(x, y, roi["points"])
        else:
            box = [F.lit(float(roi[k])) for k in "xywh"]
            corners = [(roi["x"] + dx * roi["w"], roi["y"] + dy * roi["h"]) for dx in (0, 1) for dy in (0, 1)]
            signed, inside, corner = rect_signed_distance(x, y, *box), rect_contains(x, y, *box), corner_distance(x, y, corners)
        axial, lateral = axial_lateral(x, y, roi_axes(roi))
        out |= {name("inside"): inside.cast("double"), name("signed"): signed * scale, name("edge"): F.abs(signed) * scale, name("corner"): corner * scale, name("axial"): axial, name("lateral"): lateral}
    return out
