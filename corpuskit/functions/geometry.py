"""Boxes, turns, polygons and pixel sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.names import js_round


def normalize_rotation(degrees: Column) -> Column:
    return F.pmod(F.floor(degrees / 90 + 0.5) * 90, F.lit(360)).cast("int")


def _box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def rotate_box(box: Column, degrees: Column) -> Column:
    """A normalised box turned with its page."""
    x, y, w, h = box["x"], box["y"], box["width"], box["height"]
    turn = normalize_rotation(degrees)
    return (
        F.when(turn == 90, _box(1 - (y + h), x, h, w))
        .when(turn == 180, _box(1 - (x + w), 1 - (y + h), w, h))
        .when(turn == 270, _box(y, 1 - (x + w), h, w))
        .otherwise(_box(x, y, w, h))
    )


def rotate_points(points: Column, degrees: Column) -> Column:
    turn = normalize_rotation(degrees)

    def moved(p: Column) -> Column:
        px = F.when(turn == 90, 1 - p["y"]).when(turn == 180, 1 - p["x"]).when(
            turn == 270, p["y"]
        ).otherwise(p["x"])
        py = F.when(turn == 90, p["x"]).when(turn == 180, 1 - p["y"]).when(
            turn == 270, 1 - p["x"]
        ).otherwise(p["y"])
        return F.struct(px.alias("x"), py.alias("y"))

    return F.transform(points, moved)


def bitmap_to_user(px: Column, py: Column, scale: Column, rotation: Column, box: Column) -> Column:
    """Pixel of a rendered page → point of the page, origin bottom left."""
    vx, vy = px / scale, py / scale
    x0, y0, w, h = box["x0"], box["y0"], box["width"], box["height"]
    turn = F.pmod(rotation, F.lit(360))
    x = F.when(turn == 90, x0 + vy).when(turn == 180, x0 + w - vx).when(
        turn == 270, x0 + w - vy
    ).otherwise(x0 + vx)
    y = F.when(turn == 90, y0 + vx).when(turn == 180, y0 + vy).when(
        turn == 270, y0 + h - vx
    ).otherwise(y0 + h - vy)
    return F.struct(x.alias("x"), y.alias("y"))


def _overlap(a: Column, b: Column) -> Column:
    ox = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    oy = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(ox, F.lit(0.0)) * F.greatest(oy, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = _overlap(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def overlaps_region(a: Column, b: Column) -> Column:
    """More than half of the smaller box is shared."""
    smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return F.when(smaller > 0, _overlap(a, b) / smaller > 0.5).otherwise(False)


def polygon_bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    box = _box(x, y, F.array_max(xs) - x, F.array_max(ys) - y)
    zero = F.lit(0.0)
    return F.when(F.size(points) == 0, _box(zero, zero, zero, zero)).otherwise(box)


def _edges(points: Column) -> Column:
    turned = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    return F.zip_with(points, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _side(a: Column, b: Column, x: Column, y: Column) -> Column:
    return (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])


def point_in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Inside by winding number."""

    def turn(e: Column) -> Column:
        a, b = e["a"], e["b"]
        up = (a["y"] <= y) & (b["y"] > y) & (_side(a, b, x, y) > 0)
        down = (a["y"] > y) & (b["y"] <= y) & (_side(a, b, x, y) < 0)
        return F.when(up, 1).when(down, -1).otherwise(0)

    winding = F.aggregate(F.transform(_edges(points), turn), F.lit(0), lambda s, t: s + t)
    return (F.size(points) >= 3) & (winding != 0)


def _edge_meets_box(e: Column, box: Column) -> Column:
    """Does the part of a segment inside the box have any length (clip by both axes)?"""
    a, b = e["a"], e["b"]

    def span(p, q, low, size):
        d = q - p
        t0, t1 = (low - p) / d, (low + size - p) / d
        inside = (p >= low) & (p <= low + size)
        lo = F.when(d != 0, F.least(t0, t1)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0))
        hi = F.when(d != 0, F.greatest(t0, t1)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))
        return lo, hi

    lx, hx = span(a["x"], b["x"], box["x"], box["width"])
    ly, hy = span(a["y"], b["y"], box["y"], box["height"])
    return F.greatest(lx, ly, F.lit(0.0)) <= F.least(hx, hy, F.lit(1.0))


def polygon_overlaps_box(points: Column, box: Column) -> Column:
    x2, y2 = box["x"] + box["width"], box["y"] + box["height"]
    corners = F.array(
        *[F.struct(x.alias("x"), y.alias("y")) for x in (box["x"], x2) for y in (box["y"], y2)]
    )
    corner_in = F.exists(corners, lambda c: point_in_polygon(points, c["x"], c["y"]))
    edge_in = F.exists(_edges(points), lambda e: _edge_meets_box(e, box))
    return (F.size(points) >= 3) & (corner_in | edge_in)


MIN_DOWNSCALE_RATIO = 1.15


def effective_dpi(w, h, placed_w, placed_h, page_w, page_h) -> Column:
    """Resolution on paper: by placed size the lower axis, by page size the higher."""
    placed = (placed_w > 0) & (placed_h > 0)
    by_page = F.greatest(
        F.when(page_w > 0, w / page_w * 72).otherwise(0.0),
        F.when(page_h > 0, h / page_h * 72).otherwise(0.0),
    )
    return F.when(placed, F.least(w / placed_w * 72, h / placed_h * 72)).otherwise(by_page)


def target_pixels(w, h, placed_w, placed_h, page_w, page_h, dpi) -> Column:
    def wanted(points):
        return F.greatest(F.lit(1), js_round(points / 72 * dpi))

    placed = (placed_w > 0) & (placed_h > 0)
    pw, ph = wanted(placed_w), wanted(placed_h)
    shrink = F.least(w / pw, h / ph) >= MIN_DOWNSCALE_RATIO
    by_page = F.least(w, wanted(page_w)) * F.least(h, wanted(page_h))
    return (
        F.when(placed & shrink, F.least(w, pw) * F.least(h, ph))
        .when(placed, w * h)
        .otherwise(by_page)
        .cast("bigint")
    )


def projected_bytes(pixels: Column, quality: Column) -> Column:
    """Size model of a re-encoded picture (fixed coefficients)."""
    q = F.least(F.lit(0.95), F.greatest(F.lit(0.1), quality))
    per = F.greatest(F.lit(1.0), F.lit(16.167) - q * 42.6025 + q * q * 43.6)
    return F.when(pixels <= 0, F.lit(0.0)).otherwise(per * F.pow(pixels, F.lit(0.6)))


def _size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))


def scaled(w: Column, h: Column, scale: Column) -> Column:
    one = F.lit(1)
    return _size(F.greatest(one, js_round(w * scale)), F.greatest(one, js_round(h * scale)))


def fit_within(w: Column, h: Column, longest: Column) -> Column:
    one = F.lit(1)
    w, h = F.greatest(one, js_round(w)), F.greatest(one, js_round(h))
    side = F.greatest(w, h)
    free = longest.isNull() | (longest <= 0) | (side <= longest)
    return F.when(free, _size(w, h)).otherwise(scaled(w, h, longest / side))


def exact_output_size(w: Column, h: Column, want_w: Column, want_h: Column) -> Column:
    """Exact sides within 1..16384; a missing side follows the aspect; none → NULL."""
    one = F.lit(1)
    ww = F.when(want_w.between(1, 16384), want_w)
    wh = F.when(want_h.between(1, 16384), want_h)
    return (
        F.when(ww.isNotNull() & wh.isNotNull(), _size(ww, wh))
        .when(ww.isNotNull(), _size(ww, F.greatest(one, js_round(h * ww / w))))
        .when(wh.isNotNull(), _size(F.greatest(one, js_round(w * wh / h)), wh))
    )
