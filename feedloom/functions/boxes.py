"""Box arithmetic on struct columns with ymin, xmin, ymax, xmax."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.hashing import unit

SIDES = ("ymin", "xmin", "ymax", "xmax")
# Fixed value: largest log size ratio when decoding.
MAX_LOG_SIZE = math.log(1000.0 / 16.0)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def box(ymin="ymin", xmin="xmin", ymax="ymax", xmax="xmax") -> Column:
    """Four columns as one box."""
    return F.struct(*[_c(v).alias(n) for n, v in zip(SIDES, (ymin, xmin, ymax, xmax))])


def _sides(b) -> list[Column]:
    b = _c(b)
    return [b[s] for s in SIDES]


def height(b) -> Column:
    return _c(b)["ymax"] - _c(b)["ymin"]


def width(b) -> Column:
    return _c(b)["xmax"] - _c(b)["xmin"]


def area(b) -> Column:
    return height(b) * width(b)


def to_xywh(b) -> Column:
    """Corner and size: x, y, w, h."""
    y, x, _, _ = _sides(b)
    return F.struct(x.alias("x"), y.alias("y"), width(b).alias("w"), height(b).alias("h"))


def normalize(b, image_h, image_w) -> Column:
    h, w = _num(image_h), _num(image_w)
    y0, x0, y1, x1 = _sides(b)
    return box(y0 / h, x0 / w, y1 / h, x1 / w)


def denormalize(b, image_h, image_w) -> Column:
    h, w = _num(image_h), _num(image_w)
    y0, x0, y1, x1 = _sides(b)
    return box(y0 * h, x0 * w, y1 * h, x1 * w)


def clip(b, image_h, image_w) -> Column:
    return clip_to(b, (0.0, 0.0, image_h, image_w))


def clip_to(b, window: Sequence) -> Column:
    """Clamp every side into a (ymin, xmin, ymax, xmax) window."""
    low_y, low_x, high_y, high_x = map(_num, window)
    y0, x0, y1, x1 = _sides(b)
    cut = lambda v, lo, hi: F.greatest(F.least(v, hi), lo)
    return box(cut(y0, low_y, high_y), cut(x0, low_x, high_x), cut(y1, low_y, high_y), cut(x1, low_x, high_x))


def outer(b, image_h, image_w, scale: float) -> Column:
    """Expanded about the centre by ``scale`` (at least 1), then clipped."""
    if scale < 1.0:
        raise ValueError("an outer box cannot be smaller than its box")
    y0, x0, y1, x1 = _sides(b)
    yc, xc = (y0 + y1) / 2.0, (x0 + x1) / 2.0
    h, w = height(b) * scale, width(b) * scale
    return clip(box(yc - h / 2.0, xc - w / 2.0, yc + h / 2.0, xc + w / 2.0), image_h, image_w)


def _centre(b):
    y0, x0, _, _ = _sides(b)
    h, w = height(b), width(b)
    return y0 + 0.5 * h, x0 + 0.5 * w, h, w


def encode(b, anchor, weights: Sequence[float] | None = None) -> Column:
    """Offsets and log sizes relative to an anchor: dy, dx, dh, dw."""
    yc, xc, h, w = _centre(b)
    ayc, axc, ah, aw = _centre(anchor)
    parts = [(yc - ayc) / ah, (xc - axc) / aw, F.ln(h / ah), F.ln(w / aw)]
    if weights:
        parts = [p * k for p, k in zip(parts, weights)]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("dy", "dx", "dh", "dw"))])


def decode(code, anchor, weights: Sequence[float] | None = None) -> Column:
    """Inverse of ``encode``."""
    code = _c(code)
    dy, dx, dh, dw = [code[n] for n in ("dy", "dx", "dh", "dw")]
    if weights:
        dy, dx, dh, dw = [p / k for p, k in zip((dy, dx, dh, dw), weights)]
    ayc, axc, ah, aw = _centre(anchor)
    yc, xc = dy * ah + ayc, dx * aw + axc
    h = F.exp(F.least(dh, F.lit(MAX_LOG_SIZE))) * ah
    w = F.exp(F.least(dw, F.lit(MAX_LOG_SIZE))) * aw
    y0, x0 = yc - 0.5 * h, xc - 0.5 * w
    return box(y0, x0, y0 + h, x0 + w)


EPSILON = 1e-8


def encode_sides(b, anchor, weights: Sequence[float] | None = None) -> Column:
    """Distances of the box sides from the anchor centre, and the centredness."""
    y0, x0, y1, x1 = _sides(b)
    ayc, axc, ah, aw = _centre(anchor)
    ah, aw = ah + EPSILON, aw + EPSILON
    left, right, top, bottom = (axc - x0) / aw, (x1 - axc) / aw, (ayc - y0) / ah, (y1 - ayc) / ah
    inside = F.least(left, right, top, bottom) > 0
    share = lambda p, q: F.least(p, q) / (F.greatest(p, q) + EPSILON)
    centred = F.when(inside, F.sqrt(share(left, right) * share(top, bottom))).otherwise(0.0)
    parts = [left, right, top, bottom]
    if weights:
        parts = [p * k for p, k in zip(parts, weights)]
    names = ("left", "right", "top", "bottom")
    return F.struct(*[p.alias(n) for p, n in zip(parts, names)], centred.alias("centredness"))


def decode_sides(code, anchor, weights: Sequence[float] | None = None) -> Column:
    """Box of an ``encode_sides`` value."""
    code = _c(code)
    parts = [code[n] for n in ("left", "right", "top", "bottom")]
    if weights:
        parts = [p / k for p, k in zip(parts, weights)]
    left, right, top, bottom = parts
    ayc, axc, ah, aw = _centre(anchor)
    ah, aw = ah + EPSILON, aw + EPSILON
    return box(ayc - top * ah, axc - left * aw, ayc + bottom * ah, axc + right * aw)


def jitter(b, noise: float, key, seed: int) -> Column:
    """Centre and size disturbed by normal noise (drawn from the row's key)."""
    def normal(n):  # Box-Muller from two hashed uniforms
        u = F.greatest(unit(key, F.lit(2 * n), seed), F.lit(1e-12))
        angle = unit(key, F.lit(2 * n + 1), seed) * (2 * math.pi)
        return F.sqrt(-2.0 * F.ln(u)) * F.cos(angle) * noise

    yc, xc, h, w = _centre(b)
    xc, yc = xc + normal(0) * w, yc + normal(1) * h
    w, h = w * F.exp(normal(2)), h * F.exp(normal(3))
    return box(yc - h * 0.5, xc - w * 0.5, yc + h * 0.5, xc + w * 0.5)


def flip(b) -> Column:
    """Horizontal flip of a normalised box."""
    y0, x0, y1, x1 = _sides(b)
    return box(y0, 1.0 - x1, y1, 1.0 - x0)


def resize(b, scale_y, scale_x, offset_y, offset_x, out_h, out_w) -> Column:
    """Scale, shift and clip to the output size."""
    y0, x0, y1, x1 = _sides(b)
    sy, sx, oy, ox = map(_num, (scale_y, scale_x, offset_y, offset_x))
    return clip(box(y0 * sy - oy, x0 * sx - ox, y1 * sy - oy, x1 * sx - ox), out_h, out_w)


def to_centre(b) -> Column:
    """Centre and size: xc, yc, w, h."""
    y0, x0, y1, x1 = _sides(b)
    return F.struct(((x0 + x1) / 2).alias("xc"), ((y0 + y1) / 2).alias("yc"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def from_centre(c) -> Column:
    c = _c(c)
    return box(c["yc"] - c["h"] / 2, c["xc"] - c["w"] / 2, c["yc"] + c["h"] / 2, c["xc"] + c["w"] / 2)


def centre_distance(a, b) -> Column:
    """Squared distance of two centre-form boxes."""
    a, b = _c(a), _c(b)
    dx, dy = a["xc"] - b["xc"], a["yc"] - b["yc"]
    return dx * dx + dy * dy


def squared_distance(a, b) -> Column:
    """Squared distance of the four coordinates."""
    return sum(((p - q) * (p - q) for p, q in zip(_sides(a)[1:], _sides(b)[1:])),
               (_c(a)["ymin"] - _c(b)["ymin"]) * (_c(a)["ymin"] - _c(b)["ymin"]))


def intersection(a, b) -> Column:
    a, b = _c(a), _c(b)
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    return F.greatest(h, F.lit(0.0)) * F.greatest(w, F.lit(0.0))


def iou(a, b, epsilon: float = 0.0) -> Column:
    """Intersection over union; 0 where the boxes do not meet."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    ratio = inter / (union + epsilon) if epsilon else F.try_divide(inter, union)
    return F.when(inter > 0, ratio).otherwise(0.0)


def iou_family(a, b) -> Column:
    """Struct of iou, generalised, distance and complete IoU.

    The distance term is added, as the operator this stands for does.
    """
    a, b = _c(a), _c(b)
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    nn = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    plain = F.least(F.greatest(nn(inter, union), F.lit(0.0)), F.lit(1.0))
    hull_h = F.greatest(a["ymax"], b["ymax"]) - F.least(a["ymin"], b["ymin"])
    hull_w = F.greatest(a["xmax"], b["xmax"]) - F.least(a["xmin"], b["xmin"])
    hull = F.abs(hull_h * hull_w)
    generalised = plain - nn(hull - union, hull)
    distance = plain + nn(centre_distance(to_centre(a), to_centre(b)), hull_h * hull_h + hull_w * hull_w)
    turn = F.atan(nn(width(a), height(a))) - F.atan(nn(width(b), height(b)))
    v = 4 * (turn * turn) / F.lit(math.pi**2)
    complete = distance + v * nn(v, (1 - plain) + v)
    return F.struct(plain.alias("iou"), generalised.alias("giou"), distance.alias("diou"), complete.alias("ciou"))


def best_anchors(b, anchors: Sequence[tuple[float, float]], image_w: float, image_h: float,
                 least: float = 0.213, most: int = 6) -> Column:
    """Anchor numbers by size overlap, best first; later ones under ``least`` become -1.

    ``anchors`` are (width, height) pairs of a fixed configuration list.
    """
    w, h = width(b), height(b)
    scored = []
    for i, (aw, ah) in enumerate(anchors):
        aw, ah = aw / image_w, ah / image_h
        inter = F.least(w, F.lit(aw)) * F.least(h, F.lit(ah))
        ratio = inter / (w * h + aw * ah - inter + 1e-7)
        scored.append(F.struct((-ratio).alias("n"), F.lit(i).alias("i")))
    ordered = F.slice(F.array_sort(F.array(*scored)), 1, most)
    return F.transform(ordered, lambda e, k: F.when((k == 0) | (e["n"] < -least), e["i"]).otherwise(-1))


def keypoints_flip(points, order: Sequence[int], flip_x: float) -> Column:
    """Mirror points (array of y, x) about ``flip_x`` and reorder left/right ones."""
    points = _c(points)
    picked = F.array(*[F.get(points, F.lit(i)) for i in order])
    return F.transform(picked, lambda p: F.struct(p["y"].alias("y"), (flip_x * 2.0 - p["x"]).alias("x")))


def keypoints_frame(points, window: Sequence[float]) -> Column:
    """Points relative to a (ymin, xmin, ymax, xmax) window of unit size."""
    y0, x0, y1, x1 = window
    return F.transform(_c(points), lambda p: F.struct(
        ((p["y"] - y0) * (1.0 / (y1 - y0))).alias("y"), ((p["x"] - x0) * (1.0 / (x1 - x0))).alias("x")))


def keypoints_prune(points, window: Sequence[float]) -> Column:
    """Points outside the window become null."""
    y0, x0, y1, x1 = window
    inside = lambda p: p["y"].between(y0, y1) & p["x"].between(x0, x1)
    return F.transform(_c(points), lambda p: F.struct(
        F.when(inside(p), p["y"]).alias("y"), F.when(inside(p), p["x"]).alias("x")))


def keypoints_scale(points, scale_y: float, scale_x: float) -> Column:
    return F.transform(_c(points), lambda p: F.struct((p["y"] * scale_y).alias("y"), (p["x"] * scale_x).alias("x")))
