"""Registered queries: boxes, matching, suppression, detection and multi-label metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions import boxes as B
from feedloom.functions.hashing import mix
from feedloom.operators import detection as D
from feedloom.plans.answers_queries import rounded
from feedloom.plans.catalog import check
from feedloom.plans.tables import h_sql

CELL = 64.0


def flat(df, struct, names, digits=9):
    return df.select(*[c for c in df.columns if c != struct], *[F.round(F.col(f"{struct}.{n}"), digits).alias(n) for n in names])


def with_box(t):
    return t.boxes.select("image_id", "box_id", B.box().alias("b"))


def truths(t):
    return t.boxes.filter("is_truth").drop("is_truth")


def predictions(t):
    return t.boxes.filter("NOT is_truth").drop("is_truth")


# --- box arithmetic ------------------------------------------------------------------------


@check("box_yxyx_to_xywh", "boxes", "SELECT image_id, box_id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h FROM boxes")
def _(t):
    return flat(with_box(t).withColumn("o", B.to_xywh("b")).drop("b"), "o", ("x", "y", "w", "h"))


@check("box_normalize", "boxes", """
SELECT image_id, box_id, round(ymin / 560, 9) AS ymin, round(xmin / 570, 9) AS xmin, round(ymax / 560, 9) AS ymax, round(xmax / 570, 9) AS xmax FROM boxes""")
def _(t):
    return flat(with_box(t).withColumn("o", B.normalize("b", 560, 570)).drop("b"), "o", B.SIDES)


@check("box_denormalize", "boxes", "SELECT image_id, box_id, ymin, xmin, ymax, xmax FROM boxes")
def _(t):
    rows = with_box(t).withColumn("n", B.normalize("b", 560, 570))
    return flat(rows.withColumn("o", B.denormalize("n", 560, 570)).drop("b", "n"), "o", B.SIDES, 6)


@check("box_clip", "boxes", """
SELECT image_id, box_id, greatest(least(ymin, 300), 0)::DOUBLE AS ymin, greatest(least(xmin, 280), 0)::DOUBLE AS xmin,
  greatest(least(ymax, 300), 0)::DOUBLE AS ymax, greatest(least(xmax, 280), 0)::DOUBLE AS xmax FROM boxes""")
def _(t):
    return flat(with_box(t).withColumn("o", B.clip("b", 300, 280)).drop("b"), "o", B.SIDES)


@check("box_outer", "boxes", """
WITH c AS (SELECT image_id, box_id, (ymin + ymax) / 2 AS yc, (xmin + xmax) / 2 AS xc, (ymax - ymin) * 1.5 AS h, (xmax - xmin) * 1.5 AS w FROM boxes)
SELECT image_id, box_id, round(greatest(least(yc - h / 2, 520), 0), 9) AS ymin, round(greatest(least(xc - w / 2, 530), 0), 9) AS xmin,
  round(greatest(least(yc + h / 2, 520), 0), 9) AS ymax, round(greatest(least(xc + w / 2, 530), 0), 9) AS xmax FROM c""")
def _(t):
    return flat(with_box(t).withColumn("o", B.outer("b", 520, 530, 1.5)).drop("b"), "o", B.SIDES)


ANCHOR_SQL = """a AS (SELECT *, ymin + 0.5 * (ymax - ymin) AS yc, xmin + 0.5 * (xmax - xmin) AS xc, ymax - ymin AS h, xmax - xmin AS w,
  32.0 * floor(ymin / 32) + 16 AS ayc, 32.0 * floor(xmin / 32) + 16 AS axc, 32.0::DOUBLE AS ah, 32.0::DOUBLE AS aw FROM boxes)"""


def with_anchor(t):
    low = lambda c: 32.0 * F.floor(F.col(c) / 32)
    return t.boxes.select(
        "image_id", "box_id", B.box().alias("b"), B.box(low("ymin"), low("xmin"), low("ymin") + 32, low("xmin") + 32).alias("a"))


@check("box_encode", "boxes", f"""
WITH {ANCHOR_SQL} SELECT image_id, box_id, round((yc - ayc) / ah * 10, 9) AS dy, round((xc - axc) / aw * 10, 9) AS dx,
  round(ln(h / ah) * 5, 9) AS dh, round(ln(w / aw) * 5, 9) AS dw FROM a""")
def _(t):
    rows = with_anchor(t).withColumn("o", B.encode("b", "a", [10, 10, 5, 5]))
    return flat(rows.drop("a", "b"), "o", ("dy", "dx", "dh", "dw"))


@check("box_decode", "boxes", """
SELECT image_id, box_id, ymin, xmin, ymax, xmax FROM boxes""")
def _(t):
    """Encoded and decoded again, every box is what it was."""
    rows = with_anchor(t).withColumn("e", B.encode("b", "a", [10, 10, 5, 5]))
    return flat(rows.withColumn("o", B.decode("e", "a", [10, 10, 5, 5])).drop("a", "b", "e"), "o", B.SIDES, 6)


@check("box_encode_sides", "boxes", f"""
WITH {ANCHOR_SQL}, s AS (SELECT image_id, box_id, (axc - xmin) / (aw + 1e-8) AS l, (xmax - axc) / (aw + 1e-8) AS r, (ayc - ymin) / (ah + 1e-8) AS t, (ymax - ayc) / (ah + 1e-8) AS b FROM a)
SELECT image_id, box_id, round(l, 9) AS "left", round(r, 9) AS "right", round(t, 9) AS top, round(b, 9) AS bottom,
  round(CASE WHEN least(l, r, t, b) > 0 THEN sqrt(least(l, r) / (greatest(l, r) + 1e-8) * (least(t, b) / (greatest(t, b) + 1e-8))) ELSE 0 END, 9) AS centredness FROM s""")
def _(t):
    rows = with_anchor(t).withColumn("o", B.encode_sides("b", "a"))
    return flat(rows.drop("a", "b"), "o", ("left", "right", "top", "bottom", "centredness"))


@check("box_decode_sides", "boxes", "SELECT image_id, box_id, ymin, xmin, ymax, xmax FROM boxes")
def _(t):
    rows = with_anchor(t).withColumn("e", B.encode_sides("b", "a"))
    return flat(rows.withColumn("o", B.decode_sides("e", "a")).drop("a", "b", "e"), "o", B.SIDES, 6)


@check("box_jitter")
def _(t):
    return flat(with_box(t).withColumn("o", B.jitter("b", 0.025, "box_id", 5)).drop("b"), "o", B.SIDES, 6)


@check("box_flip", "boxes", """
SELECT image_id, box_id, round(ymin / 600, 9) AS ymin, round(1.0 - xmax / 600, 9) AS xmin, round(ymax / 600, 9) AS ymax, round(1.0 - xmin / 600, 9) AS xmax FROM boxes""")
def _(t):
    return flat(with_box(t).withColumn("o", B.flip(B.normalize("b", 600, 600))).drop("b"), "o", B.SIDES)


@check("box_resize", "boxes", """
SELECT image_id, box_id, round(greatest(least(ymin * 1.5 - 20, 640), 0), 9) AS ymin, round(greatest(least(xmin * 0.5 - 10, 640), 0), 9) AS xmin,
  round(greatest(least(ymax * 1.5 - 20, 640), 0), 9) AS ymax, round(greatest(least(xmax * 0.5 - 10, 640), 0), 9) AS xmax FROM boxes""")
def _(t):
    return flat(with_box(t).withColumn("o", B.resize("b", 1.5, 0.5, 20, 10, 640, 640)).drop("b"), "o", B.SIDES)


@check("box_centre_form", "boxes", """
SELECT image_id, box_id, (xmin + xmax) / 2 AS xc, (ymin + ymax) / 2 AS yc, xmax - xmin AS w, ymax - ymin AS h,
  round(((xmin + xmax) / 2 - 250) * ((xmin + xmax) / 2 - 250) + ((ymin + ymax) / 2 - 250) * ((ymin + ymax) / 2 - 250), 6) AS dist, ymin, xmax FROM boxes""")
def _(t):
    mid = F.struct(F.lit(250.0).alias("xc"), F.lit(250.0).alias("yc"))
    rows = with_box(t).withColumn("c", B.to_centre("b"))
    back = B.from_centre("c")
    rows = rows.select("image_id", "box_id", "c.*", F.round(B.centre_distance("c", mid), 6).alias("dist"), back["ymin"].alias("ymin"), back["xmax"].alias("xmax"))
    return rows


# --- pairs ---------------------------------------------------------------------------------

PAIR_SQL = """pr AS (SELECT a.image_id, a.box_id AS a_id, b.box_id AS b_id, a.class AS a_class, b.class AS b_class, a.score AS a_score, b.score AS b_score,
    b.ymin AS bymin, b.xmin AS bxmin, b.ymax AS bymax, b.xmax AS bxmax, a.ymin AS aymin, a.xmin AS axmin, a.ymax AS aymax, a.xmax AS axmax,
    (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) * (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) AS inter,
    (a.ymax - a.ymin) * (a.xmax - a.xmin) AS area_a, (b.ymax - b.ymin) * (b.xmax - b.xmin) AS area_b
  FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND NOT a.is_truth AND b.is_truth
  WHERE least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin) AND least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin)),
io AS (SELECT *, inter / (area_a + area_b - inter) AS iou, inter / (area_a + area_b - inter + 1e-8) AS iou_e FROM pr)"""


@check("pairwise_iou_join", "boxes", f"WITH {PAIR_SQL} SELECT image_id, a_id, b_id, round(iou, 9) AS iou FROM io")
def _(t):
    pairs = D.pairwise_iou(predictions(t), truths(t), cell=CELL)
    return pairs.select("image_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), F.round("iou", 9).alias("iou"))


@check("iou_family", "boxes", f"""
WITH {PAIR_SQL}, h AS (SELECT *, greatest(aymax, bymax) - least(aymin, bymin) AS hh, greatest(axmax, bxmax) - least(axmin, bxmin) AS hw,
  area_a + area_b - inter AS un FROM io),
d AS (SELECT *, iou + (pow((axmin + axmax) / 2 - (bxmin + bxmax) / 2, 2) + pow((aymin + aymax) / 2 - (bymin + bymax) / 2, 2)) / (hh * hh + hw * hw) AS diou,
  4 * pow(atan((axmax - axmin) / (aymax - aymin)) - atan((bxmax - bxmin) / (bymax - bymin)), 2) / pow(pi(), 2) AS v FROM h)
SELECT image_id, a_id, b_id, round(iou, 9) AS iou, round(iou - (hh * hw - un) / (hh * hw), 9) AS giou, round(diou, 9) AS diou,
  round(diou + CASE WHEN 1 - iou + v > 0 THEN v * (v / (1 - iou + v)) ELSE 0 END, 9) AS ciou FROM d""")
def _(t):
    pairs = D.overlapping_pairs(predictions(t), truths(t), cell=CELL)
    rows = pairs.select("image_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), B.iou_family("a", "b").alias("o"))
    return flat(rows, "o", ("iou", "giou", "diou", "ciou"))


@check("box_sq_dist", "boxes", f"""
WITH {PAIR_SQL} SELECT image_id, a_id, b_id, round(pow(aymin - bymin, 2) + pow(axmin - bxmin, 2) + pow(aymax - bymax, 2) + pow(axmax - bxmax, 2), 6) AS dist FROM io""")
def _(t):
    pairs = D.overlapping_pairs(predictions(t), truths(t), cell=CELL)
    return pairs.select("image_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), F.round(B.squared_distance("a", "b"), 6).alias("dist"))


MATCH_SQL = PAIR_SQL + """, bm AS (SELECT b.image_id, b.box_id, coalesce(m.b_id, -1) AS match_id, coalesce(m.b_class, 0) AS match_class, coalesce(m.bymin, 0) AS ymin, coalesce(m.iou_e, 0) AS iou
  FROM boxes b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id, a_id ORDER BY iou_e DESC, b_id) AS r FROM io) m
  ON m.image_id = b.image_id AND m.a_id = b.box_id AND r = 1 WHERE NOT b.is_truth)"""


@check("box_matching", "boxes", f"WITH {MATCH_SQL} SELECT image_id, box_id, match_id, match_class, ymin, round(iou, 9) AS iou FROM bm")
def _(t):
    out = D.box_matching(predictions(t), truths(t), CELL)
    return out.select("image_id", "box_id", "match_id", "match_class", F.col("match_box.ymin").alias("ymin"), F.round("iou", 9).alias("iou"))


THRESHOLD_SQL = PAIR_SQL + """, bt AS (SELECT image_id, a_id AS box_id, b_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY image_id, a_id ORDER BY iou DESC, b_id) AS r FROM io) WHERE r = 1),
th AS (SELECT b.image_id, b.box_id, CASE WHEN coalesce(iou, 0) < 0.2 THEN -1 WHEN iou < 0.4 THEN -2 ELSE b_id END AS match_id
  FROM boxes b LEFT JOIN bt ON bt.image_id = b.image_id AND bt.box_id = b.box_id WHERE NOT b.is_truth),
fi AS (SELECT image_id, min(box_id) AS box_id FROM boxes WHERE NOT is_truth GROUP BY 1),
wa AS (SELECT image_id, b_id, a_id AS box_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, b_id ORDER BY iou DESC, a_id) AS r FROM io) WHERE r = 1
  UNION ALL SELECT t.image_id, t.box_id, fi.box_id FROM boxes t JOIN fi ON fi.image_id = t.image_id WHERE is_truth AND (t.image_id, t.box_id) NOT IN (SELECT (image_id, b_id) FROM io)),
fo AS (SELECT image_id, box_id, min(b_id) AS f FROM wa GROUP BY 1, 2),
mt AS (SELECT th.image_id, th.box_id, coalesce(f, match_id) AS match_id FROM th LEFT JOIN fo ON fo.image_id = th.image_id AND fo.box_id = th.box_id)"""


@check("match_thresholds", "boxes", f"WITH {THRESHOLD_SQL} SELECT image_id, box_id, match_id FROM mt")
def _(t):
    return D.match_thresholds(predictions(t), truths(t), 0.4, 0.2, force=True, cell=CELL)


@check("target_assign", "boxes", f"""
WITH {THRESHOLD_SQL}, j AS (SELECT mt.*, t.class, a.ymin AS ay0, a.xmin AS ax0, a.ymax - a.ymin AS ah, a.xmax - a.xmin AS aw, t.ymin AS ty0, t.xmin AS tx0, t.ymax - t.ymin AS h, t.xmax - t.xmin AS w
  FROM mt JOIN boxes a ON a.image_id = mt.image_id AND a.box_id = mt.box_id LEFT JOIN boxes t ON t.image_id = mt.image_id AND t.box_id = match_id AND t.is_truth)
SELECT image_id, box_id, coalesce(class, 0) AS cls_target, round(coalesce((ty0 + 0.5 * h - ay0 - 0.5 * ah) / ah, 0), 6) AS dy, round(coalesce((tx0 + 0.5 * w - ax0 - 0.5 * aw) / aw, 0), 6) AS dx,
  round(coalesce(ln(h / ah), 0), 6) AS dh, round(coalesce(ln(w / aw), 0), 6) AS dw, CASE WHEN match_id = -2 THEN 0.0 ELSE 1.0 END::DOUBLE AS cls_weight, CASE WHEN match_id >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reg_weight FROM j""")
def _(t):
    anchors, gts = predictions(t), truths(t)
    matches = D.match_thresholds(anchors, gts, 0.4, 0.2, force=True, cell=CELL)
    return rounded(D.target_assign(anchors, gts, matches), 6)


ANCHORS = [(10, 13), (16, 30), (33, 23), (30, 61), (62, 45), (59, 119), (8, 8)]


@check("best_anchor", "boxes", """
WITH an AS (SELECT i - 1 AS i, [10, 16, 33, 30, 62, 59, 8][i] / 600.0::DOUBLE AS aw, [13, 30, 23, 61, 45, 119, 8][i] / 600.0::DOUBLE AS ah FROM range(1, 8) r(i)),
s AS (SELECT image_id, box_id, i, least((xmax / 600 - xmin / 600), aw) * least((ymax / 600 - ymin / 600), ah) AS n, (xmax / 600 - xmin / 600) * (ymax / 600 - ymin / 600) AS ar, aw * ah AS aa FROM boxes, an),
k AS (SELECT image_id, box_id, i, n / (ar + aa - n + 1e-7) AS iou, row_number() OVER (PARTITION BY image_id, box_id ORDER BY n / (ar + aa - n + 1e-7) DESC, i) AS r FROM s)
SELECT image_id, box_id, array_to_string(list(CASE WHEN r = 1 OR iou > 0.213 THEN i ELSE -1 END ORDER BY r), ',') AS anchors FROM k WHERE r <= 6 GROUP BY 1, 2""")
def _(t):
    rows = with_box(t).withColumn("n", B.normalize("b", 600, 600))
    best = B.best_anchors("n", ANCHORS, 600.0, 600.0)
    return rows.select("image_id", "box_id", F.array_join(best.cast("array<string>"), ",").alias("anchors"))


# --- suppression ---------------------------------------------------------------------------


@check("nms")
def _(t):
    return D.nms(t.boxes, 0.1, 40, cell=CELL).select("image_id", "box_id", "place")


@check("box_voting", "boxes", """
WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS r FROM boxes) WHERE r <= 10),
p AS (SELECT k.image_id, k.box_id, b.ymin, b.xmin, b.ymax, b.xmax, b.score,
  (least(k.ymax, b.ymax) - greatest(k.ymin, b.ymin)) * (least(k.xmax, b.xmax) - greatest(k.xmin, b.xmin)) AS inter,
  (k.ymax - k.ymin) * (k.xmax - k.xmin) + (b.ymax - b.ymin) * (b.xmax - b.xmin) AS areas
  FROM k JOIN boxes b ON k.image_id = b.image_id WHERE least(k.ymax, b.ymax) > greatest(k.ymin, b.ymin) AND least(k.xmax, b.xmax) > greatest(k.xmin, b.xmin))
SELECT image_id, box_id, round(sum(ymin * score) / sum(score), 6) AS ymin, round(sum(xmin * score) / sum(score), 6) AS xmin,
  round(sum(ymax * score) / sum(score), 6) AS ymax, round(sum(xmax * score) / sum(score), 6) AS xmax, round(avg(score), 9) AS score
FROM p WHERE inter / (areas - inter) > 0.1 GROUP BY 1, 2""")
def _(t):
    from feedloom.operators.ordered import top_rows

    kept = top_rows(t.boxes, 10, [F.desc("score"), "box_id"], ["image_id"]).drop("rank")
    out = D.box_voting(kept, t.boxes, 0.1, CELL)
    return out.select("image_id", "box_id", *[F.round(c, 6).alias(c) for c in B.SIDES], F.round("score", 9).alias("score"))


@check("refine_boxes")
def _(t):
    return rounded(D.refine_boxes(predictions(t), 0.1, 20, 0.1, CELL), 6)


# --- filters -------------------------------------------------------------------------------


@check("filter_boxes", "boxes", """
WITH k AS (SELECT *, ymax - ymin > 10 AND xmax - xmin > 10 AND ymin + 0.5 * (ymax - ymin) > 0 AND ymin + 0.5 * (ymax - ymin) < 400
  AND xmin + 0.5 * (xmax - xmin) > 0 AND xmin + 0.5 * (xmax - xmin) < 450 AS ok FROM boxes)
SELECT image_id, box_id, CASE WHEN ok THEN ymin ELSE 0 END AS ymin, CASE WHEN ok THEN xmax ELSE 0 END AS xmax, CASE WHEN ok THEN score ELSE 0 END AS score FROM k""")
def _(t):
    return D.filter_boxes(t.boxes, 10, 400, 450).select("image_id", "box_id", "ymin", "xmax", "score")


@check("filter_boxes_by_score", "boxes", """
SELECT image_id, box_id, CASE WHEN score > 0.05 THEN ymin ELSE 0 END AS ymin, CASE WHEN score > 0.05 THEN score ELSE -1 END AS score FROM boxes""")
def _(t):
    return D.filter_by_score(t.boxes, 0.05).select("image_id", "box_id", "ymin", "score")


WINDOW = (50.0, 60.0, 400.0, 420.0)


@check("prune_outside", "boxes", """
SELECT image_id, box_id FROM boxes WHERE ymin >= 50 AND xmin >= 60 AND ymax <= 400 AND xmax <= 420""")
def _(t):
    return D.prune_outside(t.boxes, WINDOW).select("image_id", "box_id")


@check("prune_completely_outside", "boxes", """
SELECT image_id, box_id FROM boxes WHERE NOT (ymin >= 400 OR xmin >= 420 OR ymax <= 50 OR xmax <= 60)""")
def _(t):
    return D.prune_outside(t.boxes, WINDOW, completely=True).select("image_id", "box_id")


@check("prune_non_overlapping", "boxes", f"""
WITH {PAIR_SQL} SELECT DISTINCT image_id, a_id AS box_id FROM io WHERE inter / area_a >= 0.3""")
def _(t):
    return D.prune_non_overlapping(predictions(t), truths(t), 0.3, CELL).select("image_id", "box_id")


@check("prune_small", "boxes", "SELECT image_id, box_id FROM boxes WHERE ymax - ymin >= 12 AND xmax - xmin >= 12")
def _(t):
    return D.prune_small(t.boxes, 12).select("image_id", "box_id")


@check("clip_to_window", "boxes", """
WITH c AS (SELECT image_id, box_id, greatest(least(ymin, 400), 50) AS ymin, greatest(least(xmin, 420), 60) AS xmin, greatest(least(ymax, 400), 50) AS ymax, greatest(least(xmax, 420), 60) AS xmax FROM boxes)
SELECT * FROM c WHERE (ymax - ymin) * (xmax - xmin) > 0""")
def _(t):
    return D.clip_boxes(t.boxes, WINDOW).select("image_id", "box_id", *B.SIDES)


@check("change_frame", "boxes", """
SELECT image_id, box_id, round((ymin - 50) / 350, 9) AS ymin, round((xmin - 60) / 360, 9) AS xmin, round((ymax - 50) / 350, 9) AS ymax, round((xmax - 60) / 360, 9) AS xmax FROM boxes""")
def _(t):
    return rounded(D.change_frame(t.boxes, WINDOW).select("image_id", "box_id", *B.SIDES), 9)


@check("covering_box", "boxes", "SELECT image_id, min(ymin) AS ymin, min(xmin) AS xmin, max(ymax) AS ymax, max(xmax) AS xmax FROM boxes GROUP BY 1")
def _(t):
    return D.covering_box(t.boxes)


@check("box_list_sort_and_filter", "boxes", """
SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) - 1 AS place FROM boxes WHERE class = 3 AND score > 0.02""")
def _(t):
    from feedloom.operators.ordered import with_position

    rows = t.boxes.filter("class = 3 AND score > 0.02").select("image_id", "box_id", "score")
    return with_position(rows, [-F.col("score"), "box_id"], ["image_id"], "place").drop("score")


def points(t):
    return t.boxes.select("image_id", "box_id", F.array(
        F.struct(F.col("ymin").alias("y"), F.col("xmin").alias("x")), F.struct(F.col("ymax").alias("y"), F.col("xmax").alias("x"))).alias("p"))


@check("keypoint_ops", "boxes", """
SELECT image_id, box_id, ymax AS flip_y, 250.0 * 2 - xmax AS flip_x, round((ymin - 50) * (1.0 / 350), 9) AS frame_y, round((xmin - 60) * (1.0 / 360), 9) AS frame_x,
  CASE WHEN ymin BETWEEN 50 AND 400 AND xmin BETWEEN 60 AND 420 THEN ymin ELSE -1 END AS kept_y, ymin * 2 AS big_y, xmin * 3 AS big_x FROM boxes""")
def _(t):
    first = lambda a, c: F.get(a, F.lit(0))[c]
    p = points(t)
    flipped, frame = B.keypoints_flip("p", [1, 0], 250.0), B.keypoints_frame("p", WINDOW)
    scaled, kept = B.keypoints_scale("p", 2.0, 3.0), B.keypoints_prune("p", WINDOW)
    return p.select(
        "image_id", "box_id", first(flipped, "y").alias("flip_y"), first(flipped, "x").alias("flip_x"),
        F.round(first(frame, "y"), 9).alias("frame_y"), F.round(first(frame, "x"), 9).alias("frame_x"),
        F.coalesce(first(kept, "y"), F.lit(-1.0)).alias("kept_y"), first(scaled, "y").alias("big_y"), first(scaled, "x").alias("big_x"),
    )


# --- annotation tables ---------------------------------------------------------------------


def annotations(t):
    return t.boxes.select("image_id", "box_id", "class", F.col("xmin").alias("x"), F.col("ymin").alias("y"),
                          (F.col("xmax") - F.col("xmin") - F.when(F.col("class") == 0, 20).otherwise(0)).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))


@check("annotations_clean", "boxes", """
WITH a AS (SELECT image_id, box_id, xmin AS x, ymin AS y, xmax - xmin - CASE WHEN class = 0 THEN 20 ELSE 0 END AS w, ymax - ymin AS h FROM boxes)
SELECT image_id, box_id, round(x / 520, 9) AS xmin, round((x + w) / 520, 9) AS xmax, round(y / 510, 9) AS ymin, round((y + h) / 510, 9) AS ymax FROM a
WHERE w > 0 AND h > 0 AND x + w <= 520 AND y + h <= 510""")
def _(t):
    out = D.clean_annotations(annotations(t), 510, 520).filter("valid")
    return rounded(out.select("image_id", "box_id", "xmin", "xmax", "ymin", "ymax"), 9)


@check("annotations_skipped", "boxes", """
WITH a AS (SELECT image_id, xmin AS x, ymin AS y, xmax - xmin - CASE WHEN class = 0 THEN 20 ELSE 0 END AS w, ymax - ymin AS h FROM boxes)
SELECT count(*) FILTER (WHERE NOT (w > 0 AND h > 0 AND x + w <= 520 AND y + h <= 510)) AS skipped, count(*) AS total FROM a""")
def _(t):
    return D.clean_annotations(annotations(t), 510, 520).agg(F.count_if(~F.col("valid")).alias("skipped"), F.count("*").alias("total"))


@check("annotations_nested", "boxes", """
SELECT image_id, ((j - 1) // 1000)::INT AS part, array_to_string(list(class ORDER BY box_id), ',') AS classes, count(*) AS n,
       round(list_sum(list(xmin * ((j - 1) % 1000 + 1) ORDER BY box_id)), 4) AS check_x
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS j FROM boxes) GROUP BY 1, 2""")
def _(t):
    out = D.nested_annotations(t.boxes, ["box_id"], ["class", "xmin", "ymin"])
    weighted = F.aggregate(F.transform("xmin", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("image_id", "part", F.array_join(F.col("class").cast("array<string>"), ",").alias("classes"),
                      F.size("ymin").cast("bigint").alias("n"), F.round(weighted, 4).alias("check_x"))


FEW_SQL = f"""pk AS (SELECT image_id, box_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {h_sql('box_id', 'image_id', 17)}, box_id, image_id) AS r
  FROM boxes WHERE class IN (1, 2, 3, 5)) WHERE r <= 30)"""


@check("few_shot_split", "boxes", f"WITH {FEW_SQL} SELECT image_id, box_id, class FROM pk")
def _(t):
    images = t.boxes.select("image_id", "class")
    return D.few_shot(t.boxes.select("image_id", "box_id", "class"), images, [1, 2, 3, 5], 30, 17)[0]


@check("few_shot_images", "boxes", f"""
WITH {FEW_SQL} SELECT image_id, max(class) AS class FROM boxes WHERE image_id IN (SELECT image_id FROM pk) GROUP BY 1""")
def _(t):
    images = t.boxes.select("image_id", "class")
    return D.few_shot(t.boxes.select("image_id", "box_id", "class"), images, [1, 2, 3, 5], 30, 17)[1]


SETS_SQL = f"""rk AS (SELECT 17 AS seed, image_id, box_id, class, row_number() OVER (PARTITION BY class ORDER BY {h_sql('box_id', 'image_id', 17)}, box_id, image_id) AS r FROM boxes WHERE class IN (1, 2, 3, 5)
  UNION ALL SELECT 18, image_id, box_id, class, row_number() OVER (PARTITION BY class ORDER BY {h_sql('box_id', 'image_id', 18)}, box_id, image_id) FROM boxes WHERE class IN (1, 2, 3, 5)),
st AS (SELECT seed, s AS shots, image_id, box_id, class FROM rk, (VALUES (5), (10), (30)) v(s) WHERE r <= s)"""


def few_shot_sets(t):
    rows = t.boxes.select("image_id", "box_id", "class")
    return D.few_shot_sets(rows, t.boxes.select("image_id", "class"), [1, 2, 3, 5], [17, 18], [5, 10, 30])


@check("few_shot_sets", "boxes", f"WITH {SETS_SQL} SELECT seed, shots, image_id, box_id, class FROM st")
def _(t):
    return few_shot_sets(t)[0].select("seed", "shots", "image_id", "box_id", "class")


@check("few_shot_set_images", "boxes", f"""
WITH {SETS_SQL}, im AS (SELECT image_id, max(class) AS class FROM boxes GROUP BY 1)
SELECT DISTINCT seed, shots, im.image_id, im.class FROM st JOIN im USING (image_id)""")
def _(t):
    return few_shot_sets(t)[1].select("seed", "shots", "image_id", "class")


@check("few_shot_metadata", "boxes", f"""
WITH {SETS_SQL} SELECT seed, shots, array_to_string(list_sort(list(DISTINCT class))::VARCHAR[], ',') AS categories, 'v1' AS info FROM st GROUP BY 1, 2""")
def _(t):
    """The parts of a set, one a class, carry the list of the set's classes; a set whose parts disagree is an error."""
    parts = few_shot_sets(t)[0].select("seed", "shots", "class").distinct()
    classes = F.array_sort(F.collect_set("class").over(Window.partitionBy("seed", "shots")))
    parts = parts.withColumns({"categories": F.array_join(classes.cast("array<string>"), ","), "info": F.lit("v1")})
    return D.check_metadata(parts, ["seed", "shots"], ["info", "categories"])


@check("coco_tables", "boxes", """
SELECT image_id, box_id, class AS category_id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, (xmax - xmin) * (ymax - ymin) AS area, 0 AS iscrowd,
  row_number() OVER (ORDER BY image_id, box_id) AS id FROM boxes WHERE is_truth""")
def _(t):
    return D.evaluation_rows(truths(t), ["image_id", "box_id"])


def coarse_predictions(rows):
    """Each truth again as a disturbed prediction, so that many overlaps are high."""
    moved = B.jitter(B.box(), 0.12, "box_id", 9)
    score = mix("box_id", 0, 10) / F.lit(2147483647.0)
    rows = rows.select("image_id", "box_id", "class", score.alias("score"), moved.alias("b"))
    return rows.select("image_id", "box_id", "class", "score", "b.*")


@check("coco_map")
def _(t):
    from feedloom.session import staged

    rows = staged(truths(t), "truths")
    packed, positives = D.packed_outcomes(coarse_predictions(rows), rows, cell=CELL)
    return rounded(D.detection_summary(staged(packed), staged(positives)), 6)


# --- multi-label scores --------------------------------------------------------------------


def scores(t):
    """Ten class scores per vector; two true classes."""
    rows = t.vectors.select("vec_id", "label", F.posexplode(F.slice("v", 1, 10)).alias("class", "score"))
    truth = (F.col("class") == F.col("label")) | (F.col("class") == F.col("vec_id") % 7)
    return rows.select("vec_id", "class", "score", truth.cast("int").alias("truth"))


SCORES_SQL = """s AS (SELECT vec_id, i AS class, v[i + 1] AS score, (i = label OR i = vec_id % 7)::INT AS truth FROM (SELECT *, unnest(range(10)) AS i FROM vectors)),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS r FROM s) WHERE r <= 4)"""


@check("hit_at_one", "vectors", f"WITH {SCORES_SQL} SELECT round(avg(truth), 9) AS hit_at_one FROM tk WHERE r = 1")
def _(t):
    return rounded(D.hit_at_one(scores(t), "vec_id"), 9)


@check("perr", "vectors", f"""
WITH {SCORES_SQL}, n AS (SELECT vec_id, sum(truth) AS need FROM s GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS r2 FROM s)
SELECT round(avg(p), 9) AS perr FROM (SELECT k.vec_id, sum(CASE WHEN score > 0 THEN truth ELSE 0 END) / any_value(need) AS p FROM k JOIN n ON n.vec_id = k.vec_id WHERE r2 <= need GROUP BY 1)""")
def _(t):
    return rounded(D.perr(scores(t), "vec_id"), 9)


@check("average_precision", "vectors", f"""
WITH {SCORES_SQL}, k AS (SELECT class, truth, sum(truth) OVER w AS hits, row_number() OVER w AS place FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT class, sum(truth) AS pos FROM s GROUP BY 1)
SELECT class::INT AS class, round(coalesce((SELECT sum(CASE WHEN truth > 0 THEN hits / place ELSE 0 END) FROM k WHERE k.class = p.class AND place <= 50), 0) / least(pos, 50), 9) AS ap FROM p""")
def _(t):
    return rounded(D.average_precision(scores(t), [-F.col("score"), "vec_id"], ["class"], 50), 9)


@check("gap", "vectors", f"""
WITH {SCORES_SQL}, k AS (SELECT truth, sum(truth) OVER w AS hits, row_number() OVER w AS place FROM tk WINDOW w AS (ORDER BY score DESC, vec_id, class ROWS UNBOUNDED PRECEDING))
SELECT round(sum(CASE WHEN truth > 0 THEN hits / place ELSE 0 END) / (SELECT sum(truth) FROM s), 9) AS gap FROM k""")
def _(t):
    return rounded(D.global_ap(scores(t), "vec_id", 4), 9)


@check("mean_ap", "vectors", f"""
WITH {SCORES_SQL}, k AS (SELECT class, truth, sum(truth) OVER w AS hits, row_number() OVER w AS place FROM tk WINDOW w AS (PARTITION BY class ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT class, sum(CASE WHEN truth > 0 THEN hits / place ELSE 0 END) AS gain FROM k GROUP BY 1), p AS (SELECT class, sum(truth) AS pos FROM s GROUP BY 1)
SELECT round(avg(CASE WHEN pos > 0 THEN coalesce(gain, 0) / pos ELSE 0 END), 9) AS map FROM p LEFT JOIN g ON g.class = p.class""")
def _(t):
    return rounded(D.mean_ap(scores(t), "vec_id", 4), 9)


@check("video_segments", "vectors", """
WITH r AS (SELECT vec_id, v, label, (vec_id % 10)::INT AS s0, 20 AS s1 FROM vectors),
g AS (SELECT vec_id, 0 AS segment, s0 AS start, v[s0 + 1:s0 + 5] AS f, [label, (label + 5) % 10] AS l, [1.0, 0.25] AS sc FROM r
  UNION ALL SELECT vec_id, 1, s1, v[s1 + 1:s1 + 5], [(label + 1) % 10], [0.5] FROM r)
SELECT vec_id, segment, start, round(list_sum(f), 6) AS frame_sum, array_to_string(list_transform(range(10), lambda i: CASE WHEN list_contains(l, i) THEN 'x' ELSE '.' END), '') AS weights,
  round(list_sum(list_transform(range(10), lambda i: CASE WHEN list_contains(l, i) THEN sc[list_position(l, i)] * (i + 1) ELSE 0 END)), 6)::DOUBLE AS label_sum FROM g""")
def _(t):
    rows = t.vectors.select(
        "vec_id", "v", F.array((F.col("vec_id") % 10).cast("int"), F.lit(20), (F.col("vec_id") % 10).cast("int")).alias("starts"),
        F.array(F.col("label"), (F.col("label") + 1) % 10, (F.col("label") + 5) % 10).alias("labels"),
        F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25)).alias("scores"),
    )
    out = D.video_segments(rows, "vec_id", "v", "starts", "labels", "scores", 5, 10)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return out.select(
        "vec_id", "segment", "start", F.round(total("frames"), 6).alias("frame_sum"),
        F.array_join(F.transform("weights", lambda w: F.when(w > 0, "x").otherwise(".")), "").alias("weights"),
        F.round(total(F.transform("labels", lambda x, i: x * (i + 1))), 6).alias("label_sum"),
    )
