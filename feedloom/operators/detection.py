"""Annotation tables, box matching, suppression and detection metrics.

Boxes live in long tables (image_id, box_id, ymin, xmin, ymax, xmax, ...). Pairs are found
through a grid, so boxes that do not meet are never paired, and an image of any size is spread
over its cells. Pairs that do not meet have an overlap of 0 and are implied.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import boxes as B
from feedloom.functions.hashing import mix
from feedloom.operators.dataset import dedup_keep_last
from feedloom.operators.joins import nested_lists
from feedloom.operators.ordered import top_rows, with_position, with_running
from feedloom.session import staged


def _in_cells(df: DataFrame, cell: float) -> DataFrame:
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    return df.withColumn("_cy", span("ymin", "ymax")).withColumn("_cx", span("xmin", "xmax"))


def usual_cell(df: DataFrame) -> float:
    """Twice the mean box side: most boxes then touch four cells at most."""
    mean = df.agg(F.avg(F.greatest(F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin")))).first()[0]
    return max(2.0 * float(mean or 1.0), 1e-6)


def overlapping_pairs(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id",), cell: float | None = None
) -> DataFrame:
    """Every pair of meeting boxes with equal keys, once: (keys, a, b) as structs.

    Both sides are dealt to grid cells and joined there; the pair is kept in the one cell that
    holds the top-left corner of the intersection.
    """
    cell = cell or usual_cell(a)
    keys = list(keys)
    fold = lambda df, name: df.select(*keys, "_cy", "_cx", F.struct(*[c for c in df.columns if c not in (*keys, "_cy", "_cx")]).alias(name))
    pairs = fold(_in_cells(a, cell), "a").join(fold(_in_cells(b, cell), "b"), [*keys, "_cy", "_cx"])
    top, left = F.greatest("a.ymin", "b.ymin"), F.greatest("a.xmin", "b.xmin")
    meets = (F.least("a.ymax", "b.ymax") > top) & (F.least("a.xmax", "b.xmax") > left)
    owner = (F.floor(top / cell) == F.col("_cy")) & (F.floor(left / cell) == F.col("_cx"))
    return pairs.filter(meets & owner).drop("_cy", "_cx")


def pairwise_iou(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id",), cell: float | None = None, epsilon: float = 0.0) -> DataFrame:
    """``overlapping_pairs`` with their IoU."""
    return overlapping_pairs(a, b, keys, cell).withColumn("iou", B.iou("a", "b", epsilon))


# --- matching ------------------------------------------------------------------------------


def box_matching(boxes: DataFrame, truths: DataFrame, cell: float | None = None) -> DataFrame:
    """Best truth per box by IoU, the first on ties; background is id -1, class 0, box 0."""
    pairs = pairwise_iou(boxes, truths, cell=cell, epsilon=1e-8)
    best = F.min(F.struct((-F.col("iou")).alias("n"), F.col("b.box_id").alias("id"), F.col("b.class").alias("class"), B.box("b.ymin", "b.xmin", "b.ymax", "b.xmax").alias("box")))
    found = pairs.groupBy("image_id", F.col("a.box_id").alias("box_id")).agg(best.alias("m"))
    zero = B.box(*[F.lit(0.0)] * 4)
    return boxes.join(found, ["image_id", "box_id"], "left").select(
        "image_id", "box_id", F.coalesce("m.id", F.lit(-1)).alias("match_id"),
        F.coalesce("m.class", F.lit(0)).alias("match_class"),
        F.coalesce("m.box", zero).alias("match_box"), F.coalesce(-F.col("m.n"), F.lit(0.0)).alias("iou"),
    )


def match_thresholds(
    anchors: DataFrame, truths: DataFrame, matched: float, unmatched: float | None = None,
    force: bool = False, ignore_low: bool = False, cell: float | None = None,
) -> DataFrame:
    """(image_id, box_id, match_id): truth id, -1 unmatched, or -2 ignored, by two thresholds.

    With ``force`` every truth also takes its best anchor (of equal ones the first; a truth
    that meets no anchor takes the first anchor of the image); of several truths that want the
    same anchor the first one gets it. ``ignore_low`` swaps the roles of -1 and -2.
    """
    unmatched = matched if unmatched is None else unmatched
    low, mid = (-2, -1) if ignore_low else (-1, -2)
    pairs = staged(pairwise_iou(anchors, truths, cell=cell).select(
        "image_id", F.col("a.box_id").alias("box_id"), F.col("b.box_id").alias("truth_id"), "iou"))
    best = pairs.groupBy("image_id", "box_id").agg(F.min(F.struct((-F.col("iou")).alias("n"), "truth_id")).alias("m"))
    value = F.coalesce(-F.col("m.n"), F.lit(0.0))
    result = F.when(value < unmatched, low).when(value < matched, mid).otherwise(F.coalesce("m.truth_id", F.lit(low)))
    keys = anchors.select("image_id", "box_id")
    out = keys.join(best, ["image_id", "box_id"], "left").select("image_id", "box_id", result.alias("match_id"))
    if not force:
        return out
    wanted = pairs.groupBy("image_id", "truth_id").agg(F.min(F.struct((-F.col("iou")).alias("n"), "box_id"))["box_id"].alias("box_id"))
    first = keys.groupBy("image_id").agg(F.min("box_id").alias("box_id"))
    alone = truths.select("image_id", F.col("box_id").alias("truth_id")).join(wanted, ["image_id", "truth_id"], "left_anti")
    wanted = wanted.unionByName(alone.join(first, "image_id"))
    forced = wanted.groupBy("image_id", "box_id").agg(F.min("truth_id").alias("_f"))
    return out.join(forced, ["image_id", "box_id"], "left").select(
        "image_id", "box_id", F.coalesce("_f", "match_id").alias("match_id"))


def target_assign(anchors: DataFrame, truths: DataFrame, matches: DataFrame) -> DataFrame:
    """Class target, regression target and both weights per anchor."""
    t = truths.select("image_id", F.col("box_id").alias("match_id"), F.col("class").alias("_class"), B.box().alias("_truth"))
    rows = anchors.select("image_id", "box_id", B.box().alias("_anchor")).join(matches, ["image_id", "box_id"])
    rows = rows.join(t, ["image_id", "match_id"], "left")
    hit = F.col("match_id") >= 0
    code = B.encode("_truth", "_anchor")
    parts = [F.when(hit, code[n]).otherwise(0.0).alias(n) for n in ("dy", "dx", "dh", "dw")]
    return rows.select(
        "image_id", "box_id", F.when(hit, F.col("_class")).otherwise(0).alias("cls_target"), *parts,
        F.when(F.col("match_id") == -2, 0.0).otherwise(1.0).alias("cls_weight"),
        F.when(hit, 1.0).otherwise(0.0).alias("reg_weight"),
    )


# --- suppression ---------------------------------------------------------------------------


def nms(boxes: DataFrame, threshold: float, most: int, keys: Sequence[str] = ("image_id",), cell: float | None = None) -> DataFrame:
    """Boxes kept by score unless they overlap a kept box; at most ``most`` per key.

    Works on the conflicts only, in rounds: a box no remaining stronger box conflicts with is
    kept, what it conflicts with is dropped, and so on until no conflict remains. That is the
    same result as going through an image box by box, and the rounds needed are the longest
    chain of conflicts, not the number of boxes. Each round's tables are written out.
    """
    keys = list(keys)
    pairs = pairwise_iou(boxes, boxes, keys, cell)
    stronger = (F.col("a.score") > F.col("b.score")) | (
        (F.col("a.score") == F.col("b.score")) & (F.col("a.box_id") < F.col("b.box_id"))
    )
    conflicts = staged(pairs.filter((F.col("iou") > threshold) & stronger).select(
        *keys, F.col("a.box_id").alias("hi"), F.col("b.box_id").alias("lo")), "conflicts")
    dropped = []
    while not conflicts.isEmpty():
        weaker = conflicts.select(*keys, F.col("lo").alias("hi")).distinct()
        safe = conflicts.join(weaker, [*keys, "hi"], "left_anti")
        gone = staged(safe.select(*keys, F.col("lo").alias("box_id")).distinct(), "dropped")
        if gone.isEmpty():
            raise ValueError("box ids must be unique within a key")
        dropped.append(gone)
        rest = conflicts
        for side in ("lo", "hi"):
            rest = rest.join(gone.withColumnRenamed("box_id", side), [*keys, side], "left_anti")
        conflicts = staged(rest, "conflicts")
    kept = boxes
    for gone in dropped:
        kept = kept.join(gone, [*keys, "box_id"], "left_anti")
    return top_rows(kept, most, [F.desc("score"), "box_id"], keys, "place")


def box_voting(kept: DataFrame, pool: DataFrame, threshold: float, cell: float | None = None) -> DataFrame:
    """Kept boxes moved to the score-weighted mean of the pool boxes they overlap."""
    pairs = pairwise_iou(kept, pool, cell=cell).filter(F.col("iou") > threshold)
    s = F.col("b.score")
    mean = [(F.sum(F.col(f"b.{n}") * s) / F.sum(s)).alias(n) for n in B.SIDES]
    return pairs.groupBy("image_id", F.col("a.box_id").alias("box_id")).agg(*mean, F.avg(s).alias("score"))


def refine_boxes(pool: DataFrame, nms_threshold: float, most: int, vote_threshold: float, cell: float | None = None) -> DataFrame:
    """Suppression, then voting over the whole pool."""
    kept = staged(nms(pool, nms_threshold, most, cell=cell))
    return box_voting(kept, pool, vote_threshold, cell)


# --- filters on long box tables ------------------------------------------------------------


def filter_boxes(boxes: DataFrame, least_size: float, image_h: float, image_w: float) -> DataFrame:
    """Zero out boxes not over the size or not centred inside the image, and their scores."""
    h, w = F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin")
    yc, xc = F.col("ymin") + 0.5 * h, F.col("xmin") + 0.5 * w
    least = max(least_size, 0.0)
    keep = (h > least) & (w > least) & (yc > 0) & (yc < image_h) & (xc > 0) & (xc < image_w)
    return boxes.withColumns({c: F.when(keep, F.col(c)).otherwise(0.0) for c in (*B.SIDES, "score")})


def filter_by_score(boxes: DataFrame, least: float) -> DataFrame:
    """Boxes not over the score are zeroed and their score set to -1."""
    keep = F.col("score") > least
    zeroed = {c: F.when(keep, F.col(c)).otherwise(0.0) for c in B.SIDES}
    return boxes.withColumns({**zeroed, "score": F.when(keep, F.col("score")).otherwise(-1.0)})


def prune_outside(boxes: DataFrame, window: Sequence[float], completely: bool = False) -> DataFrame:
    """Drop boxes that reach out of the window, or only those wholly outside."""
    y0, x0, y1, x1 = window
    c = F.col
    if completely:
        out = (c("ymin") >= y1) | (c("xmin") >= x1) | (c("ymax") <= y0) | (c("xmax") <= x0)
    else:
        out = (c("ymin") < y0) | (c("xmin") < x0) | (c("ymax") > y1) | (c("xmax") > x1)
    return boxes.filter(~out)


def prune_non_overlapping(boxes: DataFrame, others: DataFrame, least: float, cell: float | None = None) -> DataFrame:
    """Keep boxes of which some other box covers at least the share ``least``."""
    if least <= 0:
        return boxes
    pairs = overlapping_pairs(boxes, others, cell=cell)
    covered = pairs.filter(B.intersection("a", "b") / B.area("a") >= least)
    return boxes.join(covered.select("image_id", F.col("a.box_id").alias("box_id")).distinct(), ["image_id", "box_id"], "left_semi")


def prune_small(boxes: DataFrame, side: float) -> DataFrame:
    return boxes.filter((F.col("ymax") - F.col("ymin") >= side) & (F.col("xmax") - F.col("xmin") >= side))


def clip_boxes(boxes: DataFrame, window: Sequence[float], drop_empty: bool = True) -> DataFrame:
    cut = B.clip_to(B.box(), window)
    out = boxes.withColumn("_b", cut).withColumns({n: F.col(f"_b.{n}") for n in B.SIDES}).drop("_b")
    return out.filter((F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin")) > 0) if drop_empty else out


def change_frame(boxes: DataFrame, window: Sequence[float]) -> DataFrame:
    """Coordinates relative to the window, whose sides become 1."""
    y0, x0, y1, x1 = window
    move = lambda c, lo, size: (F.col(c) - lo) * (1.0 / size)
    return boxes.withColumns({
        "ymin": move("ymin", y0, y1 - y0), "xmin": move("xmin", x0, x1 - x0),
        "ymax": move("ymax", y0, y1 - y0), "xmax": move("xmax", x0, x1 - x0),
    })


def covering_box(boxes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Smallest box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(F.min("ymin").alias("ymin"), F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax"), F.max("xmax").alias("xmax"))


def clean_annotations(boxes: DataFrame, image_h, image_w) -> DataFrame:
    """Marks unusable annotations (x, y, w, h) and normalises the corners of the others.

    ``valid`` is false for an empty box or one that reaches past the image.
    """
    h, w = (v if isinstance(v, Column) else F.lit(float(v)) for v in (image_h, image_w))
    x, y, bw, bh = (F.col(c) for c in ("x", "y", "w", "h"))
    valid = (bw > 0) & (bh > 0) & (x + bw <= w) & (y + bh <= h)
    return boxes.withColumns({
        "valid": valid, "xmin": x / w, "xmax": (x + bw) / w, "ymin": y / h, "ymax": (y + bh) / h,
    })


def nested_annotations(boxes: DataFrame, order_by: Sequence[str], fields: Sequence[str], most: int = 1000) -> DataFrame:
    """Parallel arrays per image (and part, see ``nested_lists``)."""
    lists = nested_lists(boxes, "image_id", order_by, fields, "_l", most)
    columns = [F.transform("_l", _picker(f)).alias(f) for f in fields]
    return lists.select("image_id", "part", *columns)


def _picker(field: str):
    return lambda e: e[field]


def few_shot(annotations: DataFrame, images: DataFrame, classes: Sequence[int], shots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``shots`` annotations per class picked by a seeded hash, and their images once each."""
    base = annotations.filter(F.col("class").isin(*classes))
    picked = top_rows(base, shots, [mix("box_id", "image_id", seed), "box_id", "image_id"], ["class"]).drop("rank")
    used = images.join(picked.select("image_id").distinct(), "image_id", "left_semi")
    return picked, dedup_keep_last(used, ["image_id"], [c for c in images.columns if c != "image_id"])


def few_shot_sets(
    annotations: DataFrame, images: DataFrame, classes: Sequence[int], seeds: Sequence[int], shots: Sequence[int]
) -> tuple[DataFrame, DataFrame]:
    """:func:`few_shot` for every seed and shot count at once, with the columns ``seed`` and ``shots``.

    Annotations are ranked once a seed and class; a smaller shot count takes the front of the same ranking.
    Each set lists an image once, the last of its entries, whatever number of its annotations were picked.
    """
    base = annotations.filter(F.col("class").isin(*classes)).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    draw = F.coalesce(*[F.when(F.col("seed") == s, mix("box_id", "image_id", s)) for s in seeds])
    ranked = top_rows(base, max(shots), [draw, "box_id", "image_id"], ["seed", "class"])
    reached = F.filter(F.array(*map(F.lit, sorted(shots))), lambda n: n >= F.col("rank"))
    picked = ranked.withColumn("shots", F.explode(reached)).drop("rank")
    single = dedup_keep_last(images, ["image_id"], [c for c in images.columns if c != "image_id"])
    return picked, picked.select("seed", "shots", "image_id").distinct().join(single, "image_id")


def check_metadata(parts: DataFrame, keys: Sequence[str], metadata: Sequence[str]) -> DataFrame:
    """One row of metadata for each set of parts; an error names a set whose parts disagree.

    Metadata is compared as JSON, so nulls equal nulls and nested values count.
    """
    text = F.to_json(F.struct(*metadata), {"ignoreNullFields": "false"})
    sets = parts.groupBy(*keys).agg(F.min(text).alias("_least"), F.max(text).alias("_most"), *[F.min_by(m, text).alias(m) for m in metadata])
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    wrong = F.raise_error(F.concat(F.lit("parts of set "), name, F.lit(" have different metadata")))
    checked = F.when(F.col("_least") == F.col("_most"), F.lit(True)).otherwise(wrong.cast("boolean"))
    return sets.filter(checked).drop("_least", "_most")


def evaluation_rows(boxes: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Annotation rows with x, y, w, h, area (given or w * h), crowd flag and ids from 1."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    out = boxes.select(
        "image_id", "box_id", F.col("class").alias("category_id"), F.col("xmin").alias("x"), F.col("ymin").alias("y"),
        w.alias("w"), h.alias("h"),
        (F.coalesce("area", w * h) if "area" in boxes.columns else w * h).alias("area"),
        (F.coalesce("crowd", F.lit(0)) if "crowd" in boxes.columns else F.lit(0)).alias("iscrowd"),
    )
    return with_position(out, order_by, name="id", start=1)


# --- detection metrics ---------------------------------------------------------------------

# Published evaluation protocol for detections.
IOU_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
AREA_RANGES = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
MAX_DETECTIONS = (1, 10, 100)


def match_detections(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One truth per detection, as if detections chose in score order.

    ``edges`` holds the admissible pairs: keys, ``det``, ``place`` (0 is the best score),
    ``truth``, ``iou``, ``ignored`` and ``crowd``. A detection prefers truths that count, then
    the highest IoU, then the last truth; crowd truths can be taken any number of times. In each
    round every pair in which the detection's favourite is the truth's best remaining detection
    is fixed; nothing that follows can change it.
    """
    keys = list(keys)
    edges = staged(edges, "edges")
    fixed = []
    while not edges.isEmpty():
        choice = edges.groupBy(*keys, "det").agg(
            F.min(F.struct(F.col("ignored"), (-F.col("iou")).alias("n"), (-F.col("truth")).alias("t"), "place", "crowd")).alias("c")
        ).select(*keys, "det", (-F.col("c.t")).alias("truth"), "c.place", "c.ignored", "c.crowd")
        first = edges.groupBy(*keys, "truth").agg(F.min("place").alias("first"))
        won = choice.join(first, [*keys, "truth"]).filter(F.col("crowd") | (F.col("place") == F.col("first"))).drop("first")
        won = staged(won, "matches")
        if won.isEmpty():
            raise ValueError("detection and truth ids must be unique within a key")
        fixed.append(won)
        rest = edges.join(won.select(*keys, "det"), [*keys, "det"], "left_anti")
        rest = rest.join(won.filter(~F.col("crowd")).select(*keys, "truth"), [*keys, "truth"], "left_anti")
        edges = staged(rest, "edges")
    if not fixed:
        return edges.select(*keys, "det", "truth", "place", "ignored", "crowd")
    out = fixed[0]
    for f in fixed[1:]:
        out = out.unionByName(f)
    return out


def _protocol(thresholds: Sequence[float], areas: dict[str, tuple[float, float]]) -> list[tuple[float, str, float, float]]:
    """(threshold, area range, its bounds) in the order of the bits of packed outcomes."""
    return [(float(x), name, lo, hi) for x in thresholds for name, (lo, hi) in areas.items()]


WORD = 62  # bits of a packed outcome in one number


def _words(bits: Sequence[Column]) -> Column:
    """Conditions as an array of numbers, ``WORD`` bits each."""
    word = lambda part: reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(part)])
    return F.array(*[word(bits[i:i + WORD]) for i in range(0, len(bits), WORD)])


def _bit(words: str, k: int) -> Column:
    return F.get(words, F.lit(k // WORD)).bitwiseAND(F.lit(1 << k % WORD).cast("bigint")) != 0


def packed_outcomes(
    predictions: DataFrame, truths: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS,
    areas: dict[str, tuple[float, float]] = AREA_RANGES, most: int = max(MAX_DETECTIONS), cell: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Outcomes of each detection for all thresholds and area ranges in one row, and the truths that count.

    First table: class, image_id, det, score, place and the bits ``tp`` and ``fp`` in the order of
    thresholds and, within one, area ranges (both 0 when ignored). Second: class, area, positives.
    A detection and a truth that meet nobody else take each other wherever they overlap enough; only
    the others are matched in rounds.
    """
    keys = ["image_id", "class"]
    combos = _protocol(thresholds, areas)
    dets = top_rows(predictions.select(*keys, "box_id", "score", *B.SIDES), most, [F.desc("score"), "box_id"], keys, "place")
    dets = staged(dets.withColumn("place", F.col("place") - 1), "detections")
    crowd = F.coalesce(F.col("crowd").cast("boolean"), F.lit(False)) if "crowd" in truths.columns else F.lit(False)
    size = F.col("area") if "area" in truths.columns else (F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))
    gts = truths.select(*keys, "box_id", *B.SIDES, crowd.alias("crowd"), size.alias("size"))
    ranges = F.explode(F.array(*[F.struct(F.lit(n).alias("area"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in areas.items()]))
    outside = lambda s: (s < F.col("r.lo")) | (s > F.col("r.hi"))
    positives = gts.select("class", "size", "crowd", ranges.alias("r")).filter(~(F.col("crowd") | outside(F.col("size"))))
    positives = positives.groupBy("class", F.col("r.area").alias("area")).agg(F.count(F.lit(1)).alias("positives"))

    pairs = overlapping_pairs(dets, gts, keys, cell or usual_cell(dets))
    overlap = F.when(F.col("b.crowd"), B.intersection("a", "b") / B.area("a")).otherwise(B.iou("a", "b"))
    pairs = pairs.withColumn("iou", overlap).filter(F.col("iou") >= min(thresholds))
    pairs = staged(pairs.select(*keys, F.col("a.box_id").alias("det"), F.col("a.place").alias("place"), F.col("b.box_id").alias("truth"),
                                "iou", F.col("b.size").alias("size"), F.col("b.crowd").alias("crowd")), "pairs")
    shared = lambda side: pairs.groupBy(*keys, side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, side, F.lit(True).alias(f"{side}_shared"))
    pairs = pairs.join(shared("det"), [*keys, "det"], "left").join(shared("truth"), [*keys, "truth"], "left")
    alone = pairs.filter(F.col("det_shared").isNull() & F.col("truth_shared").isNull())
    ignored = lambda lo, hi: F.col("crowd") | (F.col("size") < lo) | (F.col("size") > hi)
    enough = [(F.col("iou") >= x, ignored(lo, hi)) for x, _, lo, hi in combos]
    alone = alone.select(*keys, "det", _words([o & ~i for o, i in enough]).alias("hit"), _words([o & i for o, i in enough]).alias("void"))

    contested = pairs.filter(F.col("det_shared") | F.col("truth_shared"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("thr"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (x, _, lo, hi) in enumerate(combos)]))
    edges = contested.select("*", asked.alias("r")).filter(F.col("iou") >= F.col("r.thr")).select(
        *keys, F.col("r.k").alias("k"), "det", "place", "truth", "iou", (F.col("crowd") | outside(F.col("size"))).alias("ignored"), "crowd")
    taken = match_detections(edges, [*keys, "k"])
    some = lambda cond: _words([F.coalesce(F.bool_or((F.col("k") == k) & cond), F.lit(False)) for k in range(len(combos))])
    matched = taken.groupBy(*keys, "det").agg(some(~F.col("ignored")).alias("hit"), some(F.col("ignored")).alias("void")).unionByName(alone)

    own = (F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))
    rows = dets.select(*keys, F.col("box_id").alias("det"), "score", "place", own.alias("size")).join(matched, [*keys, "det"], "left")
    has = lambda words, k: F.coalesce(_bit(words, k), F.lit(False))
    tp = [has("hit", k) for k in range(len(combos))]
    fp = [~has("hit", k) & ~has("void", k) & ~((F.col("size") < lo) | (F.col("size") > hi)) for k, (_, _, lo, hi) in enumerate(combos)]
    return rows.select("class", "image_id", "det", "score", "place", _words(tp).alias("tp"), _words(fp).alias("fp")), positives


def detection_outcomes(
    predictions: DataFrame, truths: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS,
    areas: dict[str, tuple[float, float]] = AREA_RANGES, most: int = max(MAX_DETECTIONS), cell: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Outcome of each detection per threshold and area range, and the truths that count.

    First table: class, thr, area, image_id, det, score, place, tp, fp (both 0 when ignored).
    Second: class, area, positives.
    """
    packed, positives = packed_outcomes(predictions, truths, thresholds, areas, most, cell)
    each = F.explode(F.array(*[
        F.struct(F.lit(x).alias("thr"), F.lit(n).alias("area"), _bit("tp", k).cast("int").alias("tp"), _bit("fp", k).cast("int").alias("fp"))
        for k, (x, n, _, _) in enumerate(_protocol(thresholds, areas))]))
    rows = packed.select("class", "image_id", "det", "score", "place", each.alias("e"))
    return rows.select("class", "e.thr", "e.area", "image_id", "det", "score", "place", "e.tp", "e.fp"), positives


def _interpolated(rows: DataFrame, positives: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """AP and recall from running counts ``tps``, ``fps`` (class, thr, area), with 101 points."""
    group = ["class", "thr", "area"]
    rows = rows.join(positives, ["class", "area"])
    point = F.expr("tps * 100 div positives").cast("int")
    best = rows.groupBy(*group, point.alias("point")).agg(F.max(F.col("tps") / (F.col("tps") + F.col("fps"))).alias("p"), F.max(F.col("tps") / F.col("positives")).alias("r"))
    # At most 101 points per group from here on.
    curve = best.groupBy(*group).agg(F.collect_list(F.struct("point", "p")).alias("c"), F.max("r").alias("recall"))
    at = lambda t: F.coalesce(F.array_max(F.transform(F.filter("c", lambda e: e["point"] >= t), lambda e: e["p"])), F.lit(0.0))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(100)), F.lit(0.0), lambda acc, t: acc + at(t))
    curve = curve.select(*group, (total / 101).alias("ap"), "recall")
    points = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("thr")
    full = positives.select("class", "area", points).select(*group)
    return full.join(curve, group, "left").fillna(0.0, ["ap", "recall"])


def average_precision_101(outcomes: DataFrame, positives: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS) -> DataFrame:
    """AP and recall per class, threshold and area range, with 101-point interpolation.

    The precision at a recall point is the best one at that recall or later; a detection is
    assigned to the last point its recall reaches, in exact integer arithmetic.
    """
    counted = outcomes.filter((F.col("tp") + F.col("fp")) > 0)
    run = with_running(counted, [-F.col("score"), "image_id", "det"], {"tps": ("sum", F.col("tp")), "fps": ("sum", F.col("fp"))}, ["class", "thr", "area"])
    return _interpolated(run, positives, thresholds)


def average_precision_packed(
    packed: DataFrame, positives: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS, areas: dict[str, tuple[float, float]] = AREA_RANGES,
) -> DataFrame:
    """:func:`average_precision_101` of packed outcomes: one order of a class's detections serves all settings.

    A precision is best where a detection counts, so the rows in between need no curve.
    """
    combos = _protocol(thresholds, areas)
    count = lambda side: {f"{side}{k}": ("sum", _bit(side, k).cast("int")) for k in range(len(combos))}
    run = with_running(packed, [-F.col("score"), "image_id", "det"], count("tp") | count("fp"), ["class"])
    each = F.array(*[F.when(_bit("tp", k), F.struct(F.lit(x).alias("thr"), F.lit(n).alias("area"), F.col(f"tp{k}").alias("tps"), F.col(f"fp{k}").alias("fps")))
                     for k, (x, n, _, _) in enumerate(combos)])
    rows = run.select("class", F.explode(F.array_compact(each)).alias("e")).select("class", "e.*")
    return _interpolated(rows, positives, thresholds)


def detection_summary(
    outcomes: DataFrame, positives: DataFrame, limits: Sequence[int] = MAX_DETECTIONS,
    thresholds: Sequence[float] = IOU_THRESHOLDS, areas: dict[str, tuple[float, float]] = AREA_RANGES,
) -> DataFrame:
    """(metric, class, value): the usual AP and AR numbers overall (class -1) and per class.

    ``outcomes`` has a row for each setting, or is packed: then much less is shuffled.
    """
    if "thr" in outcomes.columns:
        ap = staged(average_precision_101(outcomes, positives), "ap")
    else:
        ap = staged(average_precision_packed(outcomes, positives, thresholds, areas), "ap")
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("thr"), F.lit(n).alias("area"), _bit("tp", k).cast("int").alias("tp"))
                                   for k, (x, n, _, _) in enumerate(_protocol(thresholds, areas))]))
        outcomes = outcomes.select("class", "place", each.alias("e")).select("class", "place", "e.*")
    hits = outcomes.groupBy("class", "thr", "area").agg(*[F.sum(F.when(F.col("place") < m, F.col("tp")).otherwise(0)).alias(f"m{m}") for m in limits])
    recall = hits.join(positives, ["class", "area"]).select("class", "thr", "area", *[(F.col(f"m{m}") / F.col("positives")).alias(f"m{m}") for m in limits])
    recall = staged(recall, "recall")
    mean = lambda df, name, col: df.groupBy().agg(F.lit(name).alias("metric"), F.lit(-1).cast("bigint").alias("class"), F.avg(col).alias("value"))
    everything = ap.filter("area = 'all'")
    parts = [mean(everything, "AP", "ap"), mean(everything.filter("thr = 0.5"), "AP50", "ap"), mean(everything.filter("thr = 0.75"), "AP75", "ap")]
    for name in ("small", "medium", "large"):
        parts.append(mean(ap.filter(F.col("area") == name), f"AP_{name}", "ap"))
        parts.append(mean(recall.filter(F.col("area") == name), f"AR_{name}", f"m{max(limits)}"))
    parts += [mean(recall.filter("area = 'all'"), f"AR{m}", f"m{m}") for m in limits]
    parts.append(everything.groupBy(F.lit("AP_class").alias("metric"), F.col("class").cast("bigint").alias("class")).agg(F.avg("ap").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- multi-label scores --------------------------------------------------------------------


def hit_at_one(scores: DataFrame, row: str) -> DataFrame:
    """Share of rows whose best-scored class is true (``class``, ``score``, ``truth``)."""
    best = scores.groupBy(row).agg(F.min(F.struct((-F.col("score")).alias("n"), "class", "truth"))["truth"].alias("hit"))
    return best.agg(F.avg(F.col("hit").cast("double")).alias("hit_at_one"))


def perr(scores: DataFrame, row: str) -> DataFrame:
    """Mean precision among as many top classes as a row has true ones."""
    need = scores.groupBy(row).agg(F.sum("truth").alias("need")).filter("need > 0")
    most = need.agg(F.max("need")).first()[0] or 1
    top = top_rows(scores, int(most), [F.desc("score"), "class"], [row]).join(need, row).filter(F.col("rank") <= F.col("need"))
    per = top.groupBy(row).agg((F.sum(F.when(F.col("score") > 0, F.col("truth")).otherwise(0)) / F.max("need")).alias("p"))
    return per.agg(F.avg("p").alias("perr"))


def average_precision(scores: DataFrame, order_by, group: Sequence[str] = (), n: int | None = None, positives: DataFrame | None = None) -> DataFrame:
    """Non-interpolated AP (at n) per group; 0 without positives.

    ``positives`` optionally gives the number of true items per group where the scored rows do
    not hold all of them.
    """
    keys = list(group)
    run = with_running(scores, order_by, {"_hits": ("sum", F.col("truth")), "_at": ("sum", F.lit(1))}, keys)
    if n:
        run = run.filter(F.col("_at") <= n)
    gain = F.sum(F.when(F.col("truth") > 0, F.col("_hits") / F.col("_at")).otherwise(0.0))
    found = run.groupBy(*keys).agg(gain.alias("_gain"))
    if positives is None:
        positives = scores.groupBy(*keys).agg(F.sum("truth").alias("positives"))
    count = F.least("positives", F.lit(n)) if n else F.col("positives")
    one = lambda df: df if keys else df.withColumn("_k", F.lit(0))
    out = one(positives).join(one(found), keys or "_k", "left")
    ap = F.when(F.col("positives") > 0, F.coalesce("_gain", F.lit(0.0)) / count).otherwise(0.0)
    return out.select(*keys, ap.alias("ap"))


def global_ap(scores: DataFrame, row: str, k: int) -> DataFrame:
    """AP of the top k classes per row, pooled over all rows in one distributed ranking."""
    total = scores.agg(F.sum("truth").alias("positives"))
    top = top_rows(scores, k, [F.desc("score"), "class"], [row]).drop("rank")
    return average_precision(top, [-F.col("score"), row, "class"], positives=total).withColumnRenamed("ap", "gap")


def mean_ap(scores: DataFrame, row: str, k: int) -> DataFrame:
    """Mean over classes of the AP of top-k predictions."""
    totals = scores.groupBy("class").agg(F.sum("truth").alias("positives"))
    top = top_rows(scores, k, [F.desc("score"), "class"], [row]).drop("rank")
    return average_precision(top, [-F.col("score"), row], ["class"], positives=totals).agg(F.avg("ap").alias("map"))


def video_segments(df: DataFrame, row: str, frames: str, starts: str, labels: str, scores: str, size: int, classes: int) -> DataFrame:
    """Fixed-size segments at the distinct start times, with dense labels and label weights."""
    unique = df.select("*", F.posexplode(F.array_distinct(starts)).alias("segment", "start"))
    rated = F.filter(F.arrays_zip(F.col(starts).alias("s"), F.col(labels).alias("l"), F.col(scores).alias("v")), lambda e: e["s"] == F.col("start"))
    rows = unique.select(row, "segment", "start", F.slice(frames, F.col("start") + 1, size).alias("frames"), rated.alias("_rated"))
    index = F.sequence(F.lit(0), F.lit(classes - 1))
    at = lambda i: F.filter("_rated", lambda e: e["l"] == i)
    return rows.select(
        row, "segment", "start", "frames",
        F.transform(index, lambda i: F.coalesce(F.try_element_at(F.transform(at(i), lambda e: e["v"]), F.lit(-1)), F.lit(0.0))).alias("labels"),
        F.transform(index, lambda i: (F.size(at(i)) > 0).cast("double")).alias("weights"),
    )
