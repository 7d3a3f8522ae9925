import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.functions import boxes as B
from feedloom.operators import detection as D

COLUMNS = "image_id int, box_id int, class int, score double, ymin double, xmin double, ymax double, xmax double"


def some_boxes(n, seed, images=2, classes=2, spread=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y, x = rng.random() * spread, rng.random() * spread
        out.append((rng.randrange(images), i, rng.randrange(classes), rng.random(), y, x, y + 5 + rng.random() * 30, x + 5 + rng.random() * 30))
    return out


def overlap(a, b):
    h, w = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    if h <= 0 or w <= 0:
        return 0.0
    area = lambda r: (r[6] - r[4]) * (r[7] - r[5])
    return h * w / (area(a) + area(b) - h * w)


@pytest.mark.parametrize("cell", [4.0, 25.0, 1000.0])
def test_each_pair_once(spark, cell):
    rows = some_boxes(80, 1)
    df = spark.createDataFrame(rows, COLUMNS)
    got = D.pairwise_iou(df, df, cell=cell).select("a.box_id", F.col("b.box_id").alias("o"), "iou").collect()
    want = {(a[1], b[1]): overlap(a, b) for a in rows for b in rows if a[0] == b[0] and overlap(a, b) > 0}
    assert len(got) == len(want)
    assert all(abs(want[(r[0], r[1])] - r[2]) < 1e-9 for r in got)


def test_suppression(spark):
    rows = some_boxes(150, 2)
    got = {(r["image_id"], r["box_id"]) for r in D.nms(spark.createDataFrame(rows, COLUMNS), 0.3, 12).collect()}
    want = set()
    for image in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: -r[3]):
            if all(overlap(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(image, r[1]) for r in kept[:12]}
    assert got == want


def test_suppression_needs_unique_ids(spark):
    rows = [(0, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0, 0.8, 0.0, 0.0, 10.0, 10.0)]
    with pytest.raises(ValueError):
        D.nms(spark.createDataFrame(rows, COLUMNS), 0.3, 12)


def plain_ap(dets, gts, thr):
    """AP of one class without area ranges: greedy matching, then 101-point interpolation."""
    taken, marks = set(), []
    for d in sorted(dets, key=lambda r: (-r[3], r[0], r[1])):
        best = max(((overlap(d, g), g[1]) for g in gts if g[0] == d[0] and (g[0], g[1]) not in taken), default=(0, None))
        hit = best[0] >= thr
        if hit:
            taken.add((d[0], best[1]))
        marks.append(hit)
    points, tp = [0.0] * 101, 0
    for i, hit in enumerate(marks):
        tp += hit
        for t in range(101):
            if tp * 100 >= t * len(gts):
                points[t] = max(points[t], tp / (i + 1))
    return sum(points) / 101


def test_average_precision(spark):
    rng = random.Random(8)
    gts = some_boxes(60, 5, images=4, spread=150)
    dets = [(g[0], 1000 + g[1], g[2], rng.random(), *[v + rng.random() * 4 for v in g[4:]]) for g in gts] + [
        (g[0], 2000 + g[1], g[2], rng.random(), *[v + rng.random() * 6 for v in g[4:]]) for g in gts]
    thresholds = (0.5, 0.75)
    outcomes, positives = D.detection_outcomes(
        spark.createDataFrame(dets, COLUMNS), spark.createDataFrame(gts, COLUMNS), thresholds, {"all": (0.0, 1e10)})
    got = {(r["class"], r["thr"]): r["ap"] for r in D.average_precision_101(outcomes, positives, thresholds).collect()}
    for c in (0, 1):
        for thr in thresholds:
            want = plain_ap([d for d in dets if d[2] == c], [g for g in gts if g[2] == c], thr)
            assert abs(got[(c, thr)] - want) < 1e-9


def test_packed_outcomes_give_the_same_summary(spark):
    """Contested, lonely, crowd and out-of-range boxes: one row a detection says what a row for each setting says."""
    rng = random.Random(9)
    gts = some_boxes(80, 5, images=6, spread=200)
    dets = [(g[0], 1000 + g[1], g[2], rng.random(), *[v + rng.random() * 4 for v in g[4:]]) for g in gts] + [
        (g[0], 2000 + g[1], g[2], rng.random(), *[v + rng.random() * 6 for v in g[4:]]) for g in gts[::3]]
    truths = spark.createDataFrame(gts, COLUMNS).withColumn("crowd", F.col("box_id") % 7 == 0)
    args = spark.createDataFrame(dets, COLUMNS), truths
    packed, positives = D.packed_outcomes(*args)
    assert packed.count() == len(dets)
    long, _ = D.detection_outcomes(*args)
    sizes = long.agg(F.count("*"), F.sum("tp"), F.sum("fp"), F.max(F.col("tp") + F.col("fp"))).first()
    assert sizes[0] == 40 * len(dets) and sizes[1] > 0 and sizes[2] > 0 and sizes[3] == 1
    values = lambda df: {(r["metric"], r["class"]): round(r["value"], 9) for r in df.collect() if r["value"] is not None}
    assert values(D.detection_summary(packed, positives)) == values(D.detection_summary(long, positives))


def test_box_identities(spark):
    df = spark.createDataFrame(some_boxes(50, 3), COLUMNS).select(B.box().alias("b"), B.box("ymin", "xmin", F.col("ymin") + 7, F.col("xmin") + 9).alias("a"))
    rows = df.select(B.iou("b", "b").alias("i"), B.decode(B.encode("b", "a"), "a").alias("d"), "b", B.from_centre(B.to_centre("b")).alias("c"), B.flip(B.flip("b")).alias("f")).collect()
    for r in rows:
        assert abs(r["i"] - 1) < 1e-9
        for side in B.SIDES:
            assert all(abs(r[k][side] - r["b"][side]) < 1e-6 for k in ("d", "c", "f"))


def test_long_lists_continue_in_parts(spark):
    df = spark.createDataFrame([(0, i) for i in range(25)] + [(1, 3)], "image_id int, box_id int")
    out = {(r["image_id"], r["part"]): r["box_id"] for r in D.nested_annotations(df, ["box_id"], ["box_id"], most=10).collect()}
    assert out == {(0, 0): list(range(10)), (0, 1): list(range(10, 20)), (0, 2): list(range(20, 25)), (1, 0): [3]}


def test_parts_of_a_set_must_agree(spark):
    rows = [(1, 5, "a", [1, 2]), (1, 5, "a", [1, 2]), (1, 10, None, [1]), (1, 10, None, [1]), (2, 5, "b", None)]
    parts = spark.createDataFrame(rows, "seed int, shots int, info string, categories array<int>")
    got = D.check_metadata(parts, ["seed", "shots"], ["info", "categories"]).collect()
    assert sorted((r.seed, r.shots, r.info or "", r.categories) for r in got if r.seed == 1) == [(1, 5, "a", [1, 2]), (1, 10, "", [1])]
    assert len(got) == 3 and D.check_metadata(parts.limit(0), ["seed"], ["info"]).count() == 0
    odd = parts.union(spark.createDataFrame([(2, 5, "b", [7])], parts.schema))
    with pytest.raises(Exception, match="parts of set 2, 5 have different metadata"):
        D.check_metadata(odd, ["seed", "shots"], ["info", "categories"]).collect()


def test_sets_are_the_single_splits(spark):
    rows = [(k % 37, k, k % 5) for k in range(400)]
    notes = spark.createDataFrame(rows, "image_id long, box_id long, class int")
    images = notes.select("image_id", "class")
    picked, used = D.few_shot_sets(notes, images, [1, 3], [4, 9], [2, 7])
    got = Counter((r.seed, r.shots, r.image_id, r.box_id) for r in picked.collect())
    shown = Counter((r.seed, r.shots, r.image_id, r["class"]) for r in used.collect())
    want, seen = Counter(), Counter()
    for seed in (4, 9):
        for shots in (2, 7):
            rows, pictures = D.few_shot(notes, images, [1, 3], shots, seed)
            want.update((seed, shots, r.image_id, r.box_id) for r in rows.collect())
            seen.update((seed, shots, r.image_id, r["class"]) for r in pictures.collect())
    assert got == want and shown == seen and sum(got.values()) == 2 * 2 * 9
