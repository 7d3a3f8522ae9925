"""Every stage of the pipeline against a plain version, on rows with null, repeated and hot ids and texts."""

import hashlib
import json
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from feedloom.llm import piece_lattice, quality
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD10 = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 10**6, size=n)]


def made(rng):
    """Rows and the benchmark's texts: copies, families, passages of the benchmark; a third of the rows has id 7."""
    items = [" ".join(words(rng, 14)), " ".join(words(rng, 4)), "", None]
    rows = [(None, None), (None, ""), (None, ""), (7, " \t\n"), (8, None), (8, "é"), (9, "É 日本語")]
    for k in range(14):
        base = words(rng, 60)
        rows += [(7, " ".join(base)), (7, " ".join(base)), (100 + k, " ".join(base).replace(" ", "\n", 3)), (None if k % 2 else 200 + k, " ".join([*base[:-1], "edited"]))]
        rows += [(7, " ".join(words(rng, 40))), (300 + k, " ".join(words(rng, 25)).upper())]
    hit = items[0].split()
    rows += [
        (400, " ".join([*words(rng, 20), *hit, *words(rng, 20)])), (401, " ".join([*words(rng, 30), *hit[2:12]])),
        (402, " ".join([*words(rng, 30), *hit[:9]])), (403, items[1].upper()), (404, items[1].replace(" ", ", ") + " and more"),
        (None, items[0]), (405, "A" * 70_000),
    ]
    full = [(i, t, ["en", None, "de"][k % 3], "hot" if k % 2 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return [*full, *full[-5:]], items


def by_id(row):
    return row[0] is None, row[0] or 0


def plain_exact(rows):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(by_id(r))
    return Counter((min(g), t) for t, g in groups.items())


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_near(rows, size=5):
    """One row of each component of links of 0.8 and more; rows without words all stay."""
    sets = [shingles(r[1], size) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    order = lambda k: (*by_id(rows[k]), hashlib.sha256(rows[k][1].encode()).hexdigest())
    members = {}
    for k, s in enumerate(sets):
        if s:
            members.setdefault(group[k], []).append(k)
    kept = [rows[min(g, key=order)] for g in members.values()] + [rows[k] for k, s in enumerate(sets) if not s]
    return Counter((r[0], r[1]) for r in kept)


def plain_clean(rows, items):
    found = lambda t: tuple(WORD10.findall((t or "").encode().lower()))
    windows = set()
    for t in items:
        w = found(t)
        windows |= {w[k : k + 10] for k in range(len(w) - 9)} if len(w) >= 10 else {w} - {()}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = found(t)
        return not any(w[k : k + n] in windows for n in sizes for k in range(len(w) - n + 1))

    return Counter(r for r in rows if clean(r[1]))


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rows, items = made(np.random.default_rng(12))
    folder = f"file:{tmp_path_factory.mktemp('given')}"
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marked = [(r[0], int(len(r[1] or "") % 3 > 0)) for r in rows if r[0] is not None]
    labels = dict(marked)
    spark.createDataFrame(sorted(labels.items()), "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows, items, folder


def plain_rows(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return [tuple(r) for r in df.collect()]


def test_quality_stage_keeps_what_reaches_the_limit(spark, given):
    docs, rows, _, folder = given
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(np.array([quality.statistics((r[1] or "").encode()) for r in rows]))
    want = Counter(r for r, s in zip(rows, scores, strict=True) if s >= 0.3)
    assert Counter(plain_rows(corpus_pipeline.quality_stage(spark, docs, folder))) == want


def test_exact_stage(spark, given):
    docs, rows, _, folder = given
    got = plain_rows(corpus_pipeline.exact_stage(spark, docs, folder))
    assert Counter((by_id(r), re.sub(r"[ \t-\r]+", " ", r[1] or "")) for r in got) == plain_exact(rows)
    assert not Counter(got) - Counter(rows)
    again = plain_rows(corpus_pipeline.exact_stage(spark, docs.repartition(7), folder))
    assert Counter(again) == Counter(got)


def test_near_stage(spark, given):
    docs, rows, _, folder = given
    got = plain_rows(corpus_pipeline.near_stage(spark, docs, folder))
    assert Counter((r[0], r[1]) for r in got) == plain_near(rows)
    assert not Counter(got) - Counter(rows)


def test_decontaminate_stage(spark, given):
    docs, rows, items, folder = given
    want = plain_clean(rows, items)
    assert Counter(plain_rows(corpus_pipeline.decontaminate_stage(spark, docs, folder))) == want
    dropped = {r[0] for r in Counter(rows) - want}
    assert {400, 401, 403, 404} <= dropped and 402 not in dropped


def test_encode_stage(spark, given):
    docs, rows, _, folder = given
    got = corpus_pipeline.encode_stage(spark, docs, folder)
    assert got.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids", "lossless"]
    out = got.withColumn("text", piece_lattice.decode_column(F.col("piece_ids"), piece_lattice.Pieces.load())).collect()
    assert all(r.lossless and r.n_pieces == len(r.piece_ids or ()) for r in out)
    assert Counter((r.doc_id, r.lang, r.source, r.text or "") for r in out) == Counter((r[0], r[2], r[3], r[1] or "") for r in rows)


def test_run_is_the_stages_in_a_row(spark, given):
    """What ``run`` returns are the rows that the plain stages leave, on the rows that the quality stage kept."""
    docs, rows, items, folder = given
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    kept = plain_rows(corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert 0 < len(kept)
    single = {}
    for r in kept:  # the exact stage, with the row it keeps of one id and text
        single.setdefault(re.sub(r"[ \t-\r]+", " ", r[1] or ""), []).append(r)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    text = lambda r: json.dumps({n: v for n, v in zip(names, r, strict=True) if v is not None}, ensure_ascii=False, separators=(",", ":"))
    now = [min(g, key=lambda r: (*by_id(r), text(r))) for g in single.values()]
    near = plain_near(now)
    now = [r for r in now if near[(r[0], r[1])]]
    want = Counter((r[0], r[2], r[3]) for r in plain_clean(now, items).elements())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.lang, r.source) for r in got) == want and all(r.lossless for r in got)
