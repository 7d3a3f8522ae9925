"""Neighbours, Merkle manifests and phrases against plain versions, on odd rows too."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from feedloom.llm import merkle, neighbours, phrases, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ neighbours


def nearest_plain(rows, every, top):
    """``{(query, vec): score}`` lists by brute force; rows are (id, list)."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for _, v in good), default=0)
    ids = np.array([i for i, _ in sorted(good)], dtype=np.int64)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in sorted(good)]).reshape(len(good), width)
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            score = (x * x[q]).sum(axis=1)
            order = [k for k in np.lexsort((ids, -score)) if ids[k] != ids[q]][:top]
            out.setdefault(int(ids[q]), []).extend((r + 1, int(ids[k]), float(score[k])) for r, k in enumerate(order))
    return out


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


def test_neighbours_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6) * 10 ** rng.uniform(-2, 2)]) for k in range(60)]
    rows += [(100 + k, [900.0, 2000.0, 3000.0, 4000.0, 5000.0, 6000.0]) for k in range(30)]  # copies, some of them queries
    rows += [(40, rows[40][1]), (None, [1.0] * 6), (200, None), (220, []), (240, [0.0] * 6), (260, [1.0, None]), (280, [float("nan")] * 6),
             (300, [float("inf"), 1.0]), (320, [3.0, -1.0]), (-20, [0.5] * 6)]
    table = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    got, want = found(neighbours.nearest(table, top=5)), nearest_plain(rows, 20, 5)
    assert got.keys() == want.keys() and {0, 20, 40, 100, 120, 320, -20} <= got.keys()
    same = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert same >= 0.9 * sum(map(len, want.values()))
    assert all([r for r, _, _ in got[q]] == [1, 2, 3, 4, 5] for q in got)
    assert [i for _, i, _ in got[100]] == [101, 102, 103, 104, 105] == [i for _, i, _ in want[100]]
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(table.filter("vec_id in (1, 3)")).count() == 0


def test_neighbours_few_candidates_are_all_returned(spark):
    rows = [(k, [float(k), 1.0]) for k in range(0, 60, 10)]
    assert found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == nearest_plain(rows, 20, 20)


def test_neighbours_recall_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = found(queries.op11(spark, SF))
    want = nearest_plain([(r.vec_id, r.embedding and list(r.embedding)) for r in table.collect()], 20, 20)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.95 * sum(map(len, want.values()))
    exact = {(q, i): s for q in want for _, i, s in want[q]}
    assert all(abs(exact[q, i] - s) < 1e-12 for q in got for _, i, s in got[q] if (q, i) in exact)


def test_long_lists_are_several_blocks(spark, monkeypatch):
    """Blocks of 64 vectors and groups of 16 queries give what one block gives."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8))
    x[200:] = x[0] + 0.01 * x[200:]  # one close crowd
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = nearest_plain(rows, 20, 20)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    got = found(neighbours.nearest(table))
    assert sum(len({y[1] for y in got[q]} & {y[1] for y in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    assert neighbours.layout(np.array([10, 50, 60, 500, 3]), 64)[0].tolist() == [0, 0, 1, 2, 3]
    assert neighbours.layout(np.array([10, 50, 60, 500, 3]), 64)[1].tolist() == [1, 1, 1, 8, 1]


def test_a_rejected_candidate_was_far(spark):
    """Pairs kept by the dimension scan hold every true neighbour but the few the test may miss."""
    rng = np.random.default_rng(9)
    x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(3000, 64)), rng.normal(size=(50, 64))))
    x, q = x.astype(np.float32), q.astype(np.float32)
    columns = [np.ascontiguousarray(x[:, a:b].T) for a, b in neighbours._column_blocks(64)]
    i, j, limit = neighbours.scan_list(columns, q, 20, np.full(50, np.inf, dtype=np.float32))
    far = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    near = {(a, b) for a in range(50) for b in np.argsort(far[a])[:20]}
    assert len(near & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.98 * len(near)
    assert len(i) <= 21 * len(q) and (limit >= np.sort(far, axis=1)[:, 19] - 1e-4).all()


# ------------------------------------------------------------------ Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def plain_tree(leaves, fanout):
    """The root and each leaf's siblings, level by level."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, spot in enumerate(at):
            begin = spot - spot % fanout
            ways[k].append((spot - begin, level[begin:spot] + level[spot + 1 : begin + fanout]))
            at[k] = spot // fanout
        level = [h(*level[b : b + fanout]) for b in range(0, len(level), fanout)]
    return level[0], ways


def plain_manifest(rows, fanout):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (known, key, leaf), way in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((key if known else None, leaf, trees[g][0], root, tuple((p, tuple(o)) for p, o in way + top)))
    return Counter(out)


def manifest_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    langs = ["en"] * 6 + ["de", "fr", None, "", "éa"]
    rows = [(int(k), f"s{k % 3}" if k % 5 else None, langs[rng.integers(len(langs))], int(k) if k % 4 else None, ["text é日", "", None, "a" * 40_000][k % 4]) for k in range(n)]
    return rows + [(None, "s", "en", 1, "x"), (None, None, None, None, None), (3, "s", "en", 1, "again"), *[(7, "s", "en", 2, "same")] * 3]


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fanout", "block", "n"), [(2, 4, 61), (3, 9, 100), (2, 1024, 30), (4, 4, 75)])
def test_manifest(spark, fanout, block, n):
    rows = manifest_rows(n, fanout)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("x"), "root": F.lit(1)}).repartition(3)
    got = merkle.manifest(docs, fanout=fanout, block=block).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.place, tuple(s.others)) for s in r.proof)) for r in got) == plain_manifest(rows, fanout)


def test_exchange_of_every_size(spark):
    """Groups of 1 to 40 leaves in blocks of two: every kind of shorter last subtree."""
    rows = [(k, "s", f"g{n:02}", 1, str(k)) for n in range(1, 41) for k in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), block=2).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.place, tuple(s.others)) for s in r.proof)) for r in got) == plain_manifest(rows, 2)


def test_tampering_shows(spark):
    rows = [(k, "s", "en" if k % 3 else None, k if k % 5 else None, f"t{k}") for k in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    other = F.when(F.col("doc_id") % 2 == 0, F.lit("0" * 64)).otherwise(merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    got = merkle.manifest(docs, carry=other, block=4).withColumn("again", merkle.folded(F.col("carried"), F.col("proof"))).collect()
    assert all((r.again == r.root) == (r.doc_id % 2 == 1) for r in got) and len(got) == 50
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.limit(1)).first()
    assert one.root == one.subroot == one.leaf and one.proof == []
    with pytest.raises(ValueError, match="a run has"):
        merkle.manifest(docs, fanout=4, block=2)


# ------------------------------------------------------------------ phrases


def plain_phrases(rows, longest, least, percent, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang or "und" if lang != "" else ""] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    count["und" if lang is None else lang][tuple(words[at : at + k])] += 1
    out = []
    for lang, f in count.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            around = [b for q, b in f.items() if len(q) > len(p) and b >= least and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if any(100 * b >= percent * a for b in around):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


PHRASE_ROWS = (
    [("en", "New York is big. New York is far, new york!")] * 6 + [("en", "of the people by the people for the people " * 4)]
    + [(None, "a a a a a a a a a a a a a a\tb\nb a é日 É日")] * 3 + [("und", "a a b a a b")] * 5 + [("de", None), ("de", ""), ("de", " \t"), ("", "x y x y x y"), ("de", "Der Ü Ü x der Ü")]
)


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (2, 2, 3), (4, 3, None)])
def test_phrases(spark, longest, least, top):
    docs = spark.createDataFrame([(lang, text, 1, "p") for lang, text in PHRASE_ROWS], "lang string, text string, n int, phrase string").repartition(3)
    got = phrases.collocations(docs, longest=longest, least=least, top=top).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(PHRASE_ROWS, longest, least, 50, top)) and got
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_phrases_flushed_often_and_with_a_full_filter(spark, monkeypatch):
    docs = spark.createDataFrame(PHRASE_ROWS, "lang string, text string").repartition(2)
    monkeypatch.setattr(phrases, "WINDOWS", 5)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    got = phrases.collocations(docs).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(PHRASE_ROWS, 3, 10, 50, 2000))


def test_rows_of_many_columns_are_told_apart():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 2**30, size=4000) // 2**28 * (2**28 + 1) % 2**30 for _ in range(5)]
    found, n = phrases._counted(columns, 30)
    assert Counter(dict(zip(zip(*[c.tolist() for c in found], strict=True), n.tolist(), strict=True))) == Counter(zip(*[c.tolist() for c in columns], strict=True))


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    big = 2_000_000_011
    counts = spark.createDataFrame([("x", "a", 1, 3 * big), ("x", "b", 1, big + 1), ("x", "a b", 2, big)], "lang string, phrase string, words int, c long")
    row = phrases.scored(counts).first()
    assert row.score == 1_000_000 * big * big // (3 * big * (big + 1))


def test_given_tables_match_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name in ("op12_merkle", "op13_phrases"):
        df = queries.all_queries()[name](spark, SF)
        cur = db.execute(queries.all_oracles()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(cur.fetchall())
