"""What executors get: workers without this repository, bounded output of blocks, names that clash."""

import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from feedloom.llm import common, decontaminate, exact_dedup, minhash, piece_lattice
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BARE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from feedloom.session import local_session
from feedloom.llm import queries
spark = local_session(2, "bare")
seen = spark.range(2).mapInPandas(lambda it: (b.assign(found=__import__("importlib.util").util.find_spec("feedloom") is not None)[["found"]] for b in it), "found boolean").collect()
assert not any(r.found for r in seen), "the workers find the repository"
for name in sys.argv[1:]:
    queries.all_queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("done")
"""


def test_workers_need_no_installation(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["op9_sentencepiece", "op10_lm_score", "op11_neighbours", "op12_merkle", "op13_phrases"]
    out = subprocess.run([sys.executable, "-c", BARE, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]


def family(m, seed, edits):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in rng.integers(0, 900, size=150)]
    out = []
    for _ in range(m):
        copy = list(words)
        for at in rng.integers(0, 150, size=rng.integers(0, edits)):
            copy[at] = f"edit{rng.integers(10**9)}"
        out.append(" ".join(copy))
    return out


def test_blocks_give_fewer_links_than_members(spark, monkeypatch):
    """A family whose pairs mostly lie just below the limit leaves no table of pairs behind."""
    written = Counter()
    staged = minhash.staged

    def watch(df, label="stage"):
        out = staged(df, label)
        written[label] = max(written[label], out.count())
        return out

    monkeypatch.setattr(minhash, "staged", watch)
    rows = list(enumerate(family(300, 1, 14)))
    monkeypatch.setattr(minhash, "BLOCK", 64)
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) for w in (t.split() for _, t in rows)]
    low = list(range(len(rows)))
    changed = True
    near = [[b for b in range(len(rows)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] for a in range(len(rows))]
    while changed:
        new = [min(low[b] for b in near[a]) for a in range(len(rows))]
        changed, low = new != low, new
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(low))
    assert written["pairs"] < 3 * len(rows) and written["links"] < 3 * len(rows)


def test_names_that_are_there_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, found string, Encoded string")
    with pytest.raises(ValueError, match="found"):
        decontaminate.scan(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))
    with pytest.raises(ValueError, match="encoded"):
        piece_lattice.encode_checked(docs, piece_lattice.Pieces.load())


def test_repeated_rows_become_the_smallest(spark):
    """Of rows that share id and text the same one stays however they are dealt out, also under null ids."""
    rows = [(k % 3 or None, f"text {k % 2}", n) for n, k in enumerate(list(range(6)) * 40)] + [(1, None, 5), (1, "", 4)]
    want = {}
    for i, t, n in rows:
        want.setdefault(t or "", []).append((i is None, i or 0, n))
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts)
        got = exact_dedup.drop_exact(docs).collect()
        assert sorted((r.doc_id, r.text or "") for r in got) == sorted((min(v)[1], t) for t, v in want.items())
        first = {(r.doc_id, r.text): r.n for r in got if r.text}
        assert first == {k: int(min(f"{n}}}" for i, t, n in rows if (i, t) == k)[:-1]) for k in first}


def test_a_shared_value_arrives(spark):
    value = common.shared(spark, {"x": np.arange(3)})
    assert spark.range(3).select(F.udf(lambda k: int(value()["x"][k] * 2), "int")("id").alias("y")).agg(F.sum("y")).first()[0] == 6
