"""Which marks to keep: against all subsets, odd numbers, repeated rows, long pipelines."""

from itertools import combinations

import numpy as np
import pytest
from feedloom.operators import reuse

SCHEMA = "job string, mark int, compute long, read long, write long, bytes long, uses long, kept string"


def total(marks, source, kept):
    """Time of all uses of a pipeline, step by step."""
    seconds, reach = 0, source
    for m, compute, read, write, _, uses in marks:
        reach += compute
        if m in kept:
            seconds += reach + write + uses * read
            reach = read
        else:
            seconds += uses * reach
    return seconds


def best(marks, source, bound, grain):
    found = []
    for n in range(len(marks) + 1):
        for chosen in combinations(marks, n):
            grains = sum(-(-m[4] // grain) for m in chosen)
            if grains <= bound // grain:
                kept = [m[0] for m in chosen]
                found.append((total(marks, source, kept), grains, n, kept))
    return min(found)


@pytest.mark.parametrize("grain", [1, 7])
def test_against_all_subsets(spark, grain):
    rng = np.random.default_rng(4)
    jobs = {}
    for j in range(25):
        n = int(rng.integers(0, 8))
        jobs[f"j{j}"] = (int(rng.integers(0, 30)), [
            (k + 1, *(int(x) for x in rng.integers([0, 0, 0, 0, 0], [40, 20, 15, 50, 6]))) for k in range(n)])
    rows = [(j, 0, 999, s, 999, 999, 999, "x") for j, (s, _) in jobs.items()] + [(j, *m, "x") for j, (_, marks) in jobs.items() for m in marks]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.job: (r.seconds, r.grains, len(r.kept), list(r.kept), r.plain) for r in reuse.choose_marks(df.union(df), "job", 80, grain).collect()}
    assert got == {j: (*best(marks, s, 80, grain), total(marks, s, [])) for j, (s, marks) in jobs.items()}


def test_a_long_pipeline_keeps_what_is_used_often(spark):
    rows = [("a", k, 10, 1, 1, 1, 50 if k % 10 == 0 else 0, "x") for k in range(1, 21)] + [(None, 1, None, None, None, None, None, "x")]
    got = {r.job: r for r in reuse.choose_marks(spark.createDataFrame(rows, SCHEMA), "job", 2).collect()}
    assert got["a"].kept == [10, 20] and got["a"].seconds == (100 + 1 + 50) + (101 + 1 + 50) and got["a"].plain == 50 * 300
    assert got[None].kept == [] and got[None].seconds == 0


def test_no_storage_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 10, 1, 1, 5, 50, "x")], SCHEMA)
    assert [(r.kept, r.seconds) for r in reuse.choose_marks(df, "job", 4).collect()] == [([], 500)]
    assert [r.kept for r in reuse.choose_marks(df, "job", 5).collect()] == [[1]]
    assert reuse.choose_marks(df.limit(0), "job", 4).count() == 0
    with pytest.raises(ValueError):
        reuse.choose_marks(df, "job", -1)
