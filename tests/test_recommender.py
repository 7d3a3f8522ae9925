from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from feedloom.operators import recommender as R
from feedloom.plans import catalog
from feedloom.plans.tables import Tables
from feedloom.session import staged

NEG = 60


@pytest.fixture(scope="module")
def prepared(spark):
    return R.ratings_prepare(staged(Tables(spark, "/root/testdata/sf0.001").ratings))


@pytest.fixture(scope="module")
def data(prepared):
    rows = [tuple(r) for r in prepared.rows.collect()]
    train, held = {}, {}
    for user, item, _, split in rows:
        (train.setdefault(user, set()).add(item) if split == "train" else held.setdefault(user, item))
    return train, held, max(r[1] for r in rows) + 1


def test_split(data):
    train, held, _ = data
    assert set(train) == set(held) == set(range(len(train)))
    assert all(held[u] not in train[u] and len(train[u]) >= 19 for u in train)


@pytest.mark.usefixtures("many_ranges")
def test_every_negative_by_number(prepared, data):
    train, _, items = data
    draws = R.user_counts(prepared.train).select(
        "user", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(items) - F.col("positives") - 1)).alias("draw"))
    got = R.nth_negatives(R.negative_tallies(prepared.train), draws.withColumn("r", F.col("draw"))).collect()
    by_user = {}
    for r in got:
        by_user.setdefault(r["user"], {})[r["draw"]] = r["item"]
    for user, found in by_user.items():
        assert [found[k] for k in sorted(found)] == sorted(set(range(items)) - train[user])


def test_evaluation_lists(prepared, data):
    train, held, items = data
    rows = R.eval_candidates(prepared, items, NEG, 5).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r["user"], {})[r["slot"]] = (r["item"], r["duplicate"])
    assert set(lists) == set(held)
    for user, slots in lists.items():
        assert sorted(slots) == list(range(NEG + 1))
        assert slots[NEG] == (held[user], 0)
        for slot, (item, dup) in slots.items():
            if slot < NEG:
                assert item not in train[user]
                assert dup or item != held[user]
        kept = [i for i, d in slots.values() if not d]
        assert len(kept) == len(set(kept))


def test_evaluation_lists_of_large_users(prepared, data, monkeypatch):
    """Lists made in one row and lists made by ranges are the same."""
    _, _, items = data
    taken = lambda: sorted(tuple(r) for r in R.eval_candidates(prepared, items, NEG, 5).collect())
    rows = taken()
    for most in (0, 40):
        monkeypatch.setattr(R, "LIST_ITEMS", most)
        assert taken() == rows


def test_a_list_of_copies_keeps_its_weight(spark):
    """User 0 has one item left beside the positives, so every negative is the held-out item; user 1 has two."""
    rows = [(0, i, i, "train") for i in range(4)] + [(0, 4, 9, "eval")] + [(1, i, i, "train") for i in range(3)] + [(1, 3, 9, "eval")]
    df = spark.createDataFrame(rows, "user bigint, item bigint, ts bigint, split string")
    batches = R.pad_eval(R.eval_candidates(R.Prepared(df, df, df), 5, 3, 1), 2, 4, 3)
    got = {(r["row"], r["slot"]): (r["duplicate"], round(r["weight"], 9)) for r in R.padded_weights(batches, 4, 3).collect()}
    assert [got[0, s][0] for s in range(4)] == [1, 1, 1, 0]
    assert [got[row, s][1] for row in range(4) for s in range(4)] == [round(4 / 3 * 4 / 5, 9)] * 3 + [0.8] + [round(4 / 3 * 4 / 5, 9)] * 3 + [0.8] + [0.0] * 8


def test_training_epochs(prepared, data):
    train, _, items = data
    a, b = (R.train_epoch(prepared, items, 4, 64, e, 9).collect() for e in (0, 1))
    total = sum(map(len, train.values()))
    for rows in (a, b):
        assert len(rows) == 5 * total
        assert {(r["user"], r["item"]) for r in rows if r["label"]} == {(u, i) for u in train for i in train[u]}
        assert all(r["item"] not in train[r["user"]] for r in rows if not r["label"])
        assert sorted((r["batch_id"], r["pos_in_batch"]) for r in rows) == [(i // 64, i % 64) for i in range(5 * total)]
    key = lambda rows: [(r["user"], r["item"]) for r in sorted(rows, key=lambda r: (r["batch_id"], r["pos_in_batch"]))]
    assert key(a) != key(b)


def test_an_epoch_is_made_by_users_and_not_written(prepared, data, monkeypatch):
    """Rows made beside a user's positives and rows made by ranges are the same; neither is written before the shuffle."""
    _, _, items = data
    labels = []
    monkeypatch.setattr(R, "staged", lambda df, label="stage": labels.append(label) or staged(df, label))
    taken = lambda: sorted(tuple(r) for r in R.train_epoch(prepared, items, 3, 64, 1, 9).collect())
    rows = taken()
    assert set(labels) == {"counts", "starts"}
    for most in (0, 40):
        monkeypatch.setattr(R, "LIST_ITEMS", most)
        assert taken() == rows
    monkeypatch.setattr(R, "LIST_ITEMS", 1024)
    monkeypatch.setattr(R, "PART_ROWS", 50)
    assert taken() == rows
    total = len(rows)
    fill = R.pad_last_batch(R.train_epoch(prepared, items, 3, 64, 1, 9), 64, 7, items, rows=total).filter("valid = 0").collect()
    assert sorted(r["pos_in_batch"] for r in fill) == list(range(total % 64, 64)) and {r["batch_id"] for r in fill} == {total // 64}


def test_weights_of_whole_evaluation_lists(spark):
    """Every user is evaluated among 999 negatives, as many as the evaluation takes, not a tenth of them."""
    rows = [(u, u * 3 + i, 1.0, i) for u in range(2) for i in range(R.MIN_RATINGS)]
    t = SimpleNamespace(spark=spark, ratings=spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, ts bigint"))
    catalog._load()
    got = catalog._QUERIES["eval_example_weights"](t).collect()
    assert sorted((r["user"], r["slot"]) for r in got) == [(u, s) for u in range(2) for s in range(1000)]
    assert {r["weight"] for r in got if r["slot"] == 999} == {200.0} and {r["weight"] for r in got if r["slot"] < 999} == {round(4 / 999 * 200, 9)}


def test_held_out_item_loses_ties(spark):
    rows = [(0, s, 0, 0.5) for s in range(4)] + [(1, s, 0, 0.9 if s == 3 else 0.1) for s in range(4)]
    df = spark.createDataFrame(rows, "user int, slot int, duplicate int, score double")
    got = {r["user"]: (r["rank"], r["hit"]) for r in R.hit_and_gain(df, 3, k=2).collect()}
    assert got == {0: (3, 0), 1: (0, 1)}
