"""Registered queries: recommender preparation, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.hashing import MODULUS, mix
from feedloom.operators import recommender as R
from feedloom.plans.catalog import check
from feedloom.plans.tables import h_sql
from feedloom.session import fresh_folder, staged

NEGATIVES = 100

PREP_SQL = """f AS (SELECT * FROM ratings WHERE user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 20)),
um AS (SELECT user_id, row_number() OVER (ORDER BY a.ts, a.item_id, user_id) - 1 AS "user" FROM (
  SELECT user_id, min({'ts': ts, 'item_id': item_id}) AS a FROM f GROUP BY 1)),
im AS (SELECT item_id, row_number() OVER (ORDER BY t, item_id) - 1 AS item FROM (SELECT item_id, min(ts) AS t FROM f GROUP BY 1)),
prep AS (SELECT "user", item, ts, CASE WHEN row_number() OVER (PARTITION BY f.user_id ORDER BY ts DESC, f.item_id DESC) = 1 THEN 'eval' ELSE 'train' END AS split
  FROM f JOIN um ON um.user_id = f.user_id JOIN im ON im.item_id = f.item_id),
train AS (SELECT * FROM prep WHERE split = 'train'),
tally AS (SELECT "user", item, item - row_number() OVER (PARTITION BY "user" ORDER BY item) + 1 AS tally FROM train),
sizes AS (SELECT (SELECT count(*) FROM im) AS n_items, (SELECT count(*) FROM um) AS n_users),
np AS (SELECT "user", count(*) AS positives FROM train GROUP BY 1)"""


def eval_sql(negatives: int) -> str:
    return PREP_SQL + f""",
draws AS (SELECT "user", j AS draw, {h_sql('"user"', 'j', 31)} % (n_items - positives) AS r FROM np, sizes, range(1, {negatives + 1}) x(j)),
neg AS (SELECT d."user", draw, any_value(r) + count(t.item) AS item FROM draws d LEFT JOIN tally t ON t."user" = d."user" AND t.tally <= d.r GROUP BY 1, 2),
cand0 AS (SELECT "user", draw, item FROM neg UNION ALL SELECT "user", 0, item FROM prep WHERE split = 'eval'),
cand AS (SELECT "user", (CASE draw WHEN 0 THEN {negatives} WHEN {negatives} THEN 0 ELSE draw END)::INT AS slot, item,
  (draw > min(draw) OVER (PARTITION BY "user", item))::INT AS duplicate FROM cand0)"""


EVAL_SQL = eval_sql(NEGATIVES)

RANK_SQL = EVAL_SQL + f""",
sc AS (SELECT *, {h_sql('"user"', 'item', 32)} / 2147483647.0::DOUBLE AS score FROM cand),
own AS (SELECT "user", score AS own FROM sc WHERE slot = {NEGATIVES}),
rk AS (SELECT sc."user", count(*) FILTER (WHERE slot <> {NEGATIVES} AND duplicate = 0 AND score >= own) AS rank FROM sc JOIN own ON own."user" = sc."user" GROUP BY 1)"""

EPOCH_SQL = PREP_SQL + f""",
p AS (SELECT "user", item, row_number() OVER (ORDER BY "user", item) - 1 AS i, count(*) OVER () AS total FROM train),
c AS (SELECT "user", item, copy, copy * total + i AS index FROM p, range(5) x(copy)),
d AS (SELECT index, c."user", {h_sql('index', '2', 41)} % (n_items - positives) AS r FROM c JOIN np ON np."user" = c."user", sizes WHERE copy > 0),
n AS (SELECT index, any_value(d."user") AS "user", any_value(r) + count(t.item) AS item FROM d LEFT JOIN tally t ON t."user" = d."user" AND t.tally <= d.r GROUP BY 1),
b AS (SELECT index, "user", item, 1 AS label FROM c WHERE copy = 0 UNION ALL SELECT index, "user", item, 0 FROM n),
e AS (SELECT *, row_number() OVER (ORDER BY {h_sql('index', '2', 42)}, index) - 1 AS pos FROM b)"""


def prepared(t) -> R.Prepared:
    return R.ratings_prepare(staged(t.ratings, "raw"))


def n_items(p: R.Prepared) -> int:
    return p.rows.agg(F.max("item") + 1).first()[0]


def candidates(t, negatives=NEGATIVES):
    p = prepared(t)
    return R.eval_candidates(p, n_items(p), negatives, 31)


def scored(t):
    score = mix("user", "item", 32) / F.lit(float(MODULUS))
    return candidates(t).withColumn("score", score)


@check("ratings_prepare", "ratings", f'WITH {PREP_SQL} SELECT "user", item, ts, split FROM prep')
def _(t):
    return prepared(t).rows


@check("leave_last_out", "ratings", f"""WITH {PREP_SQL} SELECT "user", item, ts FROM prep WHERE split = 'eval'""")
def _(t):
    return prepared(t).eval.drop("split")


@check("user_and_item_maps", "ratings", f"""
WITH {PREP_SQL} SELECT 'user' AS kind, user_id AS id, "user" AS index FROM um UNION ALL SELECT 'item', item_id, item FROM im""")
def _(t):
    p = prepared(t)
    side = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), F.col(kind).alias("index"))
    return side(p.users, "user").unionByName(side(p.items, "item"))


@check("negatives_anti", "ratings", f"""
WITH {PREP_SQL} SELECT um."user", count(*) AS negatives, sum(im.item)::BIGINT AS item_sum, min(im.item) AS first_item, max(im.item) AS last_item
FROM um CROSS JOIN im LEFT JOIN train ON train."user" = um."user" AND train.item = im.item WHERE train.item IS NULL GROUP BY 1""")
def _(t):
    p = prepared(t)
    ranges = R.negative_intervals(p.train, n_items(p))
    size = F.col("high") - F.col("low") + 1
    return ranges.groupBy("user").agg(
        F.sum(size).alias("negatives"),
        F.sum(F.expr("(low + high) * (high - low + 1) div 2")).alias("item_sum"),
        F.min("low").alias("first_item"), F.max("high").alias("last_item"),
    )


@check("negative_bisection", "ratings", f"""
WITH {EVAL_SQL} SELECT "user", draw, item FROM neg""")
def _(t):
    p = prepared(t)
    draws = R.user_counts(p.train).select("user", "positives", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(NEGATIVES).cast("bigint"))).alias("draw"))
    draws = draws.withColumn("r", R.negative_choice(n_items(p), F.col("draw"), 31))
    return R.nth_negatives(staged(R.negative_tallies(p.train)), draws.select("user", "draw", "r"))


@check("negative_sampler", "ratings", f"""
WITH {EVAL_SQL} SELECT "user", draw, r FROM draws""")
def _(t):
    p = prepared(t)
    draws = R.user_counts(p.train).select("user", "positives", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(NEGATIVES).cast("bigint"))).alias("draw"))
    return draws.select("user", "draw", R.negative_choice(n_items(p), F.col("draw"), 31).alias("r"))


def epoch(t, p=None, n=2):
    p = p or prepared(t)
    return R.train_epoch(p, n_items(p), 4, 1024, n, 41)


@check("train_epoch", "ratings", f"""
WITH {EPOCH_SQL} SELECT index, "user", item, label, pos // 1024 AS batch_id, pos % 1024 AS pos_in_batch FROM e""")
def _(t):
    return epoch(t)


@check("pad_last_batch", "ratings", f"""
WITH {EPOCH_SQL}, k AS (SELECT count(*) AS n FROM e), z AS (SELECT n, j FROM k, range((SELECT (1024 - n % 1024) % 1024 FROM k)) x(j))
SELECT batch_id, count(*) AS n, sum(label)::BIGINT AS positives, sum(valid)::BIGINT AS valid, sum(item)::BIGINT AS items, sum("user")::BIGINT AS users FROM (
  SELECT pos // 1024 AS batch_id, "user", item, label, 1 AS valid FROM e
  UNION ALL SELECT n // 1024, j % n_users, j % n_items, 0, 0 FROM z, sizes) GROUP BY 1""")
def _(t):
    p = prepared(t)
    users = p.rows.agg(F.max("user") + 1).first()[0]
    out = R.pad_last_batch(epoch(t, p), 1024, users, n_items(p), rows=p.train.count() * 5)
    return out.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum("valid").alias("valid"),
        F.sum("item").alias("items"), F.sum("user").alias("users"),
    )


@check("eval_candidates", "ratings", f'WITH {EVAL_SQL} SELECT "user", slot, item, duplicate FROM cand')
def _(t):
    return candidates(t)


@check("eval_batches", "ratings", f"""
WITH {EVAL_SQL}, r AS (SELECT "user" AS row, "user", slot, item, duplicate FROM cand
  UNION ALL SELECT j, 0, s, 0, (s <> {NEGATIVES})::INT FROM sizes, range(n_users, n_users + (64 - n_users % 64) % 64) x(j), range({NEGATIVES + 1}) y(s))
SELECT row // 64 AS batch_id, count(*) AS n, sum(duplicate)::BIGINT AS duplicates, sum(item)::BIGINT AS items FROM r GROUP BY 1""")
def _(t):
    p = prepared(t)
    users = p.rows.agg(F.max("user") + 1).first()[0]
    rows = R.pad_eval(R.eval_candidates(p, n_items(p), NEGATIVES, 31), users, 64, NEGATIVES)
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("duplicate").alias("duplicates"), F.sum("item").alias("items")
    )


@check("hr_ndcg_at_k", "ratings", f"""
WITH {RANK_SQL} SELECT round(avg((rank < 10)::INT), 9) AS hr, round(avg(CASE WHEN rank < 10 THEN ln(2) / ln(rank + 2) ELSE 0 END), 9) AS ndcg, count(*) AS users FROM rk""")
def _(t):
    out = R.hr_ndcg(R.hit_and_gain(scored(t), NEGATIVES, drop_duplicates=True))
    return out.select(F.round("hr", 9).alias("hr"), F.round("ndcg", 9).alias("ndcg"), "users")


@check("hit_and_gain_per_user", "ratings", f"""
WITH {RANK_SQL} SELECT "user", rank::INT AS rank, (rank < 10)::INT AS hit, round(CASE WHEN rank < 10 THEN ln(2) / ln(rank + 2) ELSE 0 END, 9) AS gain FROM rk""")
def _(t):
    out = R.hit_and_gain(scored(t), NEGATIVES, drop_duplicates=True)
    return out.select("user", "rank", "hit", F.round("gain", 9).alias("gain"))


@check("eval_example_weights", "ratings", f"""
WITH {eval_sql(R.EVAL_NEGATIVES)} SELECT "user", slot, round(CASE WHEN slot = {R.EVAL_NEGATIVES} THEN 1.0 ELSE 4 / {R.EVAL_NEGATIVES}.0 END * {R.EVAL_NEGATIVES + 1} / 5, 9)::DOUBLE AS weight FROM cand""")
def _(t):
    """Whole evaluation lists: every user's held-out item among ``EVAL_NEGATIVES`` negatives."""
    weight = R.example_weight(F.col("slot") == R.EVAL_NEGATIVES, 4, R.EVAL_NEGATIVES)
    return candidates(t, R.EVAL_NEGATIVES).select("user", "slot", F.round(weight, 9).alias("weight"))


@check("offline_epoch_files", "ratings", f"""
WITH {EPOCH_SQL} SELECT (pos // 1024 % 16)::INT AS shard, count(*) AS n, sum(item)::BIGINT AS items, sum(label)::BIGINT AS positives FROM e GROUP BY 1""")
def _(t):
    path = fresh_folder(t.spark, "cycles")
    R.write_epochs({2: epoch(t)}, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.sum("item").alias("items"), F.sum("label").alias("positives"))


def padded(t):
    p = prepared(t)
    users = p.rows.agg(F.max("user") + 1).first()[0]
    return R.pad_eval(R.eval_candidates(p, n_items(p), NEGATIVES, 31), users, 64, NEGATIVES)


PADDED_SQL = EVAL_SQL + f""",
r AS (SELECT "user" AS row, "user", slot, item, duplicate FROM cand
  UNION ALL SELECT j, 0, s, 0, (s <> {NEGATIVES})::INT FROM sizes, range(n_users, n_users + (64 - n_users % 64) % 64) x(j), range({NEGATIVES + 1}) y(s))"""


@check("eval_example_weights_padded", "ratings", f"""
WITH {PADDED_SQL} SELECT row, slot::INT AS slot, round(CASE WHEN row >= n_users THEN 0.0 WHEN slot = {NEGATIVES} THEN {NEGATIVES + 1} / 5.0
  ELSE 4 / {NEGATIVES}.0 * {NEGATIVES + 1} / 5 END, 9)::DOUBLE AS weight FROM r, sizes""")
def _(t):
    """Weights of whole batches; lists that only fill one up weigh nothing."""
    return R.padded_weights(padded(t), 4, NEGATIVES).select("row", "slot", F.round("weight", 9).alias("weight"))


@check("offline_eval_files", "ratings", f"""
WITH {PADDED_SQL} SELECT (row // 64 % 16)::INT AS shard, count(*) AS n, sum(item)::BIGINT AS items, sum(duplicate)::BIGINT AS duplicates FROM r GROUP BY 1""")
def _(t):
    path = fresh_folder(t.spark, "cycles")
    R.write_eval(padded(t), path)
    back = t.spark.read.parquet(f"{path}/eval")
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.sum("item").alias("items"), F.sum("duplicate").alias("duplicates"))


@check("ratings_summary", "ratings", f"""
WITH {PREP_SQL} SELECT n_users AS users, n_items AS items, (SELECT count(*) FROM train) AS train_positives, n_users AS eval_positives,
  ceil((SELECT count(*) FROM train) * 5 / 1024)::BIGINT AS train_batches, ceil(n_users * {NEGATIVES + 1} / 1616)::BIGINT AS eval_batches FROM sizes""")
def _(t):
    return R.ratings_summary(prepared(t), 4, 1024, 16 * (NEGATIVES + 1), NEGATIVES)
