"""Registered queries: projections, reshaping, ordering, sampling, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import arrays as A
from feedloom.functions.hashing import mix
from feedloom.operators import batching as B
from feedloom.operators import dataset as D
from feedloom.operators.ordered import sorted_rows, top_rows, with_position
from feedloom.plans.catalog import check
from feedloom.plans.tables import h_sql

NAME_WORDS = (
    "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()
)
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


def words(column="text"):
    return F.filter(F.split(column, r"\s+"), lambda w: w != "")


# --- projections, filters, reshaping -------------------------------------------------------


@check("map_columns", sql="""
SELECT o_orderkey, o_custkey + 1 AS next_cust, o_totalprice * 2 AS double_price FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey",
        (F.col("o_custkey") + 1).alias("next_cust"),
        (F.col("o_totalprice") * 2).alias("double_price"),
    )


for _name in ("map_inflate", "map_inflate_bytes"):

    @check(_name, sql="""
SELECT doc_id, text AS a, text AS b, substr(hex(encode(text)), 1, strlen(text) // 2 * 2) AS half FROM documents""")
    def _(t):
        """The whole text twice and the first half of its bytes; in hex, as a character may be cut."""
        from feedloom.functions.text import half_bytes

        return t.documents.select("doc_id", F.col("text").alias("a"), F.col("text").alias("b"), F.hex(half_bytes("text")).alias("half"))


@check("filter_predicate", sql="""
SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 20""")
def _(t):
    return t.events.filter("event_type = 'purchase' AND value > 20").select(
        "event_id", "user_id", "value"
    )


@check("filter_max_length", "pairs", """
SELECT conv_id, turn, len(string_split(a, ' ')) AS len_a, len(string_split(b, ' ')) AS len_b
FROM pairs WHERE greatest(len(string_split(a, ' ')), len(string_split(b, ' '))) <= 64""")
def _(t):
    return (
        t.pairs.select(
            "conv_id", "turn",
            F.size(F.split("a", " ")).alias("len_a"), F.size(F.split("b", " ")).alias("len_b"),
        )
        .filter(F.greatest("len_a", "len_b") <= 64)
    )


@check("truncate_with_eos", "pairs", """
SELECT conv_id, turn, array_to_string(CASE WHEN len(x) > 32 THEN list_append(x[1:31], 1) ELSE x END, ',')
  AS ids FROM (SELECT conv_id, turn, list_transform(string_split(b, ' '), lambda w: length(w) + 1) AS x FROM pairs)""")
def _(t):
    ids = F.transform(F.split("b", " "), lambda w: F.length(w) + 1)
    return t.pairs.select(
        "conv_id", "turn",
        F.array_join(A.truncate_with_eos(ids, 32).cast("array<string>"), ",").alias("ids"),
    )


@check("flat_map", sql="""
SELECT o_orderkey, unnest([o_custkey, o_custkey * 10]) AS v FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") * 10)).alias("v")
    )


@check("unbatch_rebatch", sql="""
SELECT n // 100 AS batch_id, n % 100 AS pos_in_batch, vec_id, x FROM (
  SELECT vec_id, x, row_number() OVER (ORDER BY vec_id, i) - 1 AS n FROM (
    SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i
    FROM embeddings))
WHERE n // 100 < (SELECT sum(len(embedding)) // 100 FROM embeddings)""")
def _(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return B.unbatch_rebatch(rows, ["x"], "vec_id", 100, drop_remainder=True)


@check("enumerate_rows", sql="""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders""")
def _(t):
    return with_position(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@check("pad_or_clip", "vectors", """
SELECT vec_id, unnest(range(40)) AS i, unnest(p) AS x FROM (
  SELECT vec_id, list_concat(k, list_transform(range(40 - len(k)), lambda z: -1.0::DOUBLE)) AS p
  FROM (SELECT vec_id, v[1:least(20 + vec_id % 30, 40)] AS k FROM vectors))""")
def _(t):
    cut = F.slice("v", F.lit(1), (20 + F.col("vec_id") % 30).cast("int"))
    padded = A.pad_or_clip(cut, 40, -1.0)
    return t.vectors.select("vec_id", F.posexplode(padded).alias("i", "x")).withColumn(
        "i", F.col("i").cast("bigint")
    )


@check("source_id_normalise", sql="""
SELECT page_id, coalesce(try_cast(nullif(regexp_extract(url, '/([0-9]*)[^/]*$', 1), '') AS BIGINT), -1)
  AS source_id FROM pages""")
def _(t):
    from feedloom.functions.text import source_id

    return t.pages.select(
        "page_id", source_id(F.regexp_extract("url", "/([0-9]*)[^/]*$", 1)).alias("source_id")
    )


@check("label_map_lookup", sql="""
SELECT event_id, coalesce(id, -1) AS label_id FROM events
LEFT JOIN (VALUES (0, 'click'), (1, 'view'), (2, 'purchase')) m(id, name) ON name = event_type""")
def _(t):
    from feedloom.operators.joins import label_map, lookup

    names = label_map(t.spark, ["0,click", "1,view", "2,purchase"])
    return lookup(t.events, "event_type", names, "label_id", -1).select("event_id", "label_id")


@check("genre_multi_hot", "items", f"""
SELECT item_id, array_to_string(list_transform({NAME_WORDS!r},
  lambda v: list_contains(string_split(genres, '|'), v)::INT), '') AS hot FROM items""")
def _(t):
    hot = A.multi_hot("genres", NAME_WORDS)
    return t.items.select("item_id", F.array_join(hot.cast("array<string>"), "").alias("hot"))


@check("one_hot_label", sql="""
SELECT event_id, array_to_string(list_transform(range(8), lambda i: (i = user_id % 8 OR i = event_id % 3)::INT), '')
  AS hot FROM events""")
def _(t):
    labels = F.array((F.col("user_id") % 8).cast("int"), (F.col("event_id") % 3).cast("int"))
    return t.events.select(
        "event_id", F.array_join(A.one_hot(labels, 8).cast("array<string>"), "").alias("hot")
    )


@check("dequantise", "vectors", """
SELECT vec_id, unnest(range(len(v))) AS i, round(unnest(list_transform(v,
  lambda x: floor((x + 1) * 127) * (4.0::DOUBLE / 255.0::DOUBLE) + (4.0::DOUBLE / 512.0::DOUBLE - 2.0::DOUBLE))), 6) AS x
FROM vectors""")
def _(t):
    codes = F.transform("v", lambda x: F.floor((x + 1) * 127).cast("double"))
    rows = t.vectors.select("vec_id", F.posexplode(A.dequantise(codes, -2.0, 2.0)).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("bigint"), F.round("x", 6).alias("x"))


@check("normalise_array", "vectors", """
SELECT vec_id, i, round((x - [0.1, 0.2, 0.3][(i % 3 + 1)::INT]) / [0.5, 0.25, 0.125][(i % 3 + 1)::INT], 6) AS x
FROM (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM vectors)""")
def _(t):
    scaled = A.normalise("v", [0.1, 0.2, 0.3], [0.5, 0.25, 0.125])
    rows = t.vectors.select("vec_id", F.posexplode(scaled).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("bigint"), F.round("x", 6).alias("x"))


@check("dense_log1p", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(ln(1 + greatest(coalesce(nullif(l_quantity - 10, -1), 0), 0)), 9) AS d0,
  round(ln(1 + greatest(l_extendedprice, 0)), 9) AS d1, l_partkey % 40 AS s0, l_suppkey % 12 AS s1
FROM lineitem""")
def _(t):
    from feedloom.functions.scalars import bucketise, log_dense

    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(log_dense(F.nullif(F.col("l_quantity") - 10, F.lit(-1.0))), 9).alias("d0"),
        F.round(log_dense("l_extendedprice"), 9).alias("d1"),
        bucketise("l_partkey", 40).alias("s0"), bucketise("l_suppkey", 12).alias("s1"),
    )


@check("concat_features", "vectors", """
SELECT vec_id, unnest(range(32)) AS frame, unnest(list_transform(range(32),
  lambda f: v[f * 2 + 1] + v[f * 2 + 2] * 3 + (f + label) * 5)) AS dot FROM vectors""")
def _(t):
    frames = F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda f: F.slice("v", f * 2 + 1, F.lit(2))
    )
    extra = F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda f: F.array((f + F.col("label")).cast("double"))
    )
    joined = A.concat_features(frames, extra)
    rows = t.vectors.select("vec_id", F.posexplode(joined).alias("frame", "r"))
    return rows.select(
        "vec_id", F.col("frame").cast("bigint"),
        (F.get("r", F.lit(0)) + F.get("r", F.lit(1)) * 3 + F.get("r", F.lit(2)) * 5).alias("dot"),
    )


# --- ordering, sampling, limits, batching --------------------------------------------------


@check("shuffle_seeded", sql=f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {h_sql('o_orderkey', '0', 11)}, o_orderkey) - 1 AS pos
FROM orders""")
def _(t):
    return D.shuffle_seeded(t.orders.select("o_orderkey"), "o_orderkey", 11)


for _name, _cached in (("shuffle_reshuffle_epochs", False), ("shuffle_fixed_epochs", True)):

    @check(_name, sql=f"""
SELECT o_orderkey, epoch::INT AS epoch, row_number() OVER (PARTITION BY epoch
  ORDER BY {h_sql('o_orderkey', '0' if _cached else 'epoch', 5)}, o_orderkey) - 1 AS pos
FROM orders, range(3) r(epoch)""")
    def _(t, cached=_cached):
        return D.shuffle_epochs(t.orders.select("o_orderkey"), "o_orderkey", 5, 3, cached)


@check("repeat_epochs", sql="SELECT event_id, epoch::INT AS epoch FROM events, range(3) r(epoch)")
def _(t):
    return D.repeat_epochs(t.events.select("event_id"), 3)


@check("take_rows", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500")
def _(t):
    return D.take_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, ["o_totalprice", "o_orderkey"])


@check("skip_rows", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 500")
def _(t):
    return D.skip_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, ["o_totalprice", "o_orderkey"])


@check("take1_cache_repeat", sql="""
SELECT o_orderkey, epoch::INT AS epoch FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 256),
  range(4) r(epoch)""")
def _(t):
    return D.take_batch_and_repeat(t.orders.select("o_orderkey"), 256, 4, ["o_orderkey"])


@check("shard_by_index", sql="""
SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
WHERE pos % 4 = 1""")
def _(t):
    return D.shard_rows(t.orders.select("o_orderkey"), 4, 1, ["o_orderkey"])


@check("interleave_round_robin", sql="""
SELECT event_id, event_type, row_number() OVER (ORDER BY rn // 4, event_type, rn) - 1 AS pos FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn FROM events)""")
def _(t):
    return D.interleave(t.events.select("event_id", "event_type"), "event_type", ["event_id"], 5, 4)


@check("concat_datasets", sql="""
SELECT src, o_orderkey, row_number() OVER (ORDER BY src, o_orderkey) - 1 AS pos FROM (
  SELECT 0 AS src, o_orderkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def _(t):
    o = t.orders
    parts = [o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'")]
    return D.concat_datasets([p.select("o_orderkey") for p in parts], ["o_orderkey"])


@check("zip_datasets", sql="""
SELECT a.pos, o_orderkey, event_id FROM
  (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) a JOIN
  (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) b ON a.pos = b.pos""")
def _(t):
    return D.zip_datasets(t.orders.select("o_orderkey"), t.events.select("event_id"), ["o_orderkey"], ["event_id"])


@check("mix_ratio_batches", sql="""
WITH s AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS pos FROM labels),
r AS (SELECT doc_id, CASE quality WHEN 1 THEN 'labelled' ELSE 'pseudo' END AS source,
        pos // CASE quality WHEN 1 THEN 12 ELSE 4 END AS batch_id FROM s)
SELECT doc_id, source, batch_id FROM r WHERE batch_id < (SELECT least(
  count(*) FILTER (WHERE quality = 1) // 12, count(*) FILTER (WHERE quality = 0) // 4) FROM labels)""")
def _(t):
    pick = lambda q: t.labels.filter(F.col("quality") == q).select("doc_id")
    return D.mix_ratio_batches(pick(1), pick(0), 16, 1 / 3, ["doc_id"])


@check("sample_mixture", sql=f"""
WITH d AS (SELECT i AS draw, {h_sql('i', '0', 9)} / 2147483647.0::DOUBLE AS u
           FROM range((SELECT count(*) FROM events)) r(i)),
p AS (SELECT draw, CASE WHEN u < 0.5 THEN 'click' WHEN u < 0.8 THEN 'view' WHEN u < 1.0 THEN 'error' END AS event_type FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY draw) AS n FROM p),
e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)
SELECT q.event_type, draw, event_id FROM q JOIN e ON q.event_type = e.event_type AND q.n = e.n""")
def _(t):
    events = t.events.select("event_id", "event_type")
    return D.sample_mixture(
        events, "event_type", {"click": 0.5, "view": 0.3, "error": 0.2}, events.count(), ["event_id"], 9
    )


@check("combine_sources", sql="""
SELECT 'orders' AS source, o_orderkey AS id FROM orders UNION ALL SELECT 'events', event_id FROM events""")
def _(t):
    return D.combine_sources({
        "orders": t.orders.select(F.col("o_orderkey").alias("id")),
        "events": t.events.select(F.col("event_id").alias("id")),
    })


@check("batch_rows", sql="""
SELECT o_orderkey, p // 64 AS batch_id, p % 64 AS pos_in_batch FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)
WHERE p // 64 < (SELECT count(*) // 64 FROM orders)""")
def _(t):
    return B.batch_rows(t.orders.select("o_orderkey"), 64, ["o_orderkey"], drop_remainder=True)


@check("batch_counts", sql="""
SELECT event_type, ceil(ceil(count(*) / 32) / 4)::BIGINT * 4 AS batches FROM events GROUP BY event_type""")
def _(t):
    from feedloom.functions.scalars import batches_needed

    return t.events.groupBy("event_type").agg(
        batches_needed(F.count(F.lit(1)), 32, 4).alias("batches")
    )


@check("padded_batch", "pairs", """
WITH n AS (SELECT conv_id, turn, list_transform(string_split(a, ' '), lambda w: length(w)) AS x,
  (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS batch_id FROM pairs),
m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS w FROM n)
SELECT conv_id, turn, batch_id, array_to_string(list_concat(x, list_transform(range(w - len(x)), lambda z: -1)), ',') AS ids
FROM m""")
def _(t):
    ids = F.transform(F.split("a", " "), lambda w: F.length(w))
    rows = t.pairs.select("conv_id", "turn", ids.alias("ids"))
    out = B.padded_batch(rows, 16, ["conv_id", "turn"], {"ids": -1})
    return out.select(
        "conv_id", "turn", "batch_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")
    )


_EDGES = """b(i, lo, hi) AS (
  SELECT i, lo, coalesce(lead(lo) OVER (ORDER BY i), 257) FROM (
    WITH RECURSIVE e(i, x) AS (SELECT 1, 8 UNION ALL
      SELECT i + 1, greatest(x + 1, floor(x * 1.1)::INT) FROM e WHERE greatest(x + 1, floor(x * 1.1)::INT) < 256)
    SELECT 0 AS i, 0 AS lo UNION ALL SELECT i, x FROM e))"""


@check("bucket_boundaries", sql=f"""
WITH {_EDGES}
SELECT o_orderkey, i AS bucket, hi AS bucket_max FROM (SELECT o_orderkey, o_custkey % 257 AS n FROM orders) JOIN b ON lo <= n AND n < hi""")
def _(t):
    uppers = [hi for _, hi in B.bucket_boundaries(256)]
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 257).alias("n"))
    rows = rows.withColumn("bucket", B._bucket(F.col("n"), uppers)).drop("n")
    return rows.withColumn("bucket_max", F.get(F.array(*map(F.lit, uppers)), "bucket"))


@check("bucket_by_length", "pairs", f"""
WITH {_EDGES},
p AS (SELECT conv_id, turn, greatest(len(string_split(a, ' ')), len(string_split(b, ' '))) AS n FROM pairs),
q AS (SELECT conv_id, turn, n, i, hi, row_number() OVER (PARTITION BY i ORDER BY conv_id, turn) - 1 AS k
      FROM p JOIN b ON lo <= n AND n < hi WHERE n <= 256)
SELECT conv_id, turn, n, i AS bucket, hi AS bucket_max, k // (1024 // hi) AS batch_in_bucket FROM q""")
def _(t):
    n = F.greatest(F.size(F.split("a", " ")), F.size(F.split("b", " ")))
    rows = t.pairs.select("conv_id", "turn", n.alias("n")).filter("n <= 256")
    return B.bucket_by_length(rows, F.col("n"), 256, 1024, ["conv_id", "turn"])


@check("bucket_fixed_lengths", sql=f"""
WITH d AS (SELECT doc_id, list_transform({WORDS}, lambda w: length(w)) AS x FROM documents),
e AS (SELECT doc_id, x, CASE WHEN len(x) < 33 THEN 0 WHEN len(x) < 129 THEN 1 WHEN len(x) < 513 THEN 2 ELSE 3 END AS bucket FROM d),
f AS (SELECT *, coalesce([32, 128, 512][bucket + 1], len(x)) AS w, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS k FROM e)
SELECT doc_id, bucket, k // 16 AS batch_in_bucket,
  array_to_string(list_concat(x, list_transform(range(w - len(x)), lambda z: 0)), ',') AS ids FROM f""")
def _(t):
    ids = F.transform(words(), lambda w: F.length(w))
    rows = t.documents.select("doc_id", ids.alias("ids"))
    out = B.bucket_fixed_lengths(rows, "ids", [32, 128, 512], 16, ["doc_id"])
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@check("group_by_window", sql="""
SELECT event_type, k // 7 AS window_id, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(value), 4) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1, 2""")
def _(t):
    rows = t.events.select("event_type", "event_id", "value")
    return (
        B.group_by_window(rows, ["event_type"], 7, ["event_id"])
        .groupBy("event_type", "window_id")
        .agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))
    )


@check("bucket_mask_trim", sql=f"""
WITH d AS (SELECT doc_id, list_transform({WORDS}, lambda w: length(w) % 4 - 1) AS x FROM documents)
SELECT doc_id, len(list_filter(x, lambda v: v <> 0)) AS n_mask,
  array_to_string(list_transform(list_filter(x, lambda v: v <> 0), lambda v: CASE WHEN v = -1 THEN 0 ELSE v END), ',') AS ids
FROM d""")
def _(t):
    ids = F.transform(words(), lambda w: F.length(w) % 4 - 1)
    rows = t.documents.select("doc_id", A.mask_trim(ids).alias("ids"))
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_mask"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
    )


@check("bucket_mask_even", sql=f"""
WITH d AS (SELECT doc_id // 8 AS batch_id, len(list_filter({WORDS}, lambda w: length(w) % 4 <> 1)) AS n FROM documents)
SELECT batch_id, min(n)::INT AS least, max(n)::INT AS most FROM d GROUP BY 1 HAVING min(n) <> max(n)""")
def _(t):
    """Batches whose rows do not hold equally many unpadded items, which trimming needs them to do."""
    ids = F.transform(words(), lambda w: F.length(w) % 4 - 1)
    rows = t.documents.select(F.expr("doc_id div 8").alias("batch_id"), ids.alias("ids"))
    return B.uneven_mask_batches(rows, "batch_id", "ids")


@check("sort_multi", "ratings", """
SELECT user_id, item_id, row_number() OVER (ORDER BY user_id, ts, item_id) - 1 AS pos FROM ratings""")
def _(t):
    return with_position(t.ratings, ["user_id", "ts", "item_id"]).select("user_id", "item_id", "pos")


@check("sort_by_length_desc", sql="""
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, len(regexp_split_to_array(trim(text), '\\s+')) AS k FROM documents)
SELECT doc_id, pos, k AS n_tokens, row_number() OVER (ORDER BY k DESC, pos) - 1 AS sorted_pos FROM n""")
def _(t):
    out = D.sort_by_length_desc(t.documents.select("doc_id", "text"), "text", ["doc_id"])
    return out.select("doc_id", "pos", F.col("n_tokens").cast("bigint"), "sorted_pos")


@check("top_k", "boxes", """
SELECT image_id, box_id, rank FROM (SELECT image_id, box_id,
  row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rank FROM boxes) WHERE rank <= 5""")
def _(t):
    top = top_rows(t.boxes, 5, [F.desc("score"), "box_id"], ["image_id"])
    return top.select("image_id", "box_id", F.col("rank").cast("bigint"))


@check("sample_sequence", "vectors", """
SELECT vec_id, s AS i, v[((o + s * 9) % 64 + 1)::INT] AS x FROM (
  SELECT vec_id, v, vec_id % 5 AS o, unnest(range(10)) AS s FROM vectors)""")
def _(t):
    picks = A.sample_sequence("v", 10, 9, F.col("vec_id") % 5)
    return t.vectors.select("vec_id", F.posexplode(picks).alias("i", "x")).withColumn(
        "i", F.col("i").cast("bigint"))


@check("sample_linspace", "vectors", """
SELECT vec_id, s AS i, v[(floor((64 - 8 * 3) * (s // 8) / 4)::INT + (s % 8) * 3) % 64 + 1] AS x FROM (
  SELECT vec_id, v, unnest(range(40)) AS s FROM vectors)""")
def _(t):
    picks = A.sample_linspace("v", 5, 8, 3)
    return t.vectors.select("vec_id", F.posexplode(picks).alias("i", "x")).withColumn(
        "i", F.col("i").cast("bigint"))


@check("balanced_sample", sql=f"""
WITH r AS (SELECT doc_id, quality = 1 AS positive,
  row_number() OVER (PARTITION BY quality ORDER BY {h_sql('doc_id', '0', 4)}, doc_id) AS k FROM labels),
c AS (SELECT least(count(*) FILTER (WHERE quality = 1), 16) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM labels)
SELECT doc_id, positive FROM r, c WHERE k <= CASE WHEN positive THEN p ELSE least(n, 64 - p) END""")
def _(t):
    return D.balanced_sample(t.labels.select("doc_id", "quality"), F.col("quality") == 1, 64, 0.25, "doc_id", 4).select("doc_id", "positive")


@check("sample_bytes", sql="""
SELECT doc_id, length(text) AS n FROM (SELECT *, sum(length(text) + 1) OVER (ORDER BY doc_id) - length(text) - 1 AS used
  FROM documents) WHERE used <= 500000""")
def _(t):
    out = D.sample_bytes(t.documents.select("doc_id", "text"), "text", 500000, ["doc_id"])
    return out.select("doc_id", F.length("text").cast("bigint").alias("n"))
