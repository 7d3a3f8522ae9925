"""Registered queries: scans, generators and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators.ordered import with_position
from feedloom.plans.catalog import check
from feedloom.plans.tables import h_sql
from feedloom.session import fresh_folder
from feedloom.sources import generators, readers, shards, sinks


@check("scan_match_files", sql="""
SELECT 'orders' AS part, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation""")
def _(t):
    spec = [f"{t.dir}/order*.parquet, {t.dir}/nation.parquet"]
    paths = readers.match_files(t.spark, spec)
    parts = [
        t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("part", F.lit(p.split("/")[-1].split(".")[0]))
        for p in paths
    ]
    return parts[0].unionByName(parts[1])


@check("scan_records", sql="SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(t):
    return readers.read_records(t.spark, f"{t.dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )


@check("scan_tsv_typed", sql="""
SELECT (l_returnflag = 'R')::INT::DOUBLE AS label,
  CASE WHEN l_linenumber = 3 THEN 7.0 ELSE l_quantity END::DOUBLE AS d0, l_linenumber::DOUBLE AS d1,
  (l_partkey % 40)::INT AS s0, (l_suppkey % 12)::INT AS s1 FROM lineitem""")
def _(t):
    """Lines are written out as tab-separated text, with -1 for some values, and read back."""
    text = lambda c: F.col(c).cast("string")
    rows = t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("label"),
        F.when(F.col("l_linenumber") == 3, "-1").otherwise(text("l_quantity")).alias("d0"),
        text("l_linenumber").alias("d1"),
        (F.col("l_partkey") % 40).cast("string").alias("s0"),
        (F.col("l_suppkey") % 12).cast("string").alias("s1"),
    )
    path = fresh_folder(t.spark, "tsv")
    rows.write.csv(path, sep="\t")
    back = readers.read_typed_tsv(t.spark, path, 2, 2, [0, 7, 0, 0, 0])
    return back.select(
        F.col("label").cast("double").alias("label"),
        F.col("dense_features")[0].cast("double").alias("d0"),
        F.col("dense_features")[1].cast("double").alias("d1"),
        F.col("sparse_features.0").alias("s0"), F.col("sparse_features.1").alias("s1"),
    )


@check("scan_delimited_normalise", "ratings", """
SELECT user_id, item_id, rating::INT AS rating, ts FROM ratings""")
def _(t):
    names = ["user_id", "item_id", "rating", "ts"]
    path = fresh_folder(t.spark, "delimited")
    t.ratings.select(
        F.concat_ws("::", "user_id", "item_id", F.col("rating").cast("int"), "ts")
    ).write.text(path)
    rows = readers.read_delimited(t.spark, path, names, "::")
    kinds = ["bigint", "bigint", "int", "bigint"]
    return rows.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)])


@check("scan_tsv_jsonl", sql="""
SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events""")
def _(t):
    folder = fresh_folder(t.spark, "lines")
    t.events.select("event_id", "event_type").write.csv(f"{folder}/tsv", sep="\t")
    t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).write.json(
        f"{folder}/jsonl"
    )
    tsv = readers.read_tsv(t.spark, f"{folder}/tsv", "event_id bigint, event_type string")
    jsonl = readers.read_json_lines(t.spark, f"{folder}/jsonl", "event_id bigint, k int")
    return tsv.join(jsonl, "event_id")


@check("scan_sentence_docs", sql="""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS no, unnest(x) AS line FROM (
  SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INT AS sent_id,
  len(regexp_split_to_array(trim(line), '\\s+'))::INT AS n_tokens FROM l WHERE trim(line) <> ''""")
def _(t):
    rows = readers.sentence_rows(t.documents, "doc_id", "text")
    return rows.select("doc_id", "sent_id", F.size(F.split("sentence", r"\s+")).alias("n_tokens"))


@check("scan_token_label_lines", sql="""
WITH l AS (SELECT doc_id, (generate_subscripts(x, 1) - 1)::INT AS sent_id, unnest(x) AS line FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS x FROM documents)),
w AS (SELECT doc_id, sent_id, (generate_subscripts(y, 1) - 1)::INT AS pos, unnest(y) AS token FROM (
  SELECT doc_id, sent_id, regexp_split_to_array(line, '\\s+') AS y FROM l))
SELECT doc_id, sent_id, pos, token,
  CASE length(token) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS label_id FROM w""")
def _(t):
    """Documents are turned into token/label lines: one block per sentence."""
    from feedloom.operators.joins import label_map

    label = lambda w: F.when(F.length(w) % 4 == 1, "\tB").when(F.length(w) % 4 == 2, "\tI").otherwise(
        F.when(F.length(w) % 4 == 3, "\tO").otherwise("")
    )
    blocks = F.transform(
        F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""),
        lambda s: F.array_join(
            F.transform(F.split(F.trim(s), r"\s+"), lambda w: F.concat(w, label(w))), "\n"
        ),
    )
    files = t.documents.select("doc_id", F.array_join(blocks, "\n\n").alias("text"))
    return readers.token_label_rows(files, "doc_id", "text", label_map(t.spark, ["0,O", "1,B", "2,I"]))


@check("scan_qa_json", "qa", """
SELECT 'd' || qid % 7 AS title, qid::VARCHAR AS qid, NOT has_answer AS is_impossible,
  CASE WHEN has_answer THEN truth ELSE '' END AS text, CASE WHEN has_answer THEN length(context) ELSE -1 END AS n FROM qa""")
def _(t):
    """Written as one nested JSON document per question block and read back flat."""
    answers = F.when(
        F.col("has_answer"),
        F.array(F.struct(F.col("truth").alias("text"), F.length("context").alias("answer_start"))),
    )
    question = F.struct(
        F.col("qid").cast("string").alias("id"), F.lit("?").alias("question"),
        (~F.col("has_answer")).alias("is_impossible"), answers.alias("answers"),
    )
    paragraph = F.struct(F.col("context").alias("context"), F.array(question).alias("qas"))
    article = F.struct(
        F.concat(F.lit("d"), (F.col("qid") % 7).cast("string")).alias("title"),
        F.array(paragraph).alias("paragraphs"),
    )
    path = fresh_folder(t.spark, "qa-json")
    t.qa.select(F.array(article).alias("data")).write.json(path)
    rows = readers.flatten_qa(t.spark.read.schema(readers.QA_SCHEMA).json(path))
    return rows.select(
        "title", "qid", "is_impossible", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("answer_start", F.lit(-1)).cast("bigint").alias("n"),
    )


@check("scan_crawled_articles", sql="""
SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages""")
def _(t):
    path = fresh_folder(t.spark, "articles")
    t.pages.select(
        "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("maintext"), (F.col("page_id") % 3).alias("site"),
    ).write.partitionBy("site").option("maxRecordsPerFile", 1).json(path)
    return readers.read_articles(t.spark, path).select(
        "url", "title", F.length("maintext").cast("bigint").alias("n")
    )


@check("scan_binary_files")
def _(t):
    """The parquet files themselves as named binary files."""
    names = t.region.limit(1).select(F.explode(F.array(F.lit("nation.parquet"), F.lit("region.parquet"))).alias("name"))
    return readers.read_binary_files(t.spark, [t.dir], names).select("name", "length")


@check("gen_range", sql="SELECT i AS id FROM range((SELECT count(*) FROM orders)) r(i)")
def _(t):
    return generators.int_range(t.spark, t.orders.count())


@check("gen_constant_rows")
def _(t):
    """As many rows as there are events, sized by the widest one."""
    widest = t.events.agg(F.max(F.length("props"))).first()[0]
    return generators.constant_rows(t.spark, t.events.count(), widest * 8, 2, "bigint", 1)


@check("gen_ranking_synthetic", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  floor((l_quantity / 50 + l_discount * 10 + l_tax * 10) / 3.0 / 2 + (l_partkey % 40 + l_suppkey % 12) / 52.0 / 2 + 0.5)::INT AS label
FROM lineitem""")
def _(t):
    dense = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10]
    sparse = [F.col("l_partkey") % 40, F.col("l_suppkey") % 12]
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        generators.ranking_label(dense, sparse, [40, 12]).alias("label"),
    )


@check("sink_sharded", sql="""
SELECT (p % 16)::INT AS shard, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1""")
def _(t):
    path = fresh_folder(t.spark, "shards")
    sinks.write_sharded(t.orders.select("o_orderkey", "o_custkey"), path, 16, ["o_orderkey"])
    back = sinks.read_shards(t.spark, path, "o_orderkey bigint, o_custkey bigint, shard int")
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@check("sink_reread", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    path = fresh_folder(t.spark, "shards")
    sinks.write_sharded(rows, path, 8, ["o_orderkey"], shuffle_key="o_orderkey", seed=2)
    return sinks.read_shards(t.spark, path, rows.schema)


@check("sink_named_shards", sql="""
SELECT 'orders-' || lpad((p % 16 + 1)::VARCHAR, 5, '0') || '-of-00016' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, false AS again FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1""")
def _(t):
    """A set of named shards; a second job finds it whole and writes nothing."""
    path = fresh_folder(t.spark, "set")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    shards.write_set(rows, path, "orders", 16, ["o_orderkey"], tasks=24)
    again = shards.write_set(rows.filter("o_orderkey is null"), path, "orders", 16, ["o_orderkey"])
    back = shards.read_set(t.spark, path, "orders", 16, "name")
    return back.groupBy("name").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("again", F.lit(again))


@check("sink_named_shards_shuffled", sql=f"""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
s AS (SELECT p % 8 AS shard, o_orderkey, row_number() OVER (PARTITION BY p % 8 ORDER BY {h_sql('o_orderkey', '0', 4)}, p) - 1 AS place FROM p)
SELECT 'orders-' || lpad((shard + 1)::VARCHAR, 5, '0') || '-of-00008' AS name, place, o_orderkey FROM s""")
def _(t):
    """Rows of each shard in a seeded order, read back part by part: the place follows from the parts' row counts."""
    path = fresh_folder(t.spark, "set")
    shards.write_set(t.orders.select("o_orderkey"), path, "orders", 8, ["o_orderkey"], shuffle_key="o_orderkey", seed=4, tasks=24)
    starts = []
    for name, files in shards.parts_of(path, "orders", 8).items():
        before = 0
        for file, n in sorted(files.items()):
            starts.append((name, file, before))
            before += n
    starts = t.spark.createDataFrame(starts, "name string, file string, before bigint")
    rows = shards.read_set(t.spark, path, "orders", 8, "name")
    rows = rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(starts, ["name", "file"]).select("name", (F.col("before") + F.col("row")).alias("place"), "o_orderkey")


@check("sink_csv_results", "sweep", """
SELECT cache_policy, sleep_ms::INT AS sleep_ms, count(*) AS epochs, round(avg(seconds), 6) AS avg_seconds FROM sweep GROUP BY 1, 2""")
def _(t):
    path = fresh_folder(t.spark, "results")
    table = t.sweep.groupBy("cache_policy", "sleep_ms").agg(
        F.count("*").alias("epochs"), F.round(F.avg("seconds"), 6).alias("avg_seconds")
    )
    sinks.write_results(table, path)
    return t.spark.read.csv(
        path, header=True, schema="cache_policy bigint, sleep_ms int, epochs bigint, avg_seconds double"
    )


@check("sink_metadata_json", sql="""
SELECT count(*) AS train_size, max(length(text)) AS max_length,
  array_to_string(list_sort(list_distinct(list(lang))), ',') AS labels FROM documents""")
def _(t):
    path = fresh_folder(t.spark, "metadata")
    summary = t.documents.agg(
        F.count("*").alias("train_size"), F.max(F.length("text")).cast("bigint").alias("max_length"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("labels"),
    )
    sinks.write_metadata(summary, path)
    return t.spark.read.schema("train_size bigint, max_length bigint, labels string").json(path)
