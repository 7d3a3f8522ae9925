"""Registered queries: joins, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.text import answer_aliases, normalize_url, split_words
from feedloom.operators import joins as J
from feedloom.operators.dataset import dedup_keep_last
from feedloom.operators.ordered import with_position
from feedloom.plans.catalog import check
from feedloom.sources.readers import flatten_evidence_qa

# Url variants with a query and a scheme change, five to a story.
PAGES_SQL = """p AS (SELECT page_id, page_id // 5 AS story_id, url,
  regexp_replace(url, '^https?:', CASE WHEN page_id % 2 = 0 THEN 'https:' ELSE 'http:' END) AS variant,
  regexp_replace(regexp_replace(url, '^([^?#]*)\\?[^#]*', '\\1'), '^https?://', '//') AS norm0,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages),
a AS (SELECT substr(norm0, 3) AS url, max(page_id) AS article_id, max_by(title, page_id) AS title FROM p GROUP BY 1),
s AS (SELECT story_id, min(page_id) AS first_page, count(*) AS n FROM p GROUP BY 1),
m AS (SELECT p.story_id, row_number() OVER (PARTITION BY p.story_id ORDER BY page_id) AS place, a.article_id, a.url, a.title
  FROM p JOIN a ON a.url = substr(p.norm0, 3) WHERE p.page_id % 3 <> 0)"""


def story_tables(t):
    """Stories of five urls each (every third one unknown) and the crawled articles."""
    variant = F.regexp_replace("url", "^https?:", "")
    variant = F.concat(F.when(F.col("page_id") % 2 == 0, "https:").otherwise("http:"), variant)
    known = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://gone.example/"), "page_id")).otherwise(variant)
    stories = t.pages.groupBy(F.floor(F.col("page_id") / 5).alias("story_id")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", known.alias("u")))).alias("l")
    )
    stories = stories.select(
        "story_id", F.transform("l", lambda e: e["u"]).alias("urls"),
        F.concat(F.lit("story "), F.col("story_id").cast("string")).alias("label"),
    )
    articles = t.pages.select(
        normalize_url("url").alias("url"), F.col("page_id").alias("article_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("body"),
    )
    return stories, dedup_keep_last(articles, ["url"], "article_id")


@check("join_ratings_items", "ratings items", """
SELECT user_id, item_id, rating::DOUBLE AS rating, titles, genres FROM ratings JOIN items USING (item_id)""")
def _(t):
    out = J.join_ratings_items(t.ratings.drop("ts"), t.items)
    return out.withColumn("rating", F.col("rating").cast("double"))


@check("join_annotations", sql="""
WITH b AS (SELECT o_custkey AS image_id, o_orderkey, o_orderpriority AS cat FROM orders WHERE o_custkey % 3 <> 0),
c AS (SELECT s_suppkey * 7 AS image_id, s_name AS caption FROM supplier),
bn AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY o_orderkey) - 1) // 10 AS part FROM b),
cn AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY caption) - 1) // 10 AS part FROM c),
g AS (SELECT image_id, part, array_to_string(list(o_orderkey || ':' || coalesce(name, '?') ORDER BY o_orderkey), ',') AS boxes
  FROM bn LEFT JOIN (VALUES ('1-URGENT', 'urgent'), ('2-HIGH', 'high'), ('5-LOW', 'low')) m(id, name) ON cat = id GROUP BY 1, 2),
h AS (SELECT image_id, part, array_to_string(list(caption ORDER BY caption), ',') AS captions FROM cn GROUP BY 1, 2),
l AS (SELECT * FROM g FULL JOIN h USING (image_id, part))
SELECT c_custkey AS image_id, coalesce(part, 0)::INT AS part, coalesce(boxes, '') AS boxes, coalesce(captions, '') AS captions
FROM customer LEFT JOIN l ON l.image_id = c_custkey""")
def _(t):
    categories = t.spark.createDataFrame(
        [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low")], "category_id string, category string"
    )
    boxes = t.orders.filter("o_custkey % 3 <> 0").select(
        F.col("o_custkey").alias("image_id"), "o_orderkey", F.col("o_orderpriority").alias("category_id")
    )
    captions = t.supplier.select((F.col("s_suppkey") * 7).alias("image_id"), F.col("s_name").alias("caption"))
    images = t.customer.select(F.col("c_custkey").alias("image_id"))
    out = J.join_annotations(images, boxes, captions, categories, ["o_orderkey"], most=10)
    label = lambda e: F.concat_ws(":", e["o_orderkey"].cast("string"), F.coalesce(e["category"], F.lit("?")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "image_id", "part", empty(F.array_join(F.transform("boxes", label), ",")).alias("boxes"),
        empty(F.array_join(F.transform("captions", lambda e: e["caption"]), ",")).alias("captions"),
    )


@check("annotation_gaps", sql="""
SELECT count(*) AS images,
  count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)) AS no_boxes,
  count(*) FILTER (WHERE c_custkey NOT IN (SELECT s_suppkey * 7 FROM supplier)) AS no_captions
FROM (SELECT DISTINCT c_custkey FROM customer)""")
def _(t):
    images = t.customer.select(F.col("c_custkey").alias("image_id"))
    boxes = t.orders.filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("image_id"))
    captions = t.supplier.select((F.col("s_suppkey") * 7).alias("image_id"))
    return J.annotation_gaps(images, boxes=boxes, captions=captions)


@check("url_join_stories", sql=f"""
WITH {PAGES_SQL}
SELECT k.story_id, 'story ' || k.story_id AS label, i::INT AS place, coalesce(article_id, -1) AS article_id,
  coalesce(m.url, '') AS url, coalesce(title, '') AS title
FROM (SELECT DISTINCT story_id FROM m) k CROSS JOIN range(1, 4) r(i)
LEFT JOIN m ON m.story_id = k.story_id AND m.place = i""")
def _(t):
    stories, articles = story_tables(t)
    return J.stories_to_articles(stories, articles, normalize_url, 3).drop("body")


@check("evidence_join", "qa", """
WITH e AS (SELECT qid, qid AS doc_id, 'EntityPages' AS source FROM qa UNION ALL
  SELECT qid, qid * 7 % (SELECT count(*) FROM documents), 'SearchResults' FROM qa)
SELECT qid, e.source, 'doc_' || e.doc_id || '.txt' AS file, d.doc_id AS doc_id, length(text) AS n
FROM e JOIN documents d ON d.doc_id = e.doc_id AND (e.source = 'EntityPages') = (d.doc_id % 2 = 0)""")
def _(t):
    """Even documents lie in the entity folder, odd ones in the search folder."""
    name = lambda i: F.concat(F.lit("doc_"), i.cast("string"), F.lit(".txt"))
    n = t.documents.count()
    entry = lambda i: F.array(F.struct(name(i).alias("Filename"), F.lit("").alias("Title")))
    q = F.struct(
        F.col("qid").cast("string").alias("QuestionId"), F.lit("?").alias("Question"),
        F.struct(F.col("truth").alias("Value"), F.array("truth").alias("Aliases"), F.array("truth").alias("NormalizedAliases")).alias("Answer"),
        entry(F.col("qid")).alias("EntityPages"), entry(F.col("qid") * 7 % n).alias("SearchResults"),
    )
    listed = flatten_evidence_qa(t.qa.select(F.array(q).alias("Data")))
    texts = t.documents.select(
        F.when(F.col("doc_id") % 2 == 0, "EntityPages").otherwise("SearchResults").alias("source"),
        name(F.col("doc_id")).alias("file"), "doc_id", F.length("text").cast("bigint").alias("n"),
    )
    return listed.join(texts, ["source", "file"]).select(
        F.col("qid").cast("bigint").alias("qid"), "source", "file", "doc_id", "n"
    )


@check("side_input_lookup", "qa tokens", """
WITH s AS (SELECT qid, list_distinct(regexp_split_to_array(truth, ' ')) AS words FROM qa)
SELECT qid, count(*) AS tokens, count(*) FILTER (WHERE list_contains(words, token)) AS in_answer
FROM tokens JOIN s ON qid = doc_id GROUP BY 1""")
def _(t):
    sets = t.qa.select("qid", F.explode(F.array_distinct(F.split("truth", " "))).alias("token"))
    counts = t.tokens.groupBy(F.col("doc_id").alias("qid"), "token").agg(F.count("*").alias("n"))
    hit = sets.withColumn("hit", F.lit(True))
    joined = counts.join(t.qa.select("qid"), "qid").join(hit, ["qid", "token"], "left")
    return joined.groupBy("qid").agg(
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("in_answer")
    )


@check("vocab_encode", "tokens", """
WITH v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 99 AS id FROM (
  SELECT token, count(*) AS n FROM tokens GROUP BY 1 HAVING count(*) >= 3))
SELECT doc_id, pos::INT AS pos, coalesce(id, 1) AS id FROM tokens t LEFT JOIN v ON v.token = t.token""")
def _(t):
    often = t.tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n >= 3")
    vocab = with_position(often, [-F.col("n"), "token"], name="id", start=100)
    return J.vocab_encode(t.tokens, vocab.select("token", "id"), 1).select("doc_id", "pos", "id")


@check("predictions_join_truth", "qa", """
SELECT qid, (truth = prediction)::INT AS same FROM qa WHERE qid % 4 <> 0 UNION ALL
SELECT qid, 0 FROM qa WHERE qid % 4 = 0""")
def _(t):
    truth = t.qa.select("qid", "truth")
    predicted = t.qa.filter("qid % 4 <> 0").select("qid", "prediction")
    same = (F.col("truth") == F.col("prediction")).cast("int")
    return truth.join(predicted, "qid", "left").select("qid", F.coalesce(same, F.lit(0)).alias("same"))


@check("predictions_join_answered", "qa", """
SELECT qid, (truth = prediction)::INT AS same FROM qa WHERE qid % 4 <> 0""")
def _(t):
    truth = t.qa.select("qid", "truth")
    predicted = t.qa.filter("qid % 4 <> 0").select("qid", "prediction")
    same = (F.col("truth") == F.col("prediction")).cast("int")
    return truth.join(predicted, "qid").select("qid", same.alias("same"))


@check("retrieval_pairs", sql="""
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank FROM documents)
SELECT a.rank, a.lang, a.doc_id, b.doc_id AS doc_id_en FROM r a JOIN r b ON a.rank = b.rank AND b.lang = 'en' WHERE a.lang <> 'en'""")
def _(t):
    return J.positional_pairs(t.documents.select("lang", "doc_id"), "lang", "en", ["doc_id"])


@check("sweep_cross", "sweep", """
WITH c AS (SELECT p AS cache_policy, s AS sleep_ms FROM range(2, 6) a(p), range(200, 600, 50) b(s)),
n AS (SELECT cache_policy, sleep_ms, count(*) AS epochs FROM sweep GROUP BY 1, 2)
SELECT c.cache_policy::INT AS cache_policy, c.sleep_ms::INT AS sleep_ms, coalesce(epochs, 0) AS epochs
FROM c LEFT JOIN n ON c.cache_policy = n.cache_policy AND c.sleep_ms = n.sleep_ms""")
def _(t):
    """Every configuration of the sweep with the number of epochs measured for it."""
    grid = J.sweep_cross(t.spark, {"cache_policy": [2, 3, 4, 5], "sleep_ms": list(range(200, 600, 50))})
    measured = t.sweep.groupBy("cache_policy", "sleep_ms").agg(F.count("*").alias("epochs"))
    return grid.join(measured, ["cache_policy", "sleep_ms"], "left").fillna(0, ["epochs"])


@check("semi_join_base_classes", sql="""
SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')""")
def _(t):
    base = t.events.filter("event_type IN ('view', 'click')").select("event_type").distinct()
    return t.events.select("event_id", "event_type").join(base, "event_type", "left_semi")


# --- set operations ------------------------------------------------------------------------


@check("union_all", sql="""
SELECT lang, doc_id AS id, text FROM documents UNION ALL SELECT 'bench', item_id, text FROM benchmark""")
def _(t):
    docs = t.documents.select("lang", F.col("doc_id").alias("id"), "text")
    return docs.unionByName(t.benchmark.select(F.lit("bench").alias("lang"), F.col("item_id").alias("id"), "text"))


@check("set_intersection", "pairs", """
SELECT conv_id, turn, len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) AS n FROM pairs""")
def _(t):
    return t.pairs.select("conv_id", "turn", F.size(F.array_intersect(F.split("a", " "), F.split("b", " "))).cast("bigint").alias("n"))


@check("multiset_intersection", "qa", """
WITH w AS (SELECT qid, 1 AS side, unnest(regexp_split_to_array(lower(truth), '\\s+')) AS w FROM qa UNION ALL
  SELECT qid, 2, unnest(regexp_split_to_array(lower(context), '\\s+')) FROM qa),
c AS (SELECT qid, w, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 2) AS b FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT qid, sum(least(a, b))::BIGINT AS common FROM c GROUP BY 1""")
def _(t):
    from feedloom.operators.answers import common_counts

    rows = t.qa.select("qid", split_words(F.lower("truth")).alias("a"), split_words(F.lower("context")).alias("b"))
    return common_counts(rows, ["qid"], "a", "b").select("qid", "common")


for _name in ("set_difference", "set_difference_by_user"):

    @check(_name, "ratings", """
WITH d AS (SELECT DISTINCT user_id, item_id FROM ratings WHERE item_id IN (SELECT p_partkey FROM part)),
c AS (SELECT count(*) AS n, sum(p_partkey * 2654435761 % 4294967291) AS h FROM part)
SELECT user_id, any_value(c.n) - count(*) AS n, (any_value(c.h) - sum(item_id * 2654435761 % 4294967291))::BIGINT AS h FROM d, c GROUP BY 1""")
    def _(t):
        """Per user the number and hash sum of the items not rated, over all ratings; no item is listed for a user."""
        return J.items_not_rated(t.ratings, t.part.select(F.col("p_partkey").alias("item_id")))


@check("distinct_values", sql="SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@check("answer_aliases", "qa", r"""
WITH v AS (SELECT qid, lower(replace(truth, '_', ' ')) AS s FROM qa),
x AS (SELECT qid, unnest([regexp_replace(s, '[!-/:-@\[-`{-~‘’´]', ' ', 'g'),
  regexp_replace(s, '[!-+\-/:-@\[-`{-~‘’´]', ' ', 'g'), regexp_replace(s, '[!-,./:-@\[-`{-~‘’´]', ' ', 'g'),
  regexp_replace(s, '[!-+/:-@\[-`{-~‘’´]', ' ', 'g'), regexp_replace(s, '[‘’´]', ' ', 'g'), 'given ' || qid]) AS s FROM v)
SELECT DISTINCT qid, trim(regexp_replace(s, '\s+', ' ', 'g')) AS alias FROM x""")
def _(t):
    given = F.array(F.concat(F.lit("given "), F.col("qid").cast("string")))
    return t.qa.select("qid", F.explode(answer_aliases(F.array("truth"), given)).alias("alias"))
