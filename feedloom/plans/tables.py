"""The given tables and the fixture views the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.hashing import MODULUS, mix


def h_sql(a: str, b: str = "0", seed: int = 0) -> str:
    """The arithmetic hash as DuckDB SQL over BIGINT."""
    m = MODULUS
    h1 = f"((({a})::BIGINT % {m}) * 48271 + (({b})::BIGINT % {m}) * 69621 + {seed * 16807 + 12345}) % {m}"
    return f"((((({h1}) * ({h1})) % {m}) * 48271 + ({h1}) + 11) % {m})"


class Tables:
    """Lazy access to the tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _ratings(t: Tables) -> DataFrame:
    """One row per (user, item): the earliest order line."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    heads = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("user_id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"),
    )
    return (
        lines.join(heads, "l_orderkey")
        .groupBy("user_id", F.col("l_partkey").alias("item_id"))
        .agg(F.min(F.struct("ts", "l_quantity")).alias("r"))
        .select("user_id", "item_id", F.col("r.l_quantity").alias("rating"), "r.ts")
    )


def _items(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("titles"),
        F.replace("p_name", F.lit(" "), F.lit("|")).alias("genres"),
    )


def _trace(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(
        *[F.lit(x) for x in (
            "signup", "starting_worker_count", "click", "scale_up", "error", "scale_down",
            "view", "execution_mode_change", "purchase", "end_training")]
    )[F.col("event_type")]
    mode = F.element_at(F.array(F.lit("PROFILE"), F.lit("PUT"), F.lit("GET")), k % 3 + 1)
    return t.events.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time"),
        F.concat(F.lit("job_"), (F.col("user_id") % 2 + 1).cast("string")).alias("job_name"),
        kind.alias("event_type"),
        F.when(kind == "execution_mode_change", mode)
        .otherwise((k % 8).cast("string"))
        .alias("additional"),
    )


def _sweep(t: Tables) -> DataFrame:
    from feedloom.operators.ordered import with_position

    base = t.events.select(
        (2 + F.col("user_id") % 4).alias("cache_policy"),
        (200 + 50 * (F.col("event_id") % 8)).alias("sleep_ms"),
        "event_id",
        F.col("value").alias("seconds"),
    )
    return with_position(base, ["event_id"], ["cache_policy", "sleep_ms"], "epoch")


def _tokens(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.documents.select("doc_id", F.posexplode(words).alias("pos", "token"))


def _sentences(t: Tables) -> DataFrame:
    from feedloom.sources.readers import sentence_rows

    return sentence_rows(t.documents, "doc_id", "text")


def _pairs(t: Tables) -> DataFrame:
    """A user turn and the assistant turn that follows it (turn numbers are consecutive)."""
    c = t.conversations
    a = c.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("a"), (F.col("turn") % 2).alias("label")
    )
    b = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")
    )
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "a", "b", "label")


def _qa(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    d = t.documents.select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 9)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    return d.select(
        F.col("doc_id").alias("qid"),
        F.col("text").alias("context"),
        part(5, 4).alias("truth"),
        F.when(F.col("doc_id") % 3 == 0, part(5, 3))
        .when(F.col("doc_id") % 3 == 1, part(6, 4))
        .otherwise("")
        .alias("prediction"),
        (F.col("doc_id") % 5 != 0).alias("has_answer"),
        (mix("doc_id", 0, 7) / F.lit(float(MODULUS))).alias("na_prob"),
    )


def _boxes(t: Tables) -> DataFrame:
    """Order lines as boxes, sixteen orders to an image; odd lines are truths.

    Box ids must be unique within an image, so repeated order lines count once.
    """
    ymin, xmin = (F.col("l_partkey") * 7) % 500, (F.col("l_suppkey") * 13) % 500
    box_id = (
        ((F.col("l_orderkey") % 16) * 1000000000 + F.col("l_partkey")) * 10000000
        + F.col("l_suppkey")
    ) * 10 + F.col("l_linenumber")
    image = F.floor(F.col("l_orderkey") / 16).cast("bigint")
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    one = F.min(F.struct("l_quantity", "l_discount")).alias("v")
    lines = t.lineitem.groupBy(*key).agg(one).select(*key, "v.*")
    return lines.select(
        image.alias("image_id"),
        box_id.alias("box_id"),
        ymin.cast("double").alias("ymin"),
        xmin.cast("double").alias("xmin"),
        (ymin + 1 + F.col("l_quantity")).alias("ymax"),
        (xmin + 1 + F.col("l_partkey") % 60).cast("double").alias("xmax"),
        (F.col("l_suppkey") % 10).alias("class"),
        (F.col("l_discount") + mix(box_id, image, 3) / F.lit(1e12)).alias("score"),
        (F.col("l_linenumber") % 2 == 1).alias("is_truth"),
    )


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
        "label",
        ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 10)
        .cast("int").alias("predicted"),
    )


VIEWS = {
    "ratings": _ratings,
    "items": _items,
    "trace": _trace,
    "sweep": _sweep,
    "tokens": _tokens,
    "sentences": _sentences,
    "pairs": _pairs,
    "qa": _qa,
    "boxes": _boxes,
    "vectors": _vectors,
}

_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_BOX_ID = "(((l_orderkey % 16) * 1000000000 + l_partkey) * 10000000 + l_suppkey) * 10 + l_linenumber"

#: The same views as DuckDB SQL.
VIEW_SQL = {
    "ratings": """ratings AS (
  SELECT user_id, item_id, r.q AS rating, r.ts AS ts FROM (
    SELECT o_custkey AS user_id, l_partkey AS item_id,
           min({'ts': epoch_us(o_orderdate) // 1000000, 'q': l_quantity}) AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))""",
    "items": """items AS (
  SELECT p_partkey AS item_id, p_name AS titles, replace(p_name, ' ', '|') AS genres FROM part)""",
    "trace": """trace AS (
  SELECT event_id, epoch_us(ts) AS time, 'job_' || (user_id % 2 + 1) AS job_name,
    CASE event_type WHEN 'signup' THEN 'starting_worker_count' WHEN 'click' THEN 'scale_up'
      WHEN 'error' THEN 'scale_down' WHEN 'view' THEN 'execution_mode_change'
      ELSE 'end_training' END AS event_type,
    CASE WHEN event_type = 'view' THEN ['PROFILE', 'PUT', 'GET'][(props->>'$.k')::INT % 3 + 1]
      ELSE ((props->>'$.k')::INT % 8)::VARCHAR END AS additional
  FROM events)""",
    "sweep": """sweep AS (
  SELECT *, row_number() OVER (PARTITION BY cache_policy, sleep_ms ORDER BY event_id) - 1 AS epoch
  FROM (SELECT 2 + user_id % 4 AS cache_policy, 200 + 50 * (event_id % 8) AS sleep_ms, event_id,
               value AS seconds FROM events))""",
    "tokens": f"""tokens AS (
  SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token
  FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents))""",
    "sentences": """sentences AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS sent_id,
         trim(line) AS sentence
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE trim(line) <> '')""",
    "pairs": """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS a, b.text AS b, a.turn % 2 AS label
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')""",
    "qa": f"""qa AS (
  SELECT doc_id AS qid, text AS context, array_to_string(w[5:8], ' ') AS truth,
    CASE doc_id % 3 WHEN 0 THEN array_to_string(w[5:7], ' ')
      WHEN 1 THEN array_to_string(w[6:9], ' ') ELSE '' END AS prediction,
    doc_id % 5 <> 0 AS has_answer, {h_sql('doc_id', '0', 7)} / 2147483647.0::DOUBLE AS na_prob
  FROM (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) >= 9)""",
    "boxes": f"""boxes AS (
  SELECT image_id, box_id, ymin, xmin, ymax, xmax, class,
         l_discount + {h_sql('box_id', 'image_id', 3)} / 1e12::DOUBLE AS score, is_truth
  FROM (SELECT l_orderkey // 16 AS image_id, {_BOX_ID} AS box_id,
    ((l_partkey * 7) % 500)::DOUBLE AS ymin, ((l_suppkey * 13) % 500)::DOUBLE AS xmin,
    ((l_partkey * 7) % 500 + 1 + l_quantity)::DOUBLE AS ymax,
    ((l_suppkey * 13) % 500 + 1 + l_partkey % 60)::DOUBLE AS xmax,
    l_suppkey % 10 AS class, l_discount, l_linenumber % 2 = 1 AS is_truth FROM (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, v.q AS l_quantity, v.d AS l_discount FROM (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, min({{'q': l_quantity, 'd': l_discount}}) AS v
        FROM lineitem GROUP BY 1, 2, 3, 4))))""",
    "vectors": """vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label,
    ((label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 10)::INT AS predicted FROM embeddings)""",
}
