"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import chat, decontaminate, exact_dedup, langid, lm, merkle, minhash, neighbours, phrases, piece_lattice, quality, secrets, warc
from feedloom.llm.common import crc_fold
from feedloom.session import fresh_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return keep


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""")
def op3(spark, sf_dir):
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def in_fold(folds: int, fold: int):
    """Whether a document is held out; one without an id is not."""
    return F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False)).alias("held_out")


QUALITY_LIMIT = 0.3


@query("op1_quality")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", in_fold(5, 0), model.score_column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_LIMIT).cast("int"))


@query("op7_language")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", in_fold(4, 2), langid.fit(docs).predict_column(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


@query("op2_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM p
""")
def op2(spark, sf_dir):
    folder = fresh_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.capture_digests(warc.assemble(warc.read_archives(spark, folder)))


@query("op4_minhash")
def op4(spark, sf_dir):
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def _count_of(kind):
    return F.size(F.filter("found", lambda s: s["kind"] == kind))


@query("op5_secret_scan")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))
    base = [r.kind for r in secrets.BASE]
    return docs.select(
        "doc_id",
        *[_count_of(kind).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.joined_spans(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("found")).alias("spans"),
    )


@query("op6_decontaminate")
def op6(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_EXTRA = r"\### Assistant: </turn> ok"


@query("op8_chat_format")
def op8(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(i AS BIGINT) AS turn, r AS role, t AS text "
                        "FROM VALUES (0, 'user'), (1, 'assistant') v(i, r), (SELECT :t AS t)", {"t": OP8_EXTRA})
    out = chat.format_chats(given.unionByName(planted))
    masked = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), F.transform(
        chat.loss_spans(F.col("formatted")),
        lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))).alias("learned"))
    return masked.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(F.array_join("learned", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_lattice.encode_checked(docs, piece_lattice.Pieces.load())
    return coded.select("doc_id", F.size("encoded.ids").cast("long").alias("n_pieces"), F.col("encoded.ids").alias("piece_ids"), F.col("encoded.lossless").alias("lossless"))


@query("op10_lm_score")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, lm.fit(docs))
    return scored.select("doc_id", in_fold(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_neighbours")
def op11(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def _leaf_sql(n_chars: str = "n_chars") -> str:
    texts = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in texts) + ")"


#: crc32 of the decimal id, eight steps for each of its characters.
_CRC_SQL = """xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
    lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""


@query("op12_merkle", f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf_sql()} AS leaf, CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql()} END AS given FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), t(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM p
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2
), tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top FROM t WHERE n = 1
), u(lvl, pos, h, n) AS (
  SELECT 0, top, subroot, count(*) OVER () FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2
), way AS (
  SELECT rid, t.lvl AS lvl, t.pos AS own, s.pos AS pos, s.h AS h FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos >> t.lvl AND t.n > 1
  LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM t.lang AND s.lvl = t.lvl AND s.pos = xor(t.pos, 1)
  UNION ALL
  SELECT rid, 1000 + u.lvl, u.pos, s.pos, s.h FROM p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.lang JOIN u ON u.pos = top >> u.lvl AND u.n > 1
  LEFT JOIN u s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1)
), step AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS k FROM way
), f(rid, k, now) AS (
  SELECT rid, 1, given FROM p
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(CASE WHEN step.pos < own THEN h ELSE '' END || now || CASE WHEN step.pos > own THEN h ELSE '' END) FROM f JOIN step ON step.rid = f.rid AND step.k = f.k
), last AS (SELECT rid, arg_max(now, k) AS folded_root FROM f GROUP BY rid
), proof AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256 FROM way GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.lang JOIN last USING (rid) LEFT JOIN proof USING (rid), (SELECT h AS root FROM u WHERE n = 1)
""")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed = F.when(crc_fold("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = merkle.leaf_digest(*[changed if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    found = merkle.manifest(docs, carry=tampered)
    siblings = F.flatten(F.transform("proof", lambda step: step["others"]))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        merkle.folded(F.col("carried"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_phrases", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS words FROM p
), g AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), f AS (SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k, count(*) AS c FROM g, (VALUES (1), (2), (3)) s(k) WHERE i + k - 1 <= len(words) GROUP BY ALL
), n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (SELECT lang, phrase, string_split(phrase, ' ') AS words, k, c AS a FROM f WHERE k > 1 AND c >= 10
), cut AS (SELECT lang, phrase, words, k, a, unnest(range(1, k)) AS m FROM cand
), s AS (
  SELECT cut.*, l.c AS l, r.c AS r, ((1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c))::BIGINT AS score FROM cut
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(words[1:m], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(words[m + 1:cut.k], ' ')
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1
), held AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN cand d ON c.lang = d.lang AND c.k = 2 AND d.k = 3 AND (c.words = d.words[1:2] OR c.words = d.words[2:3]) AND 100 * d.a >= 50 * c.a
), kept AS (SELECT * FROM best ANTI JOIN held USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""")
def op13(spark, sf_dir):
    found = phrases.collocations(table(spark, sf_dir, "documents"))
    return found.withColumn("rank", F.col("rank").cast("long"))
