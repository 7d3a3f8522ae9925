"""Registered queries: vocabularies, masking, streams and task features."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.arrays import let, offsets_before, pad_or_clip
from feedloom.functions.text import answer_aliases, normalize_url, split_punct, split_words
from feedloom.operators import corpus as C
from feedloom.operators import vocabulary as V
from feedloom.operators.dataset import split_by_time
from feedloom.operators.joins import stories_to_articles
from feedloom.operators.ordered import with_position
from feedloom.plans.catalog import check
from feedloom.plans.dataset_queries import WORDS
from feedloom.plans.joins_queries import PAGES_SQL, story_tables
from feedloom.plans.tables import h_sql
from feedloom.session import fresh_folder, spread, staged

ROOM = 62  # pieces between the two markers of a sequence


def word_pieces(word):
    """A word in chunks of four characters, continuations marked."""
    chunks = F.regexp_extract_all(word, F.lit("(?s).{1,4}"), F.lit(0))
    return F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(F.lit("##"), c)).otherwise(c))


def sequences(t):
    """Every document as consecutive sequences of [CLS] + 62 pieces + [SEP]."""
    pieces = F.flatten(F.transform(split_words("text"), word_pieces))
    count = lambda x: F.ceil(F.size(x) / ROOM).cast("int")
    cut = lambda x: F.transform(F.sequence(F.lit(0), count(x) - 1), lambda k: F.slice(x, k * ROOM + 1, F.lit(ROOM)))
    rows = spread(t.documents).select("doc_id", F.posexplode(F.filter(let(pieces, cut), lambda c: F.size(c) > 0)).alias("seg", "c"))
    tokens = F.concat(F.array(F.lit(C.CLS)), "c", F.array(F.lit(C.SEP)))
    return rows.select("doc_id", "seg", tokens.alias("tokens"))


def row_key():
    return F.col("doc_id") * 10000 + F.col("seg")


SEQ_SQL = f"""pc AS (SELECT doc_id, flatten(list_transform({WORDS}, lambda w: list_transform(range((length(w) + 3) // 4),
    lambda i: (CASE WHEN i > 0 THEN '##' ELSE '' END) || substr(w, (i * 4 + 1)::INT, 4)))) AS x FROM documents),
sq AS (SELECT doc_id, k::INT AS seg, list_concat(['[CLS]'], x[(k * {ROOM} + 1)::INT:((k + 1) * {ROOM})::INT], ['[SEP]']) AS tokens
  FROM (SELECT *, unnest(range((len(x) + {ROOM - 1}) // {ROOM})) AS k FROM pc))"""


def text_of(column):
    return F.array_join(F.col(column).cast("array<string>"), ",")


# --- vocabularies --------------------------------------------------------------------------


def toy_vocab(t):
    """Frequent words and all prefixes of two letters, plain and as continuations."""
    counts = staged(t.tokens.groupBy("token").agg(F.count("*").alias("n")))
    often = counts.filter("n >= 3").select("token")
    parts = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("p"))
    parts = parts.distinct()
    marked = parts.select(F.concat(F.lit("##"), "p").alias("token"))
    single = parts.select(F.col("p").alias("token"))
    return counts.select(F.col("token").alias("word")), staged(often.union(marked).union(single).distinct())


WORDPIECE_SQL = """ct AS (SELECT token, count(*) AS n FROM tokens GROUP BY 1),
pa AS (SELECT DISTINCT unnest(list_transform(range(1, length(token) + 1), lambda i: substr(token, i::INT, 2))) AS p FROM ct),
vc AS (SELECT token FROM ct WHERE n >= 3 UNION SELECT '##' || p FROM pa UNION SELECT p FROM pa),
st AS (SELECT token AS word, unnest(range(1, length(token) + 1))::INT AS loc FROM ct WHERE length(token) <= 400),
sb AS (SELECT word, loc, unnest(range(1, least(length(word) - loc + 2, (SELECT max(length(token)) FROM vc) + 1)))::INT AS n FROM st),
be AS (SELECT word, loc, max(n)::INT AS n FROM sb SEMI JOIN vc ON vc.token = (CASE WHEN loc > 1 THEN '##' ELSE '' END) || substr(word, loc, n) GROUP BY 1, 2),
wk AS (SELECT word, 1 AS pos, ''::VARCHAR AS pieces FROM (SELECT DISTINCT word FROM st) UNION ALL
  SELECT wk.word, pos + n, pieces || ' ' || (CASE WHEN pos > 1 THEN '##' ELSE '' END) || substr(wk.word, pos, n) FROM wk JOIN be ON be.word = wk.word AND be.loc = wk.pos)"""


@check("wordpiece", "tokens", f"""WITH RECURSIVE {WORDPIECE_SQL}
SELECT word, substr(pieces, 2) AS pieces FROM wk WHERE pos = length(word) + 1
UNION ALL SELECT token, '[UNK]' FROM ct WHERE length(token) > 400""")
def _(t):
    words, vocab = toy_vocab(t)
    return V.wordpiece(words, vocab).select("word", F.array_join("pieces", " ").alias("pieces"))


@check("wordpiece_joined", "tokens", f"""WITH RECURSIVE {WORDPIECE_SQL}
SELECT word, substr(pieces, 2) AS pieces FROM wk WHERE pos = length(word) + 1
UNION ALL SELECT token, '[UNK]' FROM ct WHERE length(token) > 400""")
def _(t):
    """The way taken when the vocabulary is too large to ship."""
    words, vocab = toy_vocab(t)
    return V.wordpiece(words, vocab, shipped=0).select("word", F.array_join("pieces", " ").alias("pieces"))


ESCAPED_SQL = r"""r AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS x FROM documents),
tk AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(x, lambda t, i: t <> ' ' OR i = 1 OR i = len(x))) AS token FROM r) GROUP BY 1),
ew AS (SELECT replace(replace(replace(token, '\', '\\'), '_', '\u'), chr(10), '\10;') || '_' AS word, n FROM tk)"""


@check("subtoken_counts", sql=f"""
WITH {ESCAPED_SQL}, st AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS loc FROM ew),
sb AS (SELECT substr(word, loc, len) AS token, n FROM (SELECT word, n, loc, unnest(range(1, length(word) - loc + 2))::INT AS len FROM st)),
c AS (SELECT token, sum(n)::BIGINT AS n FROM sb GROUP BY 1)
SELECT length(token)::INT AS len, count(*) AS kinds, sum(n)::BIGINT AS total, max(n) AS most FROM c GROUP BY 1""")
def _(t):
    """Counts of the first round, where every character is a piece."""
    words, chars = V.escaped_counts(t.documents, "text")
    letters = t.spark.createDataFrame([(c,) for c in chars], "token string")
    cut = V.segment_words(words, letters).join(words, "word")
    return V.subtoken_counts(cut).groupBy(F.length("token").alias("len")).agg(
        F.count("*").alias("kinds"), F.sum("n").alias("total"), F.max("n").alias("most"))


def vocab_of(t, least=100):
    return V.build_from(t.spark, t.documents, "text", least)


@check("subword_vocab")
def _(t):
    return vocab_of(t)[0]


@check("subword_vocab_target")
def _(t):
    words, chars = V.escaped_counts(t.documents, "text")
    vocab, least = V.subword_vocab_target(words, chars, 1000, 250, iterations=2)
    return vocab.withColumn("least", F.lit(least))


@check("subword_encode", sql="SELECT doc_id, text FROM documents")
def _(t):
    """Encoded and decoded again, every document is what it was."""
    vocab, chars = vocab_of(t)
    coded = V.subword_encode(t.documents.select("doc_id", "text"), ["doc_id"], "text", vocab, chars)
    return V.subword_decode(staged(coded), ["doc_id"], "ids", vocab)


@check("parallel_corpus", "pairs", """
WITH l AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line, conv_id FROM pairs)
SELECT (line % 4)::INT AS shard, count(*) AS n, sum(conv_id)::BIGINT AS convs, sum(line)::BIGINT AS lines FROM l GROUP BY 1""")
def _(t):
    pairs = staged(t.pairs)
    vocab, chars = V.build_from(t.spark, pairs.select(F.concat("a", F.lit("\n"), "b").alias("text")), "text", 20)
    left = pairs.select("conv_id", F.col("turn").alias("t"), "a")
    right = pairs.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), "b")
    path = fresh_folder(t.spark, "parallel")
    V.parallel_corpus(left, right, ["conv_id", "t"], ["c2", "t2"], "conv_id", ("a", "b"), vocab, chars, path, 4, 3)
    back = t.spark.read.parquet(path).filter((F.size("a_ids") > 0) & (F.size("b_ids") > 0))
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.sum("conv_id").alias("convs"), F.sum("line").alias("lines"))


# --- masking -------------------------------------------------------------------------------


def sentence_arrays(t):
    lines = F.filter(F.transform(F.split("text", "\n"), split_words), lambda w: F.size(w) > 0)
    return t.documents.select("doc_id", lines.alias("s"))


@check("sentence_pairs")
def _(t):
    out = C.sentence_pairs(sentence_arrays(t), "doc_id", "s", 128, 51)
    return out.select("doc_id", "copy", "chunk", "is_random", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


MASK_SQL = SEQ_SQL + f""",
ps AS (SELECT doc_id, seg, len(tokens) AS n, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM sq),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY {h_sql('doc_id * 10000 + seg', 'pos', 61)}, pos) AS r FROM ps WHERE token NOT IN ('[CLS]', '[SEP]')),
mk AS (SELECT * FROM rk WHERE r <= least(20, greatest(1, CASE WHEN (n * 15) % 100 = 50 THEN (n * 15 // 100) + (n * 15 // 100) % 2 ELSE round(n * 0.15) END)))"""


def masked_positions(t):
    rows = sequences(t)
    count = C.mask_count(F.size("tokens"), 0.15, 20)
    return rows.withColumn("positions", C.single_token_positions("tokens", count, row_key(), 61))


@check("masked_lm", "tokens", f"""
WITH {MASK_SQL}, v AS (SELECT token AS word, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT token FROM tokens GROUP BY 1 HAVING count(*) >= 5)),
u AS (SELECT *, {h_sql('doc_id * 10000 + seg', 'pos', 62)} / 2147483647.0::DOUBLE AS u, {h_sql('doc_id * 10000 + seg', 'pos', 63)} % (SELECT count(*) FROM v) AS id FROM mk)
SELECT doc_id, seg, pos::INT AS pos, u.token AS label, CASE WHEN u < 0.8 THEN '[MASK]' WHEN u < 0.9 THEN u.token ELSE v.word END AS token
FROM u LEFT JOIN v ON v.id = u.id""")
def _(t):
    often = t.tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n >= 5").select(F.col("token").alias("word"))
    vocab = staged(with_position(staged(often), ["word"], name="id"))
    return C.masked_lm(masked_positions(t), ["doc_id", "seg"], "tokens", "positions", vocab, vocab.count(), row_key(), 62)


@check("masked_lm_ngrams")
def _(t):
    rows = sequences(t).withColumn("grams", C.gram_spans("tokens"))
    count = C.mask_count(F.size("tokens"), 0.15, 20)
    out = rows.select("doc_id", "seg", "tokens", C.ngram_positions("grams", count, 3, row_key(), 71).alias("p"))
    return out.select("doc_id", "seg", F.size("p").alias("n"), text_of("p").alias("positions"))


def _grams_sql(most: int) -> str:
    """Runs of up to ``most`` words taken by recursion over their random order, and what each becomes."""
    key = "doc_id * 10000 + seg"
    return SEQ_SQL + f""",
ps AS (SELECT doc_id, seg, len(tokens) AS n, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM sq),
m AS (SELECT *, lag(token) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS p FROM ps),
bg AS (SELECT * FROM m WHERE token IN ('[CLS]', '[SEP]') OR NOT starts_with(token, '##') OR p IS NULL OR p IN ('[CLS]', '[SEP]')),
e AS (SELECT *, lead(pos, 1, n) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS nxt FROM bg),
w AS (SELECT doc_id, seg, pos AS b, nxt AS e, n, row_number() OVER (PARTITION BY doc_id, seg ORDER BY pos) AS k, sum(nxt - pos) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS held
  FROM e WHERE token NOT IN ('[CLS]', '[SEP]')),
rn AS (SELECT x.doc_id, x.seg, x.b, y.e, x.n, -ln(1 - {h_sql('x.doc_id * 10000 + x.seg', f'x.b * {most + 1} + y.k - x.k + 1', 71)} / 2147483647.0::DOUBLE) * (y.k - x.k + 1) AS wh
  FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.seg = y.seg AND y.k BETWEEN x.k AND x.k + {most - 1} AND y.held - x.held + x.e - x.b = y.e - x.b),
o AS (SELECT doc_id, seg, b, e, row_number() OVER (PARTITION BY doc_id, seg ORDER BY wh, b, e) AS r,
  least(20, greatest(1, CASE WHEN (n * 15) % 100 = 50 THEN (n * 15 // 100) + (n * 15 // 100) % 2 ELSE round(n * 0.15) END)) AS most FROM rn),
rec(doc_id, seg, r, b, e, taken, ok) AS (
  SELECT doc_id, seg, r, b, e, CASE WHEN e - b <= most THEN range(b, e) ELSE []::BIGINT[] END, e - b <= most FROM o WHERE r = 1
  UNION ALL
  SELECT o.doc_id, o.seg, o.r, o.b, o.e, CASE WHEN len(taken) + o.e - o.b <= most AND len(list_intersect(taken, range(o.b, o.e))) = 0 THEN list_concat(taken, range(o.b, o.e)) ELSE taken END,
    len(taken) + o.e - o.b <= most AND len(list_intersect(taken, range(o.b, o.e))) = 0
  FROM rec JOIN o ON o.doc_id = rec.doc_id AND o.seg = rec.seg AND o.r = rec.r + 1 WHERE len(taken) < most),
v AS (SELECT token AS word, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT token FROM tokens GROUP BY 1 HAVING count(*) >= 5)),
g AS (SELECT doc_id, seg, b, unnest(range(b, e)) AS pos, {h_sql(key, 'b', 75)} / 2147483647.0::DOUBLE AS u FROM rec WHERE ok),
dr AS (SELECT g.*, {h_sql(key, 'pos', 76)} % (SELECT count(*) FROM v) AS id FROM g),
ml AS (SELECT dr.doc_id, dr.seg, b, dr.pos, ps.token AS label, CASE WHEN u < 0.8 THEN '[MASK]' WHEN u < 0.9 THEN ps.token ELSE v.word END AS token
  FROM dr JOIN ps ON ps.doc_id = dr.doc_id AND ps.seg = dr.seg AND ps.pos = dr.pos LEFT JOIN v ON v.id = dr.id)"""


def _masked_grams(t, most):
    often = t.tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n >= 5").select(F.col("token").alias("word"))
    vocab = staged(with_position(staged(often), ["word"], name="id"))
    count = C.mask_count(F.size("tokens"), 0.15, 20)
    words = sequences(t).withColumn("words", C.gram_spans("tokens"))
    rows = staged(words.select("doc_id", "seg", "tokens", C.ngram_spans("words", count, most, row_key(), 71).alias("grams")))
    return rows, C.masked_grams(rows, ["doc_id", "seg"], "tokens", "grams", vocab, vocab.count(), row_key(), 75)


_ML_SQL = 'SELECT doc_id, seg, b::INT AS begin, pos::INT AS pos, label, token FROM ml'


@check("masked_lm_whole_words", "tokens", f"WITH RECURSIVE {_grams_sql(1)} {_ML_SQL}")
def _(t):
    return _masked_grams(t, 1)[1]


@check("masked_lm_grams", "tokens", f"WITH RECURSIVE {_grams_sql(3)} {_ML_SQL}")
def _(t):
    return _masked_grams(t, 3)[1]


@check("masked_lm_sequences", "tokens", f"""
WITH RECURSIVE {_grams_sql(3)}, f AS (SELECT doc_id, seg, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, string_agg(label, ' ' ORDER BY pos) AS labels FROM ml GROUP BY 1, 2),
z AS (SELECT ps.doc_id, ps.seg, string_agg(coalesce(ml.token, ps.token), ' ' ORDER BY ps.pos) AS tokens FROM ps LEFT JOIN ml ON ml.doc_id = ps.doc_id AND ml.seg = ps.seg AND ml.pos = ps.pos GROUP BY 1, 2)
SELECT doc_id, seg, tokens, coalesce(positions, '') AS positions, coalesce(labels, '') AS labels FROM z LEFT JOIN f USING (doc_id, seg)""")
def _(t):
    rows, masked = _masked_grams(t, 3)
    out = C.masked_sequences(rows, ["doc_id", "seg"], "tokens", masked)
    return out.select("doc_id", "seg", F.array_join("tokens", " ").alias("tokens"), text_of("positions").alias("positions"), F.array_join("labels", " ").alias("labels"))


@check("wordpieces_to_grams", sql=f"""
WITH {SEQ_SQL}, ps AS (SELECT doc_id, seg, len(tokens) AS n, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM sq),
m AS (SELECT *, lag(token) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS p FROM ps),
b AS (SELECT * FROM m WHERE token IN ('[CLS]', '[SEP]') OR NOT starts_with(token, '##') OR p IS NULL OR p IN ('[CLS]', '[SEP]')),
e AS (SELECT *, lead(pos, 1, n) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS nxt FROM b)
SELECT doc_id, seg, pos::INT AS begin, nxt::INT AS "end" FROM e WHERE token NOT IN ('[CLS]', '[SEP]')""")
def _(t):
    return sequences(t).select("doc_id", "seg", F.explode(C.gram_spans("tokens")).alias("g")).select("doc_id", "seg", "g.*")


STREAM_SQL = f"""ln AS (SELECT doc_id, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
wd AS (SELECT doc_id, no, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS w FROM ln),
sn AS (SELECT doc_id, w, row_number() OVER (ORDER BY {h_sql('doc_id', '0', 81)}, doc_id, no) - 1 AS sent FROM wd WHERE len(w) > 0),
tk AS (SELECT (sent % 2)::INT AS parity, token, row_number() OVER (ORDER BY sent, i) - 1 AS o FROM (SELECT sent, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM sn)),
sz AS (SELECT count(*) // 8 AS steps FROM tk),
sm AS (SELECT o // steps AS row, o % steps AS col, token, parity FROM tk, sz WHERE o // steps < 8)"""


@check("segment_stream", sql=f'WITH {STREAM_SQL} SELECT row, col, token, parity FROM sm')
def _(t):
    return C.segment_stream(sentence_arrays(t), "doc_id", "s", 8, 81)[0]


@check("bidirectional_stream", sql=f"""
WITH {STREAM_SQL} SELECT row, col, token FROM sm UNION ALL SELECT row + 8, steps - 1 - col, token FROM sm, sz""")
def _(t):
    stream, steps = C.segment_stream(sentence_arrays(t), "doc_id", "s", 8, 81)
    return C.bidirectional_stream(stream, steps, 8).select("row", "col", "token")


@check("segments_ab")
def _(t):
    stream, steps = C.segment_pieces(sentence_arrays(t), "doc_id", "s", 8, 81)
    return C.segments_ab(staged(stream), steps, 128, 64, 91)


@check("segment_tokens")
def _(t):
    stream, steps = C.segment_pieces(sentence_arrays(t), "doc_id", "s", 8, 81)
    stream = staged(stream)
    out = C.segment_tokens(C.segments_ab(stream, steps, 128, 64, 91), stream, 64)
    return out.select("row", "data_index", "label", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@check("online_masks", sql=f"""
WITH {MASK_SQL.replace('mk AS', 'old AS')}, mk AS (SELECT * FROM rk WHERE r <= 12)
SELECT doc_id, seg, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM mk GROUP BY 1, 2""")
def _(t):
    out = sequences(t).withColumn("p", C.single_token_positions("tokens", F.lit(12), row_key(), 61))
    return out.select("doc_id", "seg", text_of("p").alias("positions"))


@check("online_masks_words", sql=f"""
WITH {SEQ_SQL}, ps AS (SELECT doc_id, seg, len(tokens) AS n, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM sq),
m AS (SELECT *, lag(token) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS p FROM ps),
b AS (SELECT * FROM m WHERE token IN ('[CLS]', '[SEP]') OR NOT starts_with(token, '##') OR p IS NULL OR p IN ('[CLS]', '[SEP]')),
e AS (SELECT *, lead(pos, 1, n) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS nxt FROM b),
w AS (SELECT doc_id, seg, pos, nxt, row_number() OVER (PARTITION BY doc_id, seg ORDER BY {h_sql('doc_id * 10000 + seg', 'pos', 72)}, pos) AS r FROM e WHERE token NOT IN ('[CLS]', '[SEP]')),
x AS (SELECT doc_id, seg, i, row_number() OVER (PARTITION BY doc_id, seg ORDER BY r, i) AS k FROM (SELECT doc_id, seg, r, unnest(range(pos, nxt)) AS i FROM w WHERE r <= 12))
SELECT doc_id, seg, array_to_string(list(i ORDER BY i), ',') AS positions FROM x WHERE k <= 12 GROUP BY 1, 2""")
def _(t):
    out = sequences(t).withColumn("p", C.whole_word_mask("tokens", 12, row_key(), 72))
    return out.select("doc_id", "seg", text_of("p").alias("positions"))


@check("online_masks_spans")
def _(t):
    out = sequences(t).select("doc_id", "seg", C.token_span_mask("tokens", 12, 1, 5, row_key(), 73).alias("p"),
                              C.word_span_mask("tokens", 12, 1, 5, row_key(), 75).alias("w"))
    return out.select("doc_id", "seg", text_of("p").alias("token_spans"), text_of("w").alias("word_spans"))


@check("factorization_order", sql=f"""
WITH {SEQ_SQL}, k AS (SELECT doc_id, seg, list_concat(tokens, list_transform(range(64 - len(tokens)), lambda z: '[PAD]')) AS tokens FROM sq),
o AS (SELECT doc_id, seg, list(i ORDER BY {h_sql('doc_id * 10000 + seg', 'i', 77)}, i) AS sg FROM k, range(16) r(i) GROUP BY 1, 2),
p AS (SELECT k.doc_id, k.seg, j, (j // 16) * 16 + sg[(j % 16 + 1)::INT] AS ord, tokens[(j + 1)::INT] NOT IN ('[CLS]', '[SEP]', '[PAD]') AND j % 3 <> 0 AS pred
  FROM k JOIN o ON o.doc_id = k.doc_id AND o.seg = k.seg, range(64) r(j)),
f AS (SELECT *, CASE WHEN pred THEN ord ELSE -2 END AS t, CASE WHEN pred THEN ord ELSE -1 END AS own FROM p)
SELECT a.doc_id, a.seg, a.j::INT AS j, any_value(a.ord)::INT AS ord, count(*) FILTER (WHERE a.own > b.t) AS sees
FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.seg = b.seg GROUP BY 1, 2, 3""")
def _(t):
    rows = sequences(t).withColumn("tokens", pad_or_clip("tokens", F.lit(64), F.lit("[PAD]")))
    predicted = F.transform("tokens", lambda x, i: ~x.isin(C.CLS, C.SEP, "[PAD]") & (i % 3 != 0))
    rows = rows.select("doc_id", "seg", C.factorization_order(64, 16, row_key(), 77).alias("o"), predicted.alias("p"))
    rows = rows.select("doc_id", "seg", "o", C.attention_mask(F.col("o"), F.col("p")).alias("m"))
    rows = rows.select("doc_id", "seg", F.posexplode(F.arrays_zip("o", "m")).alias("j", "e"))
    sees = F.size(F.array_remove("e.m", 0)).cast("bigint")
    return rows.select("doc_id", "seg", "j", F.col("e.o").alias("ord"), sees.alias("sees"))


# --- task features -------------------------------------------------------------------------


@check("classifier_examples", sql="""
SELECT 'train-' || doc_id AS guid, text AS text_a, '' AS text_b, quality::VARCHAR AS label, 1.0::DOUBLE AS weight
FROM documents JOIN labels USING (doc_id) WHERE quality <> -1""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id")
    guid = F.concat(F.lit("train-"), F.col("doc_id").cast("string"))
    return C.classifier_examples(rows, guid, "text", label="quality", skip_label=-1)


@check("word_marker_examples", "pairs", """
WITH s AS (SELECT conv_id, turn, string_split(a, ' ') AS a, string_split(b, ' ') AS b, [string_split(b, ' ')[1]] AS w FROM pairs),
l AS (SELECT *, CASE WHEN len(a) + len(b) > 59 THEN least(len(a), greatest(59 - len(b), 30)) ELSE len(a) END AS n,
  CASE WHEN len(a) + len(b) > 59 THEN least(len(b), greatest(59 - len(a), 29)) ELSE len(b) END AS m FROM s)
SELECT conv_id, turn, '[CLS] ' || array_to_string(a[1:n], ' ') || ' [SEP] ' || array_to_string(b[1:m], ' ') || ' [SEP] ' || w[1] || ' [SEP]' || repeat(' [PAD]', (59 - n - m)::INT) AS tokens,
  repeat('0', (n + 2)::INT) || repeat('1', (m + 1)::INT) || '22' || repeat('0', (59 - n - m)::INT) AS type_ids FROM l""")
def _(t):
    b = F.split("b", " ")
    out = t.pairs.select("conv_id", "turn", C.word_marker_features(F.split("a", " "), b, F.slice(b, 1, 1), 64).alias("f"))
    return out.select("conv_id", "turn", F.array_join("f.tokens", " ").alias("tokens"), F.array_join(F.col("f.type_ids").cast("array<string>"), "").alias("type_ids"))


@check("tagging_features")
def _(t):
    rows = t.sentences.select("doc_id", "sent_id", split_words("sentence").alias("w"))
    rows = rows.select("doc_id", "sent_id", F.transform("w", word_pieces).alias("pieces"), F.transform("w", lambda x: F.length(x) % 5).alias("labels"))
    out = C.tagging_features(rows, ["doc_id", "sent_id"], "pieces", "labels", 32)
    return out.select("doc_id", "sent_id", "sub_id", F.array_join("tokens", " ").alias("tokens"), text_of("label_ids").alias("label_ids"))


def located(t):
    """Questions whose answer text stands in the context as it is, with its offset."""
    return t.qa.withColumn("at", F.instr("context", F.col("truth")) - 1).filter("at >= 0")


LOCATED_SQL = """lo AS (SELECT *, instr(context, truth) - 1 AS loc FROM qa WHERE instr(context, truth) > 0),
sp AS (SELECT *, len(list_filter(regexp_split_to_array(substr(context, 1, (loc + 1)::INT), '\\s+'), lambda w: w <> '')) - 1 AS start_word,
  len(list_filter(regexp_split_to_array(substr(context, 1, (loc + length(truth))::INT), '\\s+'), lambda w: w <> '')) - 1 AS end_word FROM lo)"""


@check("qa_char_to_word", "qa", f"WITH {LOCATED_SQL} SELECT qid, start_word::INT AS start_word, end_word::INT AS end_word FROM sp")
def _(t):
    return C.answer_word_spans(located(t), "context", "truth", "at").select("qid", "start_word", "end_word")


@check("qa_improve_span", "qa", r"""
WITH x AS (SELECT qid, list_filter(regexp_split_to_array(regexp_replace(truth, '([!-/:-@\[-`{-~\p{P}])', ' \1 ', 'g'), '\s+'), lambda w: w <> '') AS d,
  list_filter(regexp_split_to_array(regexp_replace(split_part(truth, ' ', 2), '([!-/:-@\[-`{-~\p{P}])', ' \1 ', 'g'), '\s+'), lambda w: w <> '') AS a FROM qa),
c AS (SELECT qid, d, a, s, e FROM x, range(200) p(s), range(200) q(e) WHERE s <= e AND e < len(d)),
h AS (SELECT qid, min((s, -e)) AS b FROM c WHERE len(a) > 0 AND array_to_string(d[(s + 1)::INT:(e + 1)::INT], ' ') = array_to_string(a, ' ') GROUP BY 1)
SELECT x.qid, coalesce(b[1], 0)::INT AS start, coalesce(-b[2], len(d) - 1)::INT AS "end" FROM x LEFT JOIN h ON h.qid = x.qid""")
def _(t):
    """The second word of the answer searched in the tokens of the whole answer."""
    rows = t.qa.select("qid", split_punct("truth").alias("d"), split_punct(F.coalesce(F.get(F.split("truth", " "), F.lit(1)), F.lit(""))).alias("a"))
    span = C.improve_span("d", F.lit(0), F.size("d") - 1, "a")
    return rows.select("qid", span["start"].alias("start"), span["end"].alias("end"))


@check("qa_features", "qa", f"""
WITH t AS (SELECT qid, {WORDS.replace('text', 'context')} AS d, ['what', 'is', 'q' || qid % 9][1:(1 + qid % 3)::INT] AS q FROM qa),
w AS (SELECT *, len(d) AS n, 61 - len(q) AS width FROM t),
k AS (SELECT *, unnest(range(CASE WHEN n > width THEN ceil((n - width) / 32.0)::INT ELSE 0 END + 1)) AS win FROM w),
f AS (SELECT *, (win * 32)::INT AS start, least(width, n - win * 32)::INT AS length FROM k),
p AS (SELECT qid, win, start + i AS pos, least(i, length - 1 - i) + 0.01::DOUBLE * length AS sc FROM (SELECT *, unnest(range(length)) AS i FROM f)),
mc AS (SELECT qid, pos, arg_max(win, (sc, -win)) AS best FROM p GROUP BY 1, 2),
fl AS (SELECT p.qid, p.win, string_agg(CASE WHEN best = p.win THEN '1' ELSE '0' END, '' ORDER BY p.pos) AS flags FROM p JOIN mc ON mc.qid = p.qid AND mc.pos = p.pos GROUP BY 1, 2)
SELECT f.qid, f.win::INT AS "window", start, length, '[CLS] ' || array_to_string(q, ' ') || ' [SEP] ' || array_to_string(d[start + 1:start + length], ' ') || ' [SEP]' || repeat(' [PAD]', (61 - len(q) - length)::INT) AS tokens,
  flags AS max_context, CASE WHEN start <= 4 AND 7 < start + length THEN 4 - start + len(q) + 2 ELSE 0 END::INT AS start_position,
  CASE WHEN start <= 4 AND 7 < start + length THEN 7 - start + len(q) + 2 ELSE 0 END::INT AS end_position
FROM f JOIN fl ON fl.qid = f.qid AND fl.win = f.win""")
def _(t):
    query = F.slice(F.array(F.lit("what"), F.lit("is"), F.concat(F.lit("q"), (F.col("qid") % 9).cast("string"))), F.lit(1), (1 + F.col("qid") % 3).cast("int"))
    rows = t.qa.select("qid", query.alias("q"), split_words("context").alias("d"), F.lit(4).alias("s"), F.lit(7).alias("e"))
    out = C.qa_features(rows, ["qid"], "q", "d", "s", "e", 64, 16, 32)
    return out.select("qid", "window", "start", "length", F.array_join("tokens", " ").alias("tokens"),
                      F.array_join(F.col("max_context").cast("array<string>"), "").alias("max_context"), "start_position", "end_position")


def paragraphs(t):
    """Lines as paragraphs, full stops as sentence ends."""
    lines = F.filter(F.split("context", "\n"), lambda s: F.trim(s) != "")
    sentence = lambda line: F.filter(F.transform(F.split(line, r"(?<=\.)\s+"), split_words), lambda w: F.size(w) > 0)
    return t.qa.select("qid", F.transform(lines, sentence).alias("p"), (1 + F.col("qid") % 5).cast("int").alias("q"))


@check("evidence_features", "qa", r"""
WITH RECURSIVE pg AS (SELECT qid, (1 + qid % 5)::INT AS q, list_filter(string_split(context, chr(10)), lambda s: trim(s) <> '') AS l FROM qa),
ln AS (SELECT qid, q, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS line FROM pg),
st AS (SELECT qid, p, generate_subscripts(x, 1) AS j, unnest(x) AS sent FROM (SELECT qid, p, string_split(regexp_replace(line, '\.\s+', '.' || chr(1), 'g'), chr(1)) AS x FROM ln)),
wd AS (SELECT qid, p, j, list_filter(regexp_split_to_array(sent, '\s+'), lambda w: w <> '') AS w FROM st),
sn AS (SELECT qid, p, w, row_number() OVER o - 1 AS k, sum(len(w)) OVER o AS upto FROM wd WHERE len(w) > 0 WINDOW o AS (PARTITION BY qid ORDER BY p, j)),
ap AS (SELECT qid, q, p FROM ln UNION ALL SELECT qid, q, len(l) FROM pg WHERE len(l) > 0),
pr AS (SELECT qid, q, p, coalesce(sum(c) OVER o, 0) AS first, coalesce(sum(z) OVER o, 0) AS base
  FROM (SELECT ap.qid, q, ap.p, count(sn.k) AS c, coalesce(sum(len(w)), 0) AS z FROM ap LEFT JOIN sn ON sn.qid = ap.qid AND sn.p = ap.p GROUP BY 1, 2, 3)
  WINDOW o AS (PARTITION BY qid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ft AS (SELECT pr.qid, pr.p, first, base, count(sn.k) AS n FROM pr LEFT JOIN sn ON sn.qid = pr.qid AND k >= first AND upto - base < 127 - q AND k - first < 23 - q GROUP BY 1, 2, 3, 4),
en AS (SELECT qid, max(p) AS last, max(first) AS sentences FROM ft GROUP BY 1),
sp AS (SELECT ft.*, (SELECT max(b.p) FROM pr b WHERE b.qid = ft.qid AND b.first <= ft.first + ft.n) AS stop FROM ft),
nx AS (SELECT sp.*, greatest(p + 1, (SELECT max(b.p) FROM pr b WHERE b.qid = sp.qid AND b.p <= sp.stop + 1 AND b.base <= sp.base + 64)) AS onward FROM sp),
ch AS (SELECT qid, 0 AS stride_index, p, first, n, onward FROM nx WHERE p = 0
  UNION ALL SELECT nx.qid, stride_index + 1, nx.p, nx.first, nx.n, nx.onward FROM ch JOIN en ON en.qid = ch.qid JOIN nx ON nx.qid = ch.qid AND nx.p = ch.onward
  WHERE ch.first + ch.n < sentences AND ch.onward < last)
SELECT ch.qid, stride_index, n::INT AS n, coalesce(string_agg(array_to_string(w, ' '), ' ' ORDER BY k), '') AS context
FROM ch LEFT JOIN sn ON sn.qid = ch.qid AND k >= first AND k < first + n GROUP BY ch.qid, stride_index, n""")
def _(t):
    out = C.evidence_features(paragraphs(t), ["qid"], "p", "q", 128, 24, 64)
    return out.select("qid", "stride_index", F.size("sentences").alias("n"), F.array_join(F.flatten("sentences"), " ").alias("context"))


@check("answer_spans")
def _(t):
    """Answers of each question found again in its whole context, aligned to its words."""
    rows = t.qa.select("qid", F.array_join(split_words("context"), " ").alias("c"), answer_aliases(F.array("truth")).alias("answers"))
    words = F.split("c", " ")
    sizes = F.transform(words, lambda w: F.octet_length(w) + 1)
    rows = rows.withColumn("offsets", offsets_before(sizes))
    return C.answer_spans(rows, ["qid"], "c", "offsets", "answers")


@check("story_features", sql=f"""
WITH {PAGES_SQL}, x AS (SELECT k.story_id, i AS place, coalesce(m.url, '') AS url, coalesce(title, '') AS title
FROM (SELECT DISTINCT story_id FROM m) k CROSS JOIN range(1, 4) r(i) LEFT JOIN m ON m.story_id = k.story_id AND m.place = i)
SELECT story_id, 'story ' || story_id AS label, max(url) FILTER (WHERE place = 1) AS url_a, max(title) FILTER (WHERE place = 1) AS title_a,
  max(url) FILTER (WHERE place = 2) AS url_b, max(title) FILTER (WHERE place = 2) AS title_b, max(url) FILTER (WHERE place = 3) AS url_c, max(title) FILTER (WHERE place = 3) AS title_c
FROM x GROUP BY 1""")
def _(t):
    stories, articles = story_tables(t)
    return C.story_features(stories_to_articles(stories, articles, normalize_url, 3), 3)


@check("corpus_split_by_time", sql="""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, pos, CASE WHEN pos >= total - 500 THEN 'test' WHEN pos >= total - 1000 THEN 'validation' ELSE 'train' END AS split FROM n""")
def _(t):
    return split_by_time(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 500, 500).drop("o_orderdate")
