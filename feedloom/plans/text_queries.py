"""Registered queries: scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators.aggregates import ESCAPE_CHARACTERS
from feedloom.plans.catalog import check
from feedloom.session import spread

# Text with characters the plain documents lack: a zero-width space, a tab, a no-break space, an ideograph.
ODD_SQL = """odd AS (SELECT doc_id, replace(replace(replace(text, 'qu', 'q' || chr(8203) || 'u'), ' de ', chr(9) || 'de' || chr(160)), 'th', '中') AS t
  FROM documents)"""
CLEAN_SQL = r"""regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}\x{{FFFD}}]', '', 'g'), '[ \t\n\r\p{{Zs}}]', ' ', 'g')"""
CJK_SQL = r"""regexp_replace({0}, '([\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}])', ' \1 ', 'g')"""
PUNCT_SQL = r"""list_filter(regexp_split_to_array(regexp_replace({0}, '([!-/:-@\[-`{{-~\p{{P}}])', ' \1 ', 'g'), '\s+'), lambda w: w <> '')"""


def odd(t):
    text = F.replace("text", F.lit("qu"), F.lit("q​u"))
    text = F.replace(text, F.lit(" de "), F.lit("\tde "))
    return t.documents.select("doc_id", F.replace(text, F.lit("th"), F.lit("中")).alias("t"))


def joined(tokens):
    return F.array_join(tokens, " ")


@check("clean_text", sql=f"WITH {ODD_SQL} SELECT doc_id, {CLEAN_SQL.format('t')} AS clean FROM odd")
def _(t):
    return odd(t).select("doc_id", X.clean_text("t").alias("clean"))


@check("space_cjk", sql=f"WITH {ODD_SQL} SELECT doc_id, {CJK_SQL.format('t')} AS spaced FROM odd")
def _(t):
    return odd(t).select("doc_id", X.space_cjk("t").alias("spaced"))


@check("strip_accents", sql="SELECT doc_id, strip_accents(text) AS plain FROM documents")
def _(t):
    return t.documents.select("doc_id", X.strip_accents("text").alias("plain"))


@check("split_punct", sql=f"SELECT doc_id, array_to_string({PUNCT_SQL.format('text')}, ' ') AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", joined(X.split_punct("text")).alias("words"))


@check("whitespace_tokenize", sql=r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n,
  array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), '|') AS words FROM documents""")
def _(t):
    w = X.split_words("text")
    return t.documents.select("doc_id", F.size(w).cast("bigint").alias("n"), F.array_join(w, "|").alias("words"))


@check("basic_tokenize", sql=f"""
WITH {ODD_SQL}, c AS (SELECT doc_id, strip_accents(lower({CJK_SQL.format(CLEAN_SQL.format('t'))})) AS s FROM odd)
SELECT doc_id, array_to_string({PUNCT_SQL.format('s')}, ' ') AS words FROM c""")
def _(t):
    return spread(odd(t)).select("doc_id", joined(X.basic_tokenize("t")).alias("words"))


@check("split_alnum_runs", sql=r"""
WITH r AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS x FROM documents)
SELECT doc_id, array_to_string(list_filter(x, lambda t, i: t <> ' ' OR i = 1 OR i = len(x)), '|') AS runs FROM r""")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.split_alnum_runs("text"), "|").alias("runs"))


@check("join_alnum_runs", sql="SELECT doc_id, text FROM documents")
def _(t):
    """Split and joined again, every document is what it was."""
    runs = t.documents.select("doc_id", X.split_alnum_runs("text").alias("r"))
    return runs.select("doc_id", X.join_alnum_runs("r").alias("text"))


SMALL_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,." + ESCAPE_CHARACTERS


@check("escape_token", sql=r"""
SELECT doc_id, array_to_string(list_transform(string_split(replace(replace(text, '\', '\\'), '_', '\u'), ''),
  lambda c: CASE WHEN contains('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,.\_u;0123456789', c) THEN c ELSE '\' || unicode(c) || ';' END), '') || '_' AS escaped
FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.escape_token("text", SMALL_ALPHABET).alias("escaped"))


@check("unescape_token", sql="SELECT doc_id, text FROM documents")
def _(t):
    """Escaped and unescaped again, every document is what it was."""
    escaped = t.documents.select("doc_id", X.escape_token("text", SMALL_ALPHABET).alias("e"))
    body = F.substring(F.col("e"), F.lit(1), F.length("e") - 1)
    return escaped.select("doc_id", X.unescape_token(body).alias("text"))


@check("bleu_tokenize", sql=r"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text,
  '([^\p{Nd}])([\p{P}])', '\1 \2 ', 'g'), '([\p{P}])([^\p{Nd}])', ' \1 \2', 'g'), '([\p{S}])', ' \1 ', 'g'), '\s+'), lambda w: w <> ''), ' ') AS words FROM documents""")
def _(t):
    return t.documents.select("doc_id", joined(X.bleu_tokenize("text")).alias("words"))


@check("preprocess_text", sql=r"""
SELECT doc_id, lower(strip_accents(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS s FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.preprocess_text("text", lower=True).alias("s"))


@check("preprocess_text_quotes", sql=r"""
SELECT doc_id, replace(replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '``', '"'), '''''', '"') AS s
FROM (SELECT doc_id, replace(replace(text, ' le ', ' ``le'''' '), ' the ', ' ``the'''' ') AS t FROM documents)""")
def _(t):
    quoted = F.replace(F.replace("text", F.lit(" le "), F.lit(" ``le'' ")), F.lit(" the "), F.lit(" ``the'' "))
    return t.documents.select("doc_id", X.preprocess_text(quoted, keep_accents=True, quotes=True).alias("s"))


@check("normalize_answer", sql=r"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'),
    lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS tight,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~‘’´]', ' ', 'g'), '\s+'),
    lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS spaced FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.normalize_answer("text").alias("tight"), X.normalize_answer("text", True).alias("spaced"))


@check("normalize_url", sql=r"""
SELECT page_id, regexp_replace(regexp_replace(url, '^([^?#]*)\?[^#]*', '\1'), '^https?://', '') AS url FROM pages""")
def _(t):
    return t.pages.select("page_id", X.normalize_url("url").alias("url"))


@check("truncate_pair", "pairs", """
WITH RECURSIVE s AS (SELECT conv_id, turn, len(string_split(a, ' ')) AS n, len(string_split(b, ' ')) AS m FROM pairs
  UNION ALL SELECT conv_id, turn, CASE WHEN n > m THEN n - 1 ELSE n END, CASE WHEN n > m THEN m ELSE m - 1 END FROM s WHERE n + m > 61)
SELECT s.conv_id, s.turn, array_to_string(string_split(a, ' ')[1:n], ' ') AS a, array_to_string(string_split(b, ' ')[1:m], ' ') AS b
FROM s JOIN pairs p ON p.conv_id = s.conv_id AND p.turn = s.turn WHERE n + m <= 61""")
def _(t):
    a, b = X.truncate_pair(F.split("a", " "), F.split("b", " "), 61)
    return t.pairs.select("conv_id", "turn", joined(a).alias("a"), joined(b).alias("b"))


@check("pair_features", "pairs", """
WITH s AS (SELECT conv_id, turn, string_split(a, ' ') AS a, string_split(b, ' ') AS b FROM pairs),
l AS (SELECT *, CASE WHEN len(a) + len(b) > 61 THEN least(len(a), greatest(61 - len(b), 31)) ELSE len(a) END AS n,
  CASE WHEN len(a) + len(b) > 61 THEN least(len(b), greatest(61 - len(a), 30)) ELSE len(b) END AS m FROM s)
SELECT conv_id, turn, repeat('0', (n + 2)::INT) || repeat('1', (m + 1)::INT) || repeat('0', (61 - n - m)::INT) AS type_ids,
  repeat('1', (n + m + 3)::INT) || repeat('0', (61 - n - m)::INT) AS mask,
  '[CLS] ' || array_to_string(a[1:n], ' ') || ' [SEP] ' || array_to_string(b[1:m], ' ') || ' [SEP]' || repeat(' [PAD]', (61 - n - m)::INT) AS tokens FROM l""")
def _(t):
    rows = t.pairs.select("conv_id", "turn", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    out = rows.select("conv_id", "turn", X.pair_features("a", "b", 64).alias("f"))
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), "")
    return out.select("conv_id", "turn", flat("f.type_ids").alias("type_ids"), flat("f.mask").alias("mask"), joined("f.tokens").alias("tokens"))


@check("json_extract", sql="SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@check("epoch_micros", sql="SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.unix_micros(ts).alias("us"), F.unix_seconds(ts).alias("s"))
