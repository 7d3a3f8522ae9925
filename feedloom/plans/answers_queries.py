"""Registered queries: evaluation of answers and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.arrays import let
from feedloom.functions.text import bleu_tokenize, split_words
from feedloom.operators import answers as Q
from feedloom.plans.catalog import check
from feedloom.plans.tables import h_sql

NORM_SQL = r"""list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"""

# exact and f1 per question; {truths} lists the truths of a question.
SCORE_SQL = f"""n AS (SELECT qid, has_answer, na_prob, i, {NORM_SQL.format('t')} AS tw, {NORM_SQL.format('p')} AS pw FROM src),
w AS (SELECT qid, i, 1 AS s, unnest(tw) AS w FROM n UNION ALL SELECT qid, i, 2, unnest(pw) FROM n),
c AS (SELECT qid, i, sum(least(a, b)) AS common FROM (SELECT qid, i, w, count(*) FILTER (WHERE s = 1) AS a, count(*) FILTER (WHERE s = 2) AS b FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2),
x AS (SELECT n.qid, n.i, has_answer, na_prob, (tw = pw)::INT AS exact, len(tw) AS nt, len(pw) AS np, coalesce(common, 0)::DOUBLE AS common
  FROM n LEFT JOIN c ON n.qid = c.qid AND n.i = c.i)"""

V1_SQL = f"""src AS (SELECT qid, has_answer, na_prob, unnest([1, 2]) AS i, unnest([truth, split_part(truth, ' ', 1)]) AS t, prediction AS p FROM qa),
{SCORE_SQL},
sc AS (SELECT qid, any_value(has_answer) AS has_answer, any_value(na_prob) AS na_prob, max(exact) AS exact,
  max(CASE WHEN common > 0 THEN 2 * (common / np) * (common / nt) / (common / np + common / nt) ELSE 0 END) AS f1 FROM x GROUP BY 1)"""
V2_SQL = f"""src AS (SELECT qid, has_answer, na_prob, 1 AS i, CASE WHEN has_answer THEN truth ELSE '' END AS t, prediction AS p FROM qa),
{SCORE_SQL},
sc AS (SELECT qid, has_answer, na_prob, exact, CASE WHEN nt = 0 OR np = 0 THEN exact::DOUBLE
  WHEN common > 0 THEN 2 * (common / np) * (common / nt) / (common / np + common / nt) ELSE 0 END AS f1 FROM x)"""


def v2_scores(t):
    qa = t.qa.select(
        "qid", "prediction", F.when(F.col("has_answer"), F.array("truth")).otherwise(F.array(F.lit(""))).alias("truths")
    )
    scores = Q.answer_scores(qa, "qid", "truths", "prediction", empty_agrees=True)
    return scores.join(t.qa.select("qid", "has_answer", "na_prob", "prediction"), "qid")


def rounded(df, digits=6):
    doubles = {n for n, k in df.dtypes if k == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else c for c in df.columns])


@check("em_f1", "qa", f"""
WITH {V1_SQL} SELECT round(100 * avg(exact), 6) AS exact_match, round(100 * avg(f1), 6) AS f1, count(*) AS total FROM sc""")
def _(t):
    qa = t.qa.select("qid", "prediction", F.array(F.col("truth"), F.substring_index("truth", " ", 1)).alias("truths"))
    return rounded(Q.em_f1(Q.answer_scores(qa, "qid", "truths", "prediction")))


@check("em_f1_per_question", "qa", f"WITH {V2_SQL} SELECT qid, exact, round(f1, 9) AS f1 FROM sc")
def _(t):
    return rounded(v2_scores(t).select("qid", "exact", "f1"), 9)


@check("em_f1_no_answer", "qa", f"""
WITH {V2_SQL}, z AS (SELECT has_answer, CASE WHEN na_prob > 0.9 THEN (NOT has_answer)::INT ELSE exact END AS exact,
  CASE WHEN na_prob > 0.9 THEN (NOT has_answer)::INT ELSE f1 END AS f1 FROM sc)
SELECT round(100 * avg(exact), 6) AS exact, round(100 * avg(f1), 6) AS f1, count(*) AS total,
  round(100 * avg(exact) FILTER (WHERE has_answer), 6) AS "HasAns_exact", round(100 * avg(f1) FILTER (WHERE has_answer), 6) AS "HasAns_f1",
  count(*) FILTER (WHERE has_answer) AS "HasAns_total", round(100 * avg(exact) FILTER (WHERE NOT has_answer), 6) AS "NoAns_exact",
  round(100 * avg(f1) FILTER (WHERE NOT has_answer), 6) AS "NoAns_f1", count(*) FILTER (WHERE NOT has_answer) AS "NoAns_total" FROM z""")
def _(t):
    return rounded(Q.answer_report(v2_scores(t), "qid", "na_prob", "has_answer", 0.9))


@check("em_f1_threshold", "qa", f"""
WITH {V2_SQL}, q2 AS (SELECT sc.*, prediction FROM sc JOIN qa USING (qid)),
s AS (SELECT qid, na_prob, round(CASE WHEN has_answer THEN f1 WHEN prediction <> '' THEN -1 ELSE 0 END * 1e12)::BIGINT AS d FROM q2),
r AS (SELECT *, sum(d) OVER (ORDER BY na_prob, qid) AS run FROM s), b AS (SELECT max(run) AS best FROM r),
n2 AS (SELECT count(*) FILTER (WHERE NOT has_answer) AS none, count(*) AS total FROM sc)
SELECT round(100.0 * (none + greatest(best, 0) / 1e12) / total, 6) AS best_score,
  CASE WHEN best > 0 THEN (SELECT min(na_prob) FROM r WHERE run = best) ELSE 0.0 END AS best_threshold FROM b, n2""")
def _(t):
    out = Q.best_threshold(v2_scores(t), "qid", "f1", "na_prob", "has_answer", "prediction")
    return out.select(F.round("best_score", 6).alias("best_score"), "best_threshold")


@check("em_f1_average_precision", "qa", f"""
WITH {V2_SQL}, g AS (SELECT na_prob, sum(CASE WHEN has_answer THEN f1 ELSE 0 END) AS tp, count(*) AS n FROM sc GROUP BY 1),
c2 AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY na_prob))
SELECT round(100 * sum(ctp / cn * tp) / (SELECT count(*) FILTER (WHERE has_answer) FROM sc), 6) AS pr_f1_ap FROM c2""")
def _(t):
    curve = Q.precision_recall_curve(v2_scores(t), "f1", "na_prob", F.col("has_answer"))
    return curve.agg(F.round(100 * F.sum("ap_part"), 6).alias("pr_f1_ap"))


@check("em_exact_threshold", "qa", f"""
WITH {V2_SQL}, q2 AS (SELECT sc.*, prediction FROM sc JOIN qa USING (qid)),
s AS (SELECT qid, na_prob, CASE WHEN has_answer THEN exact WHEN prediction <> '' THEN -1 ELSE 0 END AS d FROM q2),
r AS (SELECT *, sum(d) OVER (ORDER BY na_prob, qid) AS run FROM s), b AS (SELECT max(run) AS best FROM r),
n2 AS (SELECT count(*) FILTER (WHERE NOT has_answer) AS none, count(*) AS total FROM sc)
SELECT round(100.0 * (none + greatest(best, 0)) / total, 6)::DOUBLE AS best_exact,
  CASE WHEN best > 0 THEN (SELECT min(na_prob) FROM r WHERE run = best) ELSE 0.0 END AS best_exact_thresh FROM b, n2""")
def _(t):
    out = Q.best_threshold(v2_scores(t), "qid", "exact", "na_prob", "has_answer", "prediction")
    return out.select(F.round("best_score", 6).alias("best_exact"), F.col("best_threshold").alias("best_exact_thresh"))


def _curve_sql(score: str) -> str:
    return f"""
WITH {V2_SQL}, g AS (SELECT na_prob, sum(CASE WHEN has_answer THEN {score} ELSE 0 END)::DOUBLE AS tp, count(*) AS n FROM sc GROUP BY 1),
c2 AS (SELECT na_prob, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY na_prob)),
p AS (SELECT count(*) FILTER (WHERE has_answer) AS has FROM sc)
SELECT round(na_prob, 9) AS na_prob, round(ctp / cn, 9) AS "precision", round(ctp / has, 9) AS recall, round(ctp / cn * tp / has, 9) AS ap_part FROM c2, p"""


@check("em_exact_curve", "qa", _curve_sql("exact"))
def _(t):
    return rounded(Q.precision_recall_curve(v2_scores(t), "exact", "na_prob", F.col("has_answer")), 9)


@check("em_oracle_curve", "qa", _curve_sql("1"))
def _(t):
    """An answer counts as found wherever there is one, whatever was predicted."""
    scores = v2_scores(t).withColumn("oracle", F.col("has_answer").cast("double"))
    return rounded(Q.precision_recall_curve(scores, "oracle", "na_prob", F.col("has_answer")), 9)


@check("oracle_em", "qa", f"""
SELECT round(100 * avg(coalesce(contains(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(prediction), '[!-/:-@\\[-`{{-~‘’´]', ' ', 'g'), '\\s+'),
    lambda w: w NOT IN ('', 'a', 'an', 'the')), ' '), lower(split_part(truth, ' ', 2))), false)::INT), 6) AS oracle_exact_match,
  count(*) AS common, count(*) AS denominator FROM qa""")
def _(t):
    qa = t.qa.select("prediction", F.array(F.lower(F.get(F.split("truth", " "), F.lit(1)))).alias("truths"))
    return rounded(Q.oracle_em(qa, "truths", "prediction"))


BLEU_TOKENS = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({0},
  '([^\p{{Nd}}])([\p{{P}}])', '\1 \2 ', 'g'), '([\p{{P}}])([^\p{{Nd}}])', ' \1 \2', 'g'), '([\p{{S}}])', ' \1 ', 'g'), '\s+'), lambda w: w <> '')"""
BLEU_SQL = f"""t AS (SELECT conv_id, turn, {BLEU_TOKENS.format('lower(b)')} AS h, {BLEU_TOKENS.format('lower(a)')} AS r FROM pairs),
o AS (SELECT conv_id, turn, h, r, unnest([1, 2, 3, 4]) AS n FROM t),
g AS (SELECT conv_id, turn, n, 1 AS s, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM o
  UNION ALL SELECT conv_id, turn, n, 2, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) FROM o),
c AS (SELECT n, sum(least(h, r)) AS m, sum(h) AS p, sum(r) AS ref FROM (SELECT conv_id, turn, n, g, count(*) FILTER (WHERE s = 1) AS h, count(*) FILTER (WHERE s = 2) AS r FROM g GROUP BY ALL) GROUP BY n)"""


@check("bleu", "pairs", f"""
WITH {BLEU_SQL}, l AS (SELECT max(p) FILTER (WHERE n = 1) AS hl, max(ref) FILTER (WHERE n = 1) AS rl,
  sum(ln(CASE WHEN m > 0 THEN m / p ELSE 1 / (pow(2, z) * p) END)) AS ls FROM (SELECT *, sum((m = 0)::INT) OVER (ORDER BY n) AS z FROM c))
SELECT round(100 * exp(ls / 4) * CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END, 6) AS bleu FROM l""")
def _(t):
    return rounded(Q.bleu(t.pairs, ["conv_id", "turn"], "b", "a"))


@check("bleu_ngram_counts", "pairs", f"""
WITH {BLEU_SQL} SELECT n::INT AS n, m::BIGINT AS matches, p::BIGINT AS possible, ref::BIGINT AS reference FROM c""")
def _(t):
    return Q.bleu_counts(t.pairs, ["conv_id", "turn"], bleu_tokenize(F.lower("b")), bleu_tokenize(F.lower("a")))


@check("rouge_n", "pairs", """
WITH w AS (SELECT conv_id, turn, string_split(b, ' ') AS h, string_split(a, ' ') AS r FROM pairs),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])) AS h,
  list_distinct(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS r FROM w),
f AS (SELECT conv_id, turn, len(list_intersect(h, r)) AS o, len(h) AS h, len(r) AS r FROM g),
p AS (SELECT conv_id, turn, CASE WHEN h > 0 THEN o / h ELSE 0 END::DOUBLE AS p, CASE WHEN r > 0 THEN o / r ELSE 0 END::DOUBLE AS r FROM f)
SELECT conv_id, turn, round(2.0 * (p * r / (p + r + 1e-8)), 9) AS f1 FROM p""")
def _(t):
    return rounded(Q.rouge_n(t.pairs, ["conv_id", "turn"], F.split("b", " "), F.split("a", " ")), 9)


@check("rouge_l")
def _(t):
    out = Q.rouge_l(t.pairs, ["conv_id", "turn"], split_words("b"), split_words("a"))
    return out.agg(F.round(F.avg("f"), 9).alias("rouge_l"), F.count("*").alias("pairs"))


# Spans of 1 to 3 words at every position, with logits from the arithmetic hash.
def span_candidates(t):
    from feedloom.functions.hashing import unit

    words = F.filter(F.split("context", r"\s+"), lambda w: w != "")
    # A row of its own for each span, without the words of the whole text beside it.
    cut = lambda w, i, n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("text"))
    sizes = lambda w, i: F.sequence(F.lit(1), F.least(F.lit(3), F.size(w) - i))
    spans = lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.transform(sizes(w, i), lambda n: cut(w, i, n))))
    rows = t.qa.select("qid", F.explode(let(words, spans)).alias("s")).select("qid", "s.*")
    return rows.select(
        "qid", "text",
        (unit("qid", F.col("i"), 21) * 8).alias("start_logit"),
        (unit("qid", F.col("i") + F.col("n"), 22) * 8).alias("end_logit"),
        (F.col("i") * 3 + F.col("n")).alias("rank"),
    )


@check("qa_nbest", "qa tokens", f"""
WITH s AS (SELECT doc_id AS qid, pos AS i, n, array_to_string([token, lead(token, 1) OVER w, lead(token, 2) OVER w][1:n], ' ') AS text,
    count(*) OVER (PARTITION BY doc_id, n) AS len FROM tokens, range(1, 4) r(n) WHERE doc_id IN (SELECT qid FROM qa)
    WINDOW w AS (PARTITION BY doc_id, n ORDER BY pos)),
v AS (SELECT qid, text, {h_sql('qid', 'i', 21)} / 2147483647.0::DOUBLE * 8 AS sl, {h_sql('qid', 'i + n', 22)} / 2147483647.0::DOUBLE * 8 AS el, i * 3 + n AS rank
  FROM s WHERE i + n <= len
  UNION ALL SELECT qid, '', {h_sql('qid', '0', 23)} / 2147483647.0::DOUBLE * 16, 0, 2147483647 FROM qa),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY sl + el DESC, rank) AS k FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sl + el DESC, rank) AS place FROM d WHERE k = 1),
f AS (SELECT qid, text, sl + el AS sc, CASE WHEN place <= 5 THEN place ELSE 6 END AS place FROM b WHERE place <= 5 OR text = ''),
a AS (SELECT qid, max(sc) AS m, max(sc) FILTER (WHERE text = '') AS nul, max(sc) FILTER (WHERE text <> '') AS best, arg_min(text, place) FILTER (WHERE text <> '') AS bt FROM f GROUP BY 1),
z AS (SELECT f.qid, sum(exp(sc - m)) AS t FROM f JOIN a USING (qid) GROUP BY 1)
SELECT qid, place::INT AS place, text, round(exp(sc - m) / t, 9) AS probability, CASE WHEN nul - best > 1.0 THEN '' ELSE bt END AS answer
FROM f JOIN a USING (qid) JOIN z USING (qid)""")
def _(t):
    from feedloom.functions.hashing import unit

    none = t.qa.select("qid", (unit("qid", 0, 23) * 16).alias("start_logit"), F.lit(0.0).alias("end_logit"))
    return rounded(Q.qa_nbest(span_candidates(t), "qid", 5, none, 1.0), 9)
