"""Evaluation of text answers and translations: EM/F1, thresholds, BLEU, ROUGE, n-best."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.arrays import let
from feedloom.functions.scalars import f_score
from feedloom.functions.text import bleu_tokenize, normalize_answer, sliding, split_words
from feedloom.operators.ordered import top_rows, with_running


def common_counts(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Multiset overlap of two token arrays per key: ``common``, ``n_a`` and ``n_b``.

    Both sides go through one count per (key, token), so no join is needed.
    """
    side = lambda c, s: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(s).alias("s")))
    rows = df.select(*keys, F.explode_outer(F.concat(side(a, 1), side(b, 2))).alias("e"))
    n = lambda s: F.count_if(F.col("e.s") == s)
    counts = rows.groupBy(*keys, "e.w").agg(n(1).alias("a"), n(2).alias("b"))
    return counts.groupBy(*keys).agg(
        F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b")
    )


def answer_scores(
    df: DataFrame, qid: str, truths: str, prediction: str, spaced: bool = False, empty_agrees: bool = False
) -> DataFrame:
    """(qid, exact, f1): best over all truths of a question, after normalising.

    ``truths`` is an array column. A null prediction scores 0. With ``empty_agrees`` two empty
    texts score 1, and a question whose truths are all empty expects the empty text.
    """
    norm = lambda c: normalize_answer(c, spaced)
    clean = F.transform(truths, norm)
    if empty_agrees:
        filled = F.filter(clean, lambda s: s != "")
        clean = F.when(F.size(filled) > 0, filled).otherwise(F.array(F.lit("")))
    rows = df.select(qid, norm(F.col(prediction)).alias("_p"), F.posexplode_outer(clean).alias("_i", "_t"))
    pairs = rows.select(qid, "_i", "_p", "_t", split_words("_p").alias("_pw"), split_words("_t").alias("_tw"))
    counts = common_counts(pairs, [qid, "_i", "_p", "_t"], "_pw", "_tw")
    same = F.coalesce(F.col("_p") == F.col("_t"), F.lit(False)).cast("int")
    overlap = f_score(F.col("common") / F.col("n_a"), F.col("common") / F.col("n_b"))
    f1 = F.when(F.col("common") > 0, overlap).otherwise(0.0)
    if empty_agrees:
        f1 = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), same.cast("double")).otherwise(f1)
    return counts.groupBy(qid).agg(F.max(same).alias("exact"), F.max(f1).alias("f1"))


def em_f1(scores: DataFrame) -> DataFrame:
    """Mean exact match and F1 over all questions, in percent."""
    return scores.agg(
        (100 * F.avg("exact")).alias("exact_match"), (100 * F.avg("f1")).alias("f1"), F.count(F.lit(1)).alias("total")
    )


def precision_recall_curve(df: DataFrame, score: str, prob: str, positive: Column) -> DataFrame:
    """Curve over thresholds on the no-answer probability, lowest first.

    One row per distinct probability (a threshold can only sit between different values), with
    precision, recall and the row's share of the average precision.
    """
    total = df.agg(F.count_if(positive)).first()[0]
    hit = F.when(positive, F.col(score).cast("double")).otherwise(0.0)
    steps = df.groupBy(prob).agg(F.sum(hit).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    run = with_running(steps, [prob], {"tp": ("sum", F.col("_tp")), "seen": ("sum", F.col("_n"))})
    precision = F.col("tp") / F.col("seen")
    return run.select(
        prob, precision.alias("precision"), (F.col("tp") / total).alias("recall"),
        (precision * F.col("_tp") / total).alias("ap_part"),
    )


SCALE = 10**12  # fixed-point units, so that equal running scores compare as equal


def best_threshold(df: DataFrame, qid: str, score: str, prob: str, has_answer: str, prediction: str) -> DataFrame:
    """Threshold on the no-answer probability with the best score; the first one on ties.

    Answering nothing scores the unanswerable questions; moving the threshold up adds each
    question's score, or takes 1 off where text was given for an unanswerable one.
    """
    gain = F.when(F.col(has_answer), F.col(score)).otherwise(F.when(F.col(prediction) != "", -1.0).otherwise(0.0))
    units = F.round(gain * SCALE).cast("bigint")
    run = with_running(df.select(qid, prob, units.alias("_u")), [prob, qid], {"_s": ("sum", F.col("_u"))})
    base = df.agg(F.count_if(~F.col(has_answer)).alias("_none"), F.count(F.lit(1)).alias("_total"))
    best = run.agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col(prob).alias("p"))).alias("_b"))
    gain_best = -F.col("_b.s")
    out = best.withColumn("_k", F.lit(0)).join(base.withColumn("_k", F.lit(0)), "_k")
    better = gain_best > 0
    top = F.col("_none") + F.when(better, gain_best / SCALE).otherwise(0.0)
    return out.select(
        (100.0 * top / F.col("_total")).alias("best_score"),
        F.when(better, F.col("_b.p")).otherwise(0.0).alias("best_threshold"),
    )


def answer_report(df: DataFrame, qid: str, prob: str, has_answer: str, limit: float = 1.0) -> DataFrame:
    """Exact and F1 overall and apart for answerable and unanswerable questions.

    ``df`` holds ``exact`` and ``f1`` per question; a no-answer probability over ``limit``
    counts as predicting no answer.
    """
    silent = F.col(prob) > limit
    has = F.col(has_answer)
    final = lambda s: F.when(silent, (~has).cast("double")).otherwise(F.col(s).cast("double"))
    out = []
    for prefix, cond in (("", F.lit(True)), ("HasAns_", has), ("NoAns_", ~has)):
        for s in ("exact", "f1"):
            out.append((100 * F.avg(F.when(cond, final(s)))).alias(prefix + s))
        out.append(F.count_if(cond).alias(prefix + "total"))
    return df.agg(*out)


def oracle_em(df: DataFrame, truths: str, prediction: str) -> DataFrame:
    """Share of questions where some truth is a part of the normalised prediction."""
    text = normalize_answer(prediction, spaced=True)
    hit = let(text, lambda p: F.exists(truths, lambda t: F.contains(p, t)))
    return df.agg(
        (100 * F.avg(F.coalesce(hit, F.lit(False)).cast("double"))).alias("oracle_exact_match"),
        F.count(prediction).alias("common"), F.count(F.lit(1)).alias("denominator"),
    )


def bleu_counts(df: DataFrame, keys: Sequence[str], hypothesis: Column, reference: Column, order: int = 4) -> DataFrame:
    """Per n-gram order: clipped matches and possible matches, and both total lengths."""
    rows = df.select(*keys, hypothesis.alias("_h"), reference.alias("_r"))

    def grams(c, side, n):
        entry = lambda g: F.struct(F.array_join(g, " ").alias("g"), F.lit(n).alias("n"), F.lit(side).alias("s"))
        return F.transform(sliding(c, n), entry)

    all_grams = F.concat(*[grams(c, s, n) for c, s in (("_h", 1), ("_r", 2)) for n in range(1, order + 1)])
    exploded = rows.select(*keys, F.explode(all_grams).alias("e"))
    side = lambda s: F.count_if(F.col("e.s") == s)
    counts = exploded.groupBy(*keys, "e.n", "e.g").agg(side(1).alias("h"), side(2).alias("r"))
    return counts.groupBy("n").agg(
        F.sum(F.least("h", "r")).alias("matches"), F.sum("h").alias("possible"), F.sum("r").alias("reference")
    )


def bleu(df: DataFrame, keys: Sequence[str], hypothesis: str, reference: str, case_sensitive: bool = False, order: int = 4) -> DataFrame:
    """Corpus BLEU in percent with halving smoothing for orders without a match."""
    text = lambda c: bleu_tokenize(F.col(c) if case_sensitive else F.lower(c))
    counts = bleu_counts(df, keys, text(hypothesis), text(reference), order)
    wide = counts.agg(
        *[F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}")
          for n in range(1, order + 1) for c in ("matches", "possible")],
        F.max(F.when(F.col("n") == 1, F.col("possible"))).alias("hyp_len"),
        F.max(F.when(F.col("n") == 1, F.col("reference"))).alias("ref_len"),
    )
    log_sum, any_hit, misses = F.lit(0.0), F.lit(False), F.lit(0)
    for n in range(1, order + 1):
        m, p = F.col(f"matches{n}"), F.col(f"possible{n}")
        empty = (p > 0) & (m == 0)
        misses = misses + empty.cast("int")
        rate = F.when(m > 0, m / p).when(empty, 1.0 / (F.pow(F.lit(2.0), misses) * p))
        any_hit = any_hit | (p > 0)
        log_sum = log_sum + F.coalesce(F.ln(rate), F.lit(0.0))
    mean = F.when(any_hit, F.exp(log_sum / order)).otherwise(0.0)
    ratio = F.col("hyp_len") / F.col("ref_len")
    short = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    return wide.select((100 * mean * short).alias("bleu"))


def rouge_n(df: DataFrame, keys: Sequence[str], hypothesis: Column, reference: Column, n: int = 2) -> DataFrame:
    """(keys, f1) with sets of n-grams."""
    gram = lambda c: F.array_distinct(F.transform(sliding(c, n), lambda g: F.array_join(g, " ")))
    rows = df.select(*keys, hypothesis.alias("_h"), reference.alias("_r")).select(
        *keys, gram("_h").alias("_h"), gram("_r").alias("_r")
    )
    both = F.size(F.array_intersect("_h", "_r"))
    p = F.when(F.size("_h") > 0, both / F.size("_h")).otherwise(0.0)
    r = F.when(F.size("_r") > 0, both / F.size("_r")).otherwise(0.0)
    return rows.select(*keys, (2.0 * (p * r / (p + r + 1e-8))).alias("f1"))


def _lcs(x, y) -> int:
    """Length of the longest common subsequence, one numpy row per item of the shorter side."""
    if len(x) == 0 or len(y) == 0:
        return 0
    if len(x) > len(y):
        x, y = y, x
    codes = {w: i for i, w in enumerate(dict.fromkeys([*x, *y]))}
    long_side = np.array([codes[w] for w in y])
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for w in x:
        extended = np.where(long_side == codes[w], row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(extended)
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(x, y) for x, y in zip(a, b)])


def rouge_l(df: DataFrame, keys: Sequence[str], hypothesis: Column, reference: Column) -> DataFrame:
    """(keys, f) from the longest common subsequence, with beta = P / (R + 1e-12)."""
    rows = df.select(*keys, hypothesis.alias("_h"), reference.alias("_r"))
    rows = rows.withColumn("_lcs", lcs_length("_h", "_r"))
    r, p = F.col("_lcs") / F.size("_r"), F.col("_lcs") / F.size("_h")
    beta = p / (r + 1e-12)
    f = (1 + beta * beta) * r * p / (r + beta * beta * p + 1e-12)
    return rows.select(*keys, F.coalesce(f, F.lit(0.0)).alias("f"))


def _may_be_best(rows: DataFrame, qid: str, text: str, neg: Column, n_best: int) -> DataFrame:
    """``rows`` without those that ``n_best`` other texts of their question are better than, seen from one batch.

    What a batch drops cannot be among the n best of all; the rest meets in the shuffle. Ties stay,
    and so do rows without a score.
    """
    def better(batches):
        for batch in batches:
            asked, known = batch.column(qid).dictionary_encode(), batch.column("_neg")
            scores = known.fill_null(np.nan).to_numpy(zero_copy_only=False)
            of = asked.indices.fill_null(len(asked.dictionary)).to_numpy(zero_copy_only=False)
            usable = pa.array(~np.isnan(scores))
            best = pa.table({"q": of, "t": batch.column(text), "n": scores}).filter(usable).group_by(["q", "t"]).aggregate([("n", "min")])
            best = best.sort_by([("q", "ascending"), ("n_min", "ascending")])
            q, n = best.column("q").to_numpy(), best.column("n_min").to_numpy()
            limits = np.full(len(asked.dictionary) + 1, np.inf)
            nth = np.flatnonzero(q[n_best - 1:] == q[:len(q) - n_best + 1]) if len(q) >= n_best else np.empty(0, int)
            np.minimum.at(limits, q[nth], n[nth + n_best - 1])
            yield batch.filter(pa.array(~(scores > limits[of])))

    scored = rows.withColumn("_neg", neg.cast("double"))
    return scored.mapInArrow(better, scored.schema).drop("_neg")


def qa_nbest(
    candidates: DataFrame, qid: str, n_best: int, null_scores: DataFrame | None = None, threshold: float = 0.0
) -> DataFrame:
    """n best answers per question with softmax probabilities.

    ``candidates`` holds valid spans (``text``, ``start_logit``, ``end_logit``, ``rank`` as the
    tie-break). The best span per text is kept first, then the n best texts; the empty answer
    of ``null_scores`` (``start_logit``, ``end_logit``) takes part as one candidate and is
    appended when it is not among the best. ``answer`` is empty where the null score beats
    the best text by more than the threshold.
    """
    score = F.col("start_logit") + F.col("end_logit")
    rows = _may_be_best(candidates.select(qid, "text", "start_logit", "end_logit", "rank"), qid, "text", -score, n_best)
    if null_scores is not None:
        none = null_scores.select(
            qid, F.lit("").alias("text"), "start_logit", "end_logit", F.lit(2**31 - 1).alias("rank")
        )
        rows = rows.unionByName(none)
    best = rows.groupBy(qid, "text").agg(
        F.min(F.struct((-score).alias("neg"), "rank", "start_logit", "end_logit")).alias("b")
    ).select(qid, "text", "b.*")
    kept = top_rows(best, n_best, ["neg", "rank"], [qid], "place")
    if null_scores is not None:
        missing = none.join(kept.filter("text = ''").select(qid), qid, "left_anti")
        extra = missing.select(qid, "text", (-score).alias("neg"), "rank", "start_logit", "end_logit", F.lit(n_best + 1).alias("place"))
        kept = kept.unionByName(extra)
    per = kept.groupBy(qid).agg(
        F.max(-F.col("neg")).alias("_m"),
        F.min(F.when(F.col("text") != "", F.struct("neg", "place", "text"))).alias("_t"),
        F.max(F.when(F.col("text") == "", -F.col("neg"))).alias("_null"),
        F.collect_list(-F.col("neg")).alias("_all"),
    )
    total = F.aggregate("_all", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_m")))
    silent = F.coalesce(F.col("_null") + F.col("_t.neg") > threshold, F.lit(False))
    per = per.select(
        qid, "_m", total.alias("_sum"),
        F.when(silent | F.col("_t").isNull(), "").otherwise(F.col("_t.text")).alias("answer"),
    )
    return kept.join(per, qid).select(
        qid, "place", "text", (F.exp(-F.col("neg") - F.col("_m")) / F.col("_sum")).alias("probability"), "answer"
    )


def answer_candidates(
    windows: DataFrame, qid: str, window: str, tokens: str, places: str, best_context: str, starts: str, ends: str,
    words: str, n_best: int, max_length: int,
) -> DataFrame:
    """Spans of the ``n_best`` starts and the ``n_best`` ends of each window that can be answers.

    A row of ``windows`` is one window of a question: arrays of equal length hold its ``tokens``, the
    word of the text that a token belongs to (``places``, null outside of the text), whether the
    window shows the token with the most context (``best_context``) and its ``starts`` and ``ends``
    logits, which may be longer; ``words`` are those of the whole text. Every start is crossed with
    every end, both taken by falling logit, then by place; a span counts if both lie within the
    tokens and in the text, the start has its best context here, the end is not before the start and
    the span is at most ``max_length`` tokens. The crossing is ``n_best ** 2`` at most and stays in
    its row. ``text`` is that of the words, ``rank`` orders equal scores by window, start and end.
    """
    def best(logits: str) -> Column:
        listed = F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.alias("at")))
        return F.slice(F.array_sort(F.filter(listed, lambda x: x["neg"].isNotNull())), 1, n_best)

    crossed = F.flatten(F.transform("_s", lambda s: F.transform("_e", lambda e: F.struct(
        s["at"].alias("a"), e["at"].alias("b"), (-s["neg"]).alias("sl"), (-e["neg"]).alias("el")))))
    fits = lambda x: (
        (x["a"] < F.size(tokens)) & (x["b"] < F.size(tokens)) & F.get(places, x["a"]).isNotNull() & F.get(places, x["b"]).isNotNull()
        & F.coalesce(F.get(best_context, x["a"]), F.lit(False)) & (x["b"] >= x["a"]) & (x["b"] - x["a"] < max_length))
    rows = windows.withColumns({"_s": best(starts), "_e": best(ends)})
    found = rows.select("*", F.explode(F.filter(crossed, fits)).alias("x"))
    first, last = F.get(places, F.col("x.a")), F.get(places, F.col("x.b"))
    return found.select(
        qid, window, F.array_join(F.slice(words, first + 1, last - first + 1), " ").alias("text"),
        F.col("x.sl").alias("start_logit"), F.col("x.el").alias("end_logit"), F.col("x.a").alias("start"), F.col("x.b").alias("end"),
        F.struct(F.col(window).alias("window"), F.col("x.a").alias("start"), F.col("x.b").alias("end")).alias("rank"),
    )


def null_answers(windows: DataFrame, qid: str, window: str, starts: str, ends: str) -> DataFrame:
    """``start_logit, end_logit`` of the empty answer: the window where the first token scores least, the first such."""
    s, e = F.get(starts, F.lit(0)), F.get(ends, F.lit(0))
    least = windows.groupBy(qid).agg(F.min(F.struct((s + e).alias("sum"), F.col(window).alias("w"), s.alias("s"), e.alias("e"))).alias("n"))
    return least.select(qid, F.col("n.s").alias("start_logit"), F.col("n.e").alias("end_logit"))


def answer_search(
    windows: DataFrame, qid: str, window: str, tokens: str, places: str, best_context: str, starts: str, ends: str,
    words: str, n_best: int = 20, max_length: int = 30, with_empty: bool = True, threshold: float = 0.0,
) -> DataFrame:
    """The n best answers of each question over all its windows, from the logits of their tokens.

    Columns are those of :func:`answer_candidates` and :func:`qa_nbest`. A question without any
    valid span has only the empty answer, or, without one, the answer ``empty`` of score 0.
    """
    names = (qid, window, tokens, places, best_context, starts, ends, words)
    found = answer_candidates(windows, *names, n_best, max_length)
    place = F.row_number().over(Window.partitionBy(qid).orderBy("rank"))
    spans = found.withColumn("rank", place).select(qid, "text", "start_logit", "end_logit", "rank")
    if with_empty:
        return qa_nbest(spans, qid, n_best, null_answers(windows, qid, window, starts, ends), threshold)
    none = windows.select(qid).distinct().join(spans.select(qid).distinct(), qid, "left_anti")
    spans = spans.unionByName(none.select(qid, F.lit("empty").alias("text"), F.lit(0.0).alias("start_logit"), F.lit(0.0).alias("end_logit"), F.lit(0).alias("rank")))
    return qa_nbest(spans, qid, n_best)
