import math
import random

from pyspark.sql import functions as F

from feedloom.operators import answers as Q


def pairs(spark, *rows):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], "i int, h string, r string")


def test_bleu_of_equal_text(spark):
    same = pairs(spark, ("test 1 two 3", "test 1 two 3"), ("more tests!", "more tests!"))
    assert abs(Q.bleu(same, ["i"], "h", "r").first()[0] - 100) < 1e-6
    cased = pairs(spark, ("Test 1 two 3", "test 1 two 3"), ("more tests!", "More tests!"))
    assert abs(Q.bleu(cased, ["i"], "h", "r").first()[0] - 100) < 1e-6
    assert Q.bleu(cased, ["i"], "h", "r", case_sensitive=True).first()[0] < 100


def test_bleu_smoothing_and_brevity(spark):
    got = Q.bleu(pairs(spark, ("a b c", "a b d e"), ), ["i"], "h", "r").first()[0]
    want = 100 * math.exp((math.log(2 / 3) + math.log(1 / 2) + math.log(1 / 2)) / 4) * math.exp(1 - 4 / 3)
    assert abs(got - want) < 1e-6


def lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge_l(spark):
    texts = [("a b c d e a", "b a c e d a f"), ("x", "y z"), ("p q p q r", "q p r q p q")]
    out = Q.rouge_l(pairs(spark, *texts), ["i"], F.split("h", " "), F.split("r", " ")).collect()
    for row in out:
        h, r = (s.split() for s in texts[row["i"]])
        n = lcs(h, r)
        rec, prec = n / len(r), n / len(h)
        beta = prec / (rec + 1e-12)
        want = (1 + beta**2) * rec * prec / (rec + beta**2 * prec + 1e-12)
        assert abs(row["f"] - want) < 1e-9


def test_exact_and_f1(spark):
    df = spark.createDataFrame(
        [(1, ["The cat."], "cat"), (2, ["big dog", "dog"], "a dog!"), (3, [""], ""), (4, ["x y"], None)],
        "q int, t array<string>, p string",
    )
    got = {r["q"]: (r["exact"], round(r["f1"], 6)) for r in Q.answer_scores(df, "q", "t", "p", empty_agrees=True).collect()}
    assert got[1] == (1, 1.0) and got[2] == (1, 1.0) and got[3] == (1, 1.0) and got[4][0] == 0


def test_best_threshold(spark):
    rows = [(1, 0.1, True, 1.0, "x"), (2, 0.2, False, 0.0, "y"), (3, 0.3, True, 1.0, "z"), (4, 0.9, False, 0.0, "")]
    df = spark.createDataFrame(rows, "q int, p double, has boolean, s double, t string")
    out = Q.best_threshold(df, "q", "s", "p", "has", "t").first()
    assert (out["best_score"], out["best_threshold"]) == (75.0, 0.1)


def test_nbest_drops_hopeless_spans_ahead_of_the_shuffle(spark):
    """Texts repeat, scores tie, and some are missing: what stays is little and holds the best."""
    rng = random.Random(5)
    rows = [(q, f"t{rng.randrange(60)}", rng.choice([None, float("nan"), *map(float, range(40))]), float(rng.randrange(3)), i)
            for q in [1, 2, 3, None] for i in range(800)]
    df = spark.createDataFrame(rows, "qid long, text string, start_logit double, end_logit double, rank int").repartition(3)
    score = F.col("start_logit") + F.col("end_logit")
    kept = Q._may_be_best(df, "qid", "text", -score, 4)
    valued = kept.filter(score.isNotNull() & ~F.isnan(score))
    assert valued.count() < 400 < df.count()
    plain = [r for r in rows if r[2] is not None and not math.isnan(r[2])]
    clean = df.filter(score.isNotNull() & ~F.isnan(score))
    got = {}
    for r in Q.qa_nbest(clean, "qid", 4).collect():
        got.setdefault(r.qid, {})[r.place] = r.text
    for q in (1, 2, 3):
        best = {}
        for _, text, a, b, i in (r for r in plain if r[0] == q):
            best[text] = min(best.get(text, (math.inf, 0)), (-(a + b), i))
        want = sorted(best, key=best.get)[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == want
