"""Grouped summaries and evaluation counts. All of them combine on the map side first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.scalars import f_score
from feedloom.operators.ordered import with_neighbour, with_position, with_running


def filter_min_count(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key occurs at least ``least`` times."""
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return df.join(often.select(key), key, "left_semi")


def zero_index(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """(key, index): dense 0-based ids in the order in which keys first appear."""
    first = df.groupBy(key).agg(F.min(F.struct(*order_by)).alias("_first"))
    flat = first.select(key, *[F.col(f"_first.{c}").alias(f"_{i}") for i, c in enumerate(order_by)])
    order = [f"_{i}" for i in range(len(order_by))]
    return with_position(flat, order, name="index").select(key, "index")


def group_mode(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group; the smallest one on ties."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(out))


def pivot_indicator(df: DataFrame, key: str, value: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per value."""
    return df.select(key, *[(F.col(value) == v).cast("int").alias(v) for v in values])


def sweep_summary(df: DataFrame, keys: Sequence[str], epoch: str, seconds: str, warmup: int = 2) -> DataFrame:
    """Mean and population deviation per configuration, with and without the warm-up epochs.

    The warm-up is dropped only where more epochs than that were run.
    """
    late = F.when(F.col(epoch) >= warmup, F.col(seconds))
    n = F.count(F.lit(1))
    enough = n > warmup
    return df.groupBy(*keys).agg(
        F.when(enough, F.avg(late)).otherwise(F.avg(seconds)).alias("avg"),
        F.when(enough, F.stddev_pop(late)).otherwise(F.stddev_pop(seconds)).alias("std"),
        F.when(enough, n - warmup).otherwise(n).alias("num_epochs_for_avg"),
        F.avg(seconds).alias("avg_all_epochs"),
        F.stddev_pop(seconds).alias("std_all_epochs"),
        n.alias("num_epochs"),
    )


# Cache policy codes of the sweep.
POLICIES = {2: "compute", 3: "cache", 4: "source", 5: "auto"}


def time_per_batch(summary: DataFrame, point: str, policy: str, batches: int) -> DataFrame:
    """Milliseconds per batch at each sweep point, one column per cache policy."""
    ms = 1000 * F.col("avg") / batches
    return summary.groupBy(point).agg(
        *[F.max(F.when(F.col(policy) == code, ms)).alias(name) for code, name in POLICIES.items()]
    )


def decision_cost(costs: DataFrame, decisions: DataFrame, point: str, decision: str) -> DataFrame:
    """Cost of the mode that was decided on at each point (0 when none of the known ones)."""
    chosen = F.lit(0.0)
    for mode in ("compute", "cache", "source"):
        chosen = F.when(F.col(decision) == mode, F.col(mode)).otherwise(chosen)
    return costs.join(decisions, point).select(point, decision, chosen.alias("cost"))


def best_mode(costs: DataFrame, point: str, modes: Sequence[str]) -> DataFrame:
    """The cheapest mode per point; the first listed one on ties."""
    ranked = F.array(*[F.struct(F.col(m).alias("cost"), F.lit(i).alias("i"), F.lit(m).alias("mode")) for i, m in enumerate(modes)])
    best = F.array_min(ranked)
    return costs.select(point, best["mode"].alias("best_mode"), best["cost"].alias("cost"))


def throughput(df: DataFrame, key: str, time: str, order_by, batch: int, warmup: int = 1) -> DataFrame:
    """Examples per second per key: over all steps, and after ``warmup`` steps.

    One row is one step's end; ``time`` is in seconds.
    """
    steps = with_position(df, order_by, [key], "_step")
    last = F.max(F.struct("_step", time))
    at = lambda n: F.max(F.when(F.col("_step") == n, F.col(time)))
    out = steps.groupBy(key).agg(last.alias("_l"), at(0).alias("_t0"), at(warmup).alias("_tw"))
    end, n = F.col(f"_l.{time}"), F.col("_l._step")
    return out.select(
        key,
        (batch * n / (end - F.col("_t0"))).alias("all_per_sec"),
        (batch * (n - warmup) / (end - F.col("_tw"))).alias("warm_per_sec"),
    )


def token_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


# Characters that escaped tokens may contain.
ESCAPE_CHARACTERS = "\\_u;0123456789"


def alphabet(docs: DataFrame, text: str) -> DataFrame:
    """Distinct characters of a corpus plus the escape characters."""
    chars = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    extra = F.array(*[F.lit(c) for c in ESCAPE_CHARACTERS])
    found = docs.select(F.explode(chars).alias("ch")).distinct()
    fixed = docs.sparkSession.range(1).select(F.explode(extra).alias("ch"))
    return found.union(fixed).distinct()


def confusion_iou(df: DataFrame, truth: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """Per class: weighted tp, union and IoU; class -1 is the mean over classes present."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(
        F.sum(weight if weight is not None else F.lit(1.0)).alias("w")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("w")).otherwise(0.0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("class"), hit.alias("tp"), F.col("w").alias("w")),
                F.struct(F.col("p").alias("class"), F.lit(0.0).alias("tp"), F.col("w").alias("w")),
            )
        ).alias("s")
    ).select("s.*")
    per = sides.groupBy("class").agg(F.sum("tp").alias("tp"), (F.sum("w") - F.sum("tp")).alias("union"))
    per = per.filter("union > 0").withColumn("iou", F.col("tp") / F.col("union"))
    mean = per.agg(F.lit(-1).alias("class"), F.sum("tp").alias("tp"), F.sum("union").alias("union"), F.avg("iou").alias("iou"))
    return per.unionByName(mean)


def matthews(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Matthews correlation of two booleans (0 when a margin is empty)."""
    n = lambda c: F.count_if(c).cast("double")
    t = df.agg(
        n(truth & predicted).alias("tp"), n(~truth & ~predicted).alias("tn"),
        n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"),
    )
    margin = F.expr("(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)")
    mcc = F.when(margin > 0, F.expr("tp * tn - fp * fn") / F.sqrt(margin)).otherwise(0.0)
    return t.select(mcc.alias("mcc"))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """1-based rank of each row's value, the mean rank on ties.

    Only the distinct values are ordered; rows look their rank up.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = with_running(counts, [value], {"_upto": ("sum", F.col("_n"))})
    ranks = ranks.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, value)


def pearson_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    out = ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))
    return out.withColumn("mean", (F.col("pearson") + F.col("spearman")) / 2)


def assert_consistent(metadata: DataFrame) -> DataFrame:
    """The one metadata row all parts share; differing parts are an error."""
    rows = metadata.select(F.to_json(F.struct("*")).alias("m")).distinct().limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"parts differ: {rows[0]['m']} and {rows[1]['m']}")
    return metadata.limit(1)


def padded_accuracy(df: DataFrame, labels: str, ranked: str, k: int = 1) -> DataFrame:
    """Token, top-k and whole-sequence accuracy over label arrays, ignoring label 0.

    ``ranked`` holds, per position, the predicted classes best first. The shorter side is
    padded with 0.
    """
    both = F.zip_with(
        labels, ranked,
        lambda l, r: F.struct(F.coalesce(l, F.lit(0)).alias("l"), F.coalesce(r, F.array(F.lit(0))).alias("r")),
    )
    real = df.select(F.filter(both, lambda e: e["l"] != 0).alias("e"))
    count = lambda f: F.size(F.filter("e", f))
    rows = real.select(
        F.size("e").alias("n"),
        count(lambda e: F.get(e["r"], F.lit(0)) == e["l"]).alias("hit"),
        count(lambda e: F.array_contains(F.slice(e["r"], 1, k), e["l"])).alias("hit_k"),
    )
    return rows.agg(
        (F.sum("hit") / F.sum("n")).alias("accuracy"),
        (F.sum("hit_k") / F.sum("n")).alias("top_k_accuracy"),
        F.avg((F.col("hit") == F.col("n")).cast("double")).alias("sequence_accuracy"),
    )


def tag_spans(df: DataFrame, seq: str, pos: str, tag: str) -> DataFrame:
    """Entity spans (seq, kind, begin, end) of B-/I-/O tags.

    A span begins at B-, after O, and where the kind changes.
    """
    t = df.select(seq, pos, F.substring(tag, 1, 1).alias("bio"), F.substring(F.col(tag), F.lit(3), F.length(tag)).alias("kind"))
    t = with_neighbour(t, [pos], {"pbio": "bio", "pkind": "kind"}, [seq], back=True)
    inside = F.col("bio") != "O"
    start = inside & (
        (F.col("bio") == "B") | F.col("pbio").isNull() | (F.col("pbio") == "O") | (F.col("pkind") != F.col("kind"))
    )
    t = with_running(t, [pos], {"span": ("sum", start.cast("int"))}, [seq]).filter(inside)
    return t.groupBy(seq, "span").agg(
        F.min("kind").alias("kind"), F.min(pos).alias("begin"), F.max(pos).alias("end")
    ).drop("span")


def tagging_span_f1(df: DataFrame, seq: str, pos: str, truth: str, predicted: str) -> DataFrame:
    """Span precision, recall and F1, and token accuracy."""
    mark = lambda c, side: tag_spans(df, seq, pos, c).withColumn("side", F.lit(side))
    spans = mark(truth, 1).unionByName(mark(predicted, 2))
    found = spans.groupBy(seq, "kind", "begin", "end").agg(F.sum("side").alias("s"))
    n = lambda c: F.count_if(c).cast("double")
    s = F.col("s")
    spans = found.agg(n(s == 3).alias("tp"), n(s >= 2).alias("n_pred"), n((s == 1) | (s == 3)).alias("n_true"))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    scores = spans.select(p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f1"), F.lit(0).alias("_k"))
    tokens = df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.lit(0).alias("_k"))
    return scores.join(tokens, "_k").drop("_k")
