"""Epoch plans that replay kept results instead of preparing rows anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.dataset import sample_mixture
from feedloom.operators.ordered import with_position
from feedloom.session import staged

Augment = Callable[[DataFrame, Column], DataFrame]

# Fixed values: (first epoch, last epoch + 1, replays) of the adaptive plan.
ADAPTIVE = ((0, 30, 6), (30, 60, 3), (60, None, 1))


def replay_groups(epochs: int, schedule: Sequence[tuple[int, int | None, int]]) -> list[tuple[int, int]]:
    """(version, epoch): the epoch whose fresh rows are shown in each epoch."""
    out = []
    for first, stop, times in schedule:
        for epoch in range(first, min(epochs, stop if stop is not None else epochs)):
            out.append((first + (epoch - first) // times * times, epoch))
    return out


def scheduled_cache(df: DataFrame, epochs: int, schedule, augment: Augment) -> DataFrame:
    """Rows of every epoch; each version is prepared and written once, then replayed."""
    plan = replay_groups(epochs, schedule)
    versions = sorted({v for v, _ in plan})
    rows = df.select("*", F.explode(F.array(*map(F.lit, versions))).alias("version"))
    kept = staged(augment(rows, F.col("version")), "versions")
    replays = F.create_map(*[x for v in versions for x in (F.lit(v), F.array(*[F.lit(e) for w, e in plan if w == v]))])
    return kept.select("*", F.explode(replays[F.col("version")]).alias("epoch"))


def periodic_cache(df: DataFrame, epochs: int, times: int, augment: Augment) -> DataFrame:
    """One fresh epoch, then ``times`` - 1 replays of it, and so on."""
    return scheduled_cache(df, epochs, ((0, None, times),), augment)


def adaptive_cache(df: DataFrame, epochs: int, augment: Augment, schedule=ADAPTIVE) -> DataFrame:
    """Fewer replays as training goes on."""
    return scheduled_cache(df, epochs, schedule, augment)


def partial_cache(df: DataFrame, epochs: int, times: int, share: float, weights: tuple[float, float], order_by: str, augment: Augment, seed: int) -> DataFrame:
    """A leading share of the rows is replayed, the others are fresh; drawn by weight.

    Gives each epoch's draws in order (``draw``), with ``source`` cached or fresh.
    """
    total = df.count()
    ranked = staged(with_position(df, [order_by], name="_pos"), "ranked")
    lead = ranked.filter(F.col("_pos") < int(total * share)).drop("_pos")
    rest = ranked.filter(F.col("_pos") >= int(total * share)).drop("_pos")
    kept = periodic_cache(lead, epochs, times, augment)
    parts = None
    for epoch in range(epochs):
        cached = kept.filter(F.col("epoch") == epoch).withColumn("source", F.lit("cached"))
        fresh = augment(rest.withColumn("version", F.lit(epoch)), F.col("version")).withColumn("epoch", F.lit(epoch)).withColumn("source", F.lit("fresh"))
        both = cached.unionByName(fresh)
        drawn = sample_mixture(both, "source", {"cached": weights[0], "fresh": weights[1]}, total, [order_by], seed + epoch)
        parts = drawn if parts is None else parts.unionByName(drawn)
    return parts


# --- which marks to keep -------------------------------------------------------------------

#: Columns of the measured marks of a pipeline: mark 0 is its source, of which only ``read`` counts.
MEASURED = ("mark", "compute", "read", "write", "bytes", "uses")


def choose_marks(measured: DataFrame, pipeline: str, bound: int, grain: int = 1) -> DataFrame:
    """For each pipeline the marks whose results to keep, so that all its uses take the least time.

    ``measured`` holds a row a mark: number in the order of the steps, time to ``compute`` its result from the mark
    before, to ``read`` it when kept and to ``write`` it, its ``bytes``, and how often it is used; whole
    numbers in any unit of time. A use starts at the last kept mark at or before it (else at the
    source) and computes the rest; keeping costs one computing and the writing. Kept results together take at most
    ``bound`` bytes, each counted in whole grains of ``grain`` bytes, rounded up: no plan goes over
    the bound, and a pipeline has at most bound / grain states behind each mark. With a grain of 1 the choice is exact.

    Gives ``kept`` (mark numbers), ``seconds``, ``grains`` and ``plain`` (the time without any kept mark).
    Of equal times the plan of fewer grains wins, then that of fewer marks, then the smaller numbers.

    The states behind a mark differ in the last kept mark, the grains and the time; of two that share the
    last mark only one that is better in grains or in time goes on. Marks are taken one after the other,
    partitioned by pipeline throughout, so the table is shuffled once. A null number counts as 0, a pipeline
    without mark 0 reads its source in no time, rows repeated under one mark are one result measured several
    times (the least numbers count), an empty table gives none.
    """
    if bound < 0 or grain < 1:
        raise ValueError("bound must not be negative and grain at least 1")
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    single = measured.select(F.col(pipeline).alias("pipeline"), *[number(c).alias(c) for c in MEASURED])
    single = single.groupBy("pipeline", "mark").agg(*[F.min(c).alias(c) for c in MEASURED[1:]])
    marks = single.groupBy("pipeline").agg(F.array_sort(F.collect_list(F.struct(*MEASURED))).alias("marks"))
    marks = staged(marks.withColumns({
        "source": F.coalesce(F.get(F.filter("marks", lambda m: m["mark"] == 0), F.lit(0))["read"], F.lit(0).cast("bigint")),
        "marks": F.filter("marks", lambda m: m["mark"] > 0),
    }), "measured")
    longest = marks.agg(F.max(F.size("marks"))).first()[0] or 0
    zero = F.lit(0).cast("bigint")
    states = marks.repartition("pipeline").select(
        "pipeline", "marks", zero.alias("last"), F.col("source").alias("reach"), zero.alias("grains"), zero.alias("seconds"),
        F.expr("cast(array() as array<bigint>)").alias("kept"), F.col("source").alias("plain_reach"), zero.alias("plain"))
    room = bound // grain
    same = Window.partitionBy("pipeline", "last").orderBy("grains", "seconds", F.size("kept"), "kept")
    before = same.rowsBetween(Window.unboundedPreceding, -1)
    for step in range(longest):
        m = F.get("marks", F.lit(step))
        states = states.withColumn("m", m).withColumns({
            "reach": F.col("reach") + F.coalesce(F.col("m.compute"), zero),
            "plain_reach": F.col("plain_reach") + F.coalesce(F.col("m.compute"), zero)})
        states = states.withColumn("plain", F.col("plain") + F.coalesce(F.col("m.uses"), zero) * F.col("plain_reach"))
        size = F.ceil(F.col("m.bytes") / grain).cast("bigint") if grain > 1 else F.col("m.bytes")
        go_on = F.struct("last", "reach", "grains", (F.col("seconds") + F.coalesce(F.col("m.uses"), zero) * F.col("reach")).alias("seconds"), "kept")
        keep = F.struct(
            F.col("m.mark").alias("last"), F.col("m.read").alias("reach"), (F.col("grains") + size).alias("grains"),
            (F.col("seconds") + F.col("reach") + F.col("m.write") + F.col("m.uses") * F.col("m.read")).alias("seconds"),
            F.concat("kept", F.array("m.mark")).alias("kept"))
        fits = F.col("m").isNotNull() & (F.col("grains") + size <= room)
        states = states.withColumn("s", F.explode(F.when(fits, F.array(go_on, keep)).otherwise(F.array(go_on))))
        states = states.select("pipeline", "marks", "s.*", "plain_reach", "plain")
        states = states.withColumn("least", F.min("seconds").over(before))
        states = states.filter(F.col("least").isNull() | (F.col("seconds") < F.col("least"))).drop("least")
        if step % 8 == 7:
            states = staged(states, "marks").repartition("pipeline")
    order = F.struct("seconds", "grains", F.size("kept").alias("n"), "kept")
    best = states.groupBy("pipeline").agg(F.min(order).alias("b"), F.min("plain").alias("plain"))
    return best.select(F.col("pipeline").alias(pipeline), "b.kept", "b.seconds", "b.grains", "plain")
