"""Recommender data: preparation, negative sampling, training and evaluation candidates, metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.hashing import MODULUS, mix, mix_base
from feedloom.operators.batching import batch_rows
from feedloom.operators.ordered import with_neighbour, with_position, with_running
from feedloom.operators.timelines import duplicate_mask
from feedloom.session import staged

# Least ratings per user, negatives per evaluated user, cut-off of the ranking.
MIN_RATINGS = 20
EVAL_NEGATIVES = 999
TOP_K = 10
LIST_ITEMS = 1024  # most positives of a user whose evaluation list or epoch is made in one row
RANGES_A_TASK = 4  # ranges of the shuffled order to a task, so that tasks get even shares
PART_ROWS = 1 << 18  # about how many rows of such lists are made at once


@dataclass
class Prepared:
    """``rows`` (user, item, ts, split) and the maps from the given ids."""

    rows: DataFrame
    users: DataFrame
    items: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("split = 'train'")

    @property
    def eval(self) -> DataFrame:
        return self.rows.filter("split = 'eval'")


def ratings_prepare(ratings: DataFrame, least: int = MIN_RATINGS) -> Prepared:
    """Drop rare users, re-index users and items by first appearance, hold out the last row.

    Count, first and last row of a user come out of one aggregation; the held-out row is the
    latest by (ts, item_id). Tables that later steps read again are written once.
    """
    per_user = ratings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("ts", "item_id")).alias("_first"),
        F.max(F.struct("ts", "item_id")).alias("_last"),
    ).filter(F.col("_n") >= least)
    flat = staged(per_user.select("user_id", F.col("_first.ts").alias("_t"), F.col("_first.item_id").alias("_i"),
                                  F.col("_last.ts").alias("_lt"), F.col("_last.item_id").alias("_li")))
    users = staged(with_position(flat, ["_t", "_i", "user_id"], name="user"))
    kept = ratings.join(users, "user_id")
    per_item = staged(kept.groupBy("item_id").agg(F.min("ts").alias("_t")))
    items = with_position(per_item, ["_t", "item_id"], name="item").select("item_id", "item")
    last = (F.col("ts") == F.col("_lt")) & (F.col("item_id") == F.col("_li"))
    rows = kept.withColumn("split", F.when(last, "eval").otherwise("train")).join(items, "item_id")
    return Prepared(
        staged(rows.select("user", "item", "ts", "split"), "ratings"), users.select("user_id", "user"), items
    )


def user_counts(train: DataFrame) -> DataFrame:
    return train.groupBy("user").agg(F.count(F.lit(1)).alias("positives"))


def negative_tallies(train: DataFrame) -> DataFrame:
    """(user, item, tally): how many non-positive items come before each positive one."""
    ranked = with_position(train.select("user", "item"), ["item"], ["user"], "_rank")
    return ranked.select("user", "item", (F.col("item") - F.col("_rank")).alias("tally"))


def nth_negatives(tallies: DataFrame, draws: DataFrame) -> DataFrame:
    """Item of each draw (user, draw, r): the r-th item that is not a positive of the user.

    That is r plus the number of positives whose tally is at most r. Positives and draws are
    merged in value order and counted along, so a user with very many positives is spread over
    ranges and no negative list is ever built.
    """
    merged = tallies.select(
        "user", F.col("tally").alias("value"), F.lit(0).alias("kind"), F.col("item").alias("draw")
    ).unionByName(
        draws.select("user", F.col("r").alias("value"), F.lit(1).alias("kind"), "draw")
    )
    run = with_running(
        merged, ["value", "kind", "draw"], {"_before": ("sum", F.lit(1) - F.col("kind"))}, ["user"]
    )
    return run.filter("kind = 1").select("user", "draw", (F.col("value") + F.col("_before")).alias("item"))


def negative_intervals(train: DataFrame, num_items: int) -> DataFrame:
    """All (user, item) pairs without a positive, as ranges (user, low, high).

    There is at most one range more than positives, however many items there are; the pairs
    themselves are ``explode(sequence(low, high))``.
    """
    pairs = train.select("user", "item")
    prev = with_neighbour(pairs, ["item"], {"_p": "item"}, ["user"], back=True)
    gaps = prev.select("user", (F.coalesce("_p", F.lit(-1)) + 1).alias("low"), (F.col("item") - 1).alias("high"))
    tail = pairs.groupBy("user").agg(F.max("item").alias("_m")).select(
        "user", (F.col("_m") + 1).alias("low"), F.lit(num_items - 1).cast("bigint").alias("high")
    )
    return gaps.unionByName(tail).filter("low <= high")


def negative_choice(num_items: int, counter: Column, seed: int) -> Column:
    """Uniform index among a user's non-positive items (columns ``user``, ``positives``)."""
    return mix("user", counter, seed) % (F.lit(num_items) - F.col("positives"))


def eval_candidates(
    prepared: Prepared, num_items: int, negatives: int, seed: int, tallies: DataFrame | None = None
) -> DataFrame:
    """(user, slot, item, duplicate): sampled negatives, the held-out item in the last slot.

    Duplicates are marked with the held-out item counted first, so a negative equal to it is
    masked and it is not. A user's list is made in one row beside the user's positives; that of a user with
    more than ``LIST_ITEMS`` of them by ranges (``tallies`` serve these users only).
    """
    counts = user_counts(prepared.train)
    large = staged(counts.filter(F.col("positives") > LIST_ITEMS), "large")
    out = _listed(prepared.rows.join(large, "user", "left_anti"), num_items, negatives, seed)
    if not large.isEmpty():
        only = large.select("user")
        tallies = negative_tallies(prepared.train.join(only, "user", "left_semi")) if tallies is None else tallies.join(only, "user", "left_semi")
        draws = large.select("user", "positives", F.explode(_draws(negatives)).alias("draw"))
        draws = draws.withColumn("r", negative_choice(num_items, F.col("draw"), seed))
        drawn = nth_negatives(staged(tallies), draws.select("user", "draw", "r"))
        truth = prepared.eval.join(only, "user", "left_semi").select("user", F.lit(0).cast("bigint").alias("draw"), "item")
        marked = duplicate_mask(staged(drawn.unionByName(truth), "drawn"), ["user"], "item", "draw")
        out = out.unionByName(marked.select("user", "draw", "item", "duplicate"))
    slot = F.when(F.col("draw") == 0, negatives).when(F.col("draw") == negatives, 0).otherwise(F.col("draw"))
    return out.select("user", slot.cast("int").alias("slot"), "item", "duplicate")


def _draws(negatives: int) -> Column:
    return F.sequence(F.lit(1).cast("bigint"), F.lit(negatives).cast("bigint"))


def _listed(rows: DataFrame, num_items: int, negatives: int, seed: int) -> DataFrame:
    """(user, draw, item, duplicate) of users with few positives: only their positives are shuffled, no draw is."""
    held = F.col("split") == "eval"
    per = rows.groupBy("user").agg(
        F.sort_array(F.collect_list(F.when(F.col("split") == "train", F.col("item")))).alias("items"),
        F.collect_list(F.when(held, F.col("item"))).alias("truths"),
    ).select("user", "items", "truths", mix_base("user", seed).alias("base"))

    def lists(batches):
        for batch in _parts(batches, lambda sizes: np.where(sizes > 0, negatives, 0) + sizes):
            positives, owner, rank, begins, sizes = _flat(batch.column("items"))
            truths, kept, *_ = _flat(batch.column("truths"))
            user = np.repeat(np.flatnonzero(sizes), negatives)  # a user without positives draws nothing
            nth = np.tile(np.arange(1, negatives + 1), np.count_nonzero(sizes))
            r = _remainder(_mixed(batch.column("base").to_numpy()[user], nth), num_items - sizes[user])  # as negative_choice
            item = np.concatenate([truths, r + _before(positives - rank, owner, r, user, num_items, begins)])
            draw = np.concatenate([np.zeros(len(truths), np.int64), nth])
            user = np.concatenate([kept, user])
            order = np.lexsort((draw, item, user))
            again = np.zeros(len(order), bool)
            again[1:] = (user[order][1:] == user[order][:-1]) & (item[order][1:] == item[order][:-1])
            duplicate = np.zeros(len(order), np.int32)
            duplicate[order] = again
            duplicate[: len(truths)] = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("user").take(pa.array(user)), pa.array(draw, pa.int64()), pa.array(item, pa.int64()), pa.array(duplicate, pa.int32())],
                ["user", "draw", "item", "duplicate"],
            )

    return per.mapInArrow(lists, "user bigint, draw bigint, item bigint, duplicate int")


def _parts(batches, rows):
    """Slices of the batches that give about ``PART_ROWS`` rows; ``rows`` gives those of each list of ``items`` from its size."""
    for batch in batches:
        sizes = np.diff(batch.column("items").offsets.to_numpy())
        part = np.cumsum(rows(sizes)) // PART_ROWS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(low, high - low) for low, high in zip(edges[:-1], edges[1:]))


def _flat(column):
    """Values of a list column, the row of each, its place in the row; of each row the first value's number and the size."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    owner, begins = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    return column.flatten().to_numpy(), owner, np.arange(len(owner)) - begins[owner], begins, sizes


def _mixed(base, b):
    """``mix_on`` over numpy arrays."""
    linear = (base + b * 69621) % MODULUS
    return ((linear * linear) % MODULUS * 48271 + linear + 11) % MODULUS


def _remainder(h, n):
    if len(n) and n.min() == 0:
        raise ZeroDivisionError("a user has no item left to draw")
    return np.fmod(h, n)


def _before(tallies, owner, r, user, num_items: int, begins):
    """How many tallies of its user are at most each draw ``r``. Users follow each other: one search places all draws."""
    span = num_items + 1
    held = np.sort(owner * span + np.maximum(tallies, 0), kind="stable")
    return np.searchsorted(held, user * span + r, side="right") - begins[user]


def pad_eval(candidates: DataFrame, num_users: int, users_per_batch: int, negatives: int) -> DataFrame:
    """Adds ``row`` and ``batch_id``, and zero rows that fill up the last batch.

    In a filling row every slot but the last counts as a duplicate, which is how metrics
    recognise it.
    """
    missing = -num_users % users_per_batch
    spark = candidates.sparkSession
    fill = spark.range(num_users, num_users + missing).select(
        F.col("id").alias("row"), F.lit(0).cast("bigint").alias("user"),
        F.explode(F.sequence(F.lit(0), F.lit(negatives))).alias("slot"), F.lit(0).cast("bigint").alias("item"),
    ).withColumn("duplicate", (F.col("slot") != negatives).cast("int"))
    rows = candidates.withColumn("row", F.col("user")).unionByName(fill)
    return rows.withColumn("batch_id", F.floor(F.col("row") / users_per_batch))


def hit_and_gain(
    scored: DataFrame, negatives: int, k: int = TOP_K, row: str = "user", drop_duplicates: bool = False
) -> DataFrame:
    """Per row: rank of the held-out item, hit and gain within the top k, and weight.

    The held-out item loses ties. A row's list has ``negatives + 1`` scores by construction.
    """
    score = F.when((F.col("duplicate") == 1) & F.lit(drop_duplicates), F.lit(float("-inf"))).otherwise(F.col("score"))
    own = F.col("slot") == negatives
    per = scored.groupBy(row).agg(
        F.max(F.when(own, F.col("score"))).alias("_own"),
        F.collect_list(F.when(~own, score)).alias("_others"),
        F.sum("duplicate").alias("_dups"),
    )
    rank = F.size(F.filter("_others", lambda s: s >= F.col("_own")))
    out = per.select(row, rank.alias("rank"), (F.col("_dups") != negatives).cast("int").alias("weight"))
    hit = F.col("rank") < k
    gain = F.when(hit, F.ln(F.lit(2.0)) / F.ln(F.col("rank") + 2.0)).otherwise(0.0)
    return out.select(row, "rank", hit.cast("int").alias("hit"), gain.alias("gain"), "weight")


def hr_ndcg(ranked: DataFrame) -> DataFrame:
    """Weighted mean hit rate and gain."""
    w = F.sum("weight")
    return ranked.agg(
        (F.sum(F.col("hit") * F.col("weight")) / w).alias("hr"),
        (F.sum(F.col("gain") * F.col("weight")) / w).alias("ndcg"), w.alias("users"),
    )


def example_weight(is_positive: Column, train_negatives: int, negatives: int) -> Column:
    """Weight that makes an evaluation list count like a training example."""
    share = F.when(is_positive, 1.0).otherwise(train_negatives / negatives)
    return share * (1 + negatives) / (1 + train_negatives)


def padded_weights(batches: DataFrame, train_negatives: int, negatives: int) -> DataFrame:
    """Rows of :func:`pad_eval` with ``weight``: that of an evaluation list, zero for lists that fill up a batch.

    A filling row has a number of its own but user 0; that of any other list is its user.
    """
    weight = example_weight(F.col("slot") == negatives, train_negatives, negatives)
    return batches.withColumn("weight", F.when(F.col("row") != F.col("user"), 0.0).otherwise(weight))


def train_epoch(
    prepared: Prepared, num_items: int, num_neg: int, batch: int, epoch: int, seed: int,
    tallies: DataFrame | None = None,
) -> DataFrame:
    """One shuffled epoch: each positive once and ``num_neg`` sampled negatives for its user.

    Gives (index, user, item, label, batch_id, pos_in_batch). A positive's number follows from the
    positives of the users before and its place among its user's. The rows of a user are made in one row beside
    the user's positives; those of a user with more than ``LIST_ITEMS`` of them by ranges (``tallies`` serve these
    users only). Indices are dense and their order is an even hash of them, so ranges of it are counted without
    the rows, which are shuffled once.
    """
    counts = staged(user_counts(prepared.train), "counts")
    total = counts.agg(F.sum("positives")).first()[0] or 0
    ends = with_running(counts, ["user"], {"_end": ("sum", F.col("positives"))})
    starts = staged(ends.select("user", "positives", (F.col("_end") - F.col("positives")).alias("base")), "starts")
    large = starts.filter(F.col("positives") > LIST_ITEMS)
    train = prepared.train.select("user", "item")
    few = train if large.isEmpty() else train.join(large, "user", "left_anti")
    both = _epoch_lists(few, starts, total, num_items, num_neg, epoch, seed)
    if few is not train:
        ranked = with_position(train.join(large, "user"), ["item"], ["user"], "_rank")
        rows = staged(ranked.select("user", "item", "positives", (F.col("base") + F.col("_rank")).alias("i"), "_rank"), "large")
        if tallies is None:
            tallies = rows.select("user", "item", (F.col("item") - F.col("_rank")).alias("tally"))
        else:
            tallies = tallies.join(large.select("user"), "user", "left_semi")
        copies = F.sequence(F.lit(1), F.lit(num_neg)) if num_neg > 0 else F.expr("cast(array() as array<int>)")
        wanted = rows.select("*", F.explode(copies).alias("copy")).withColumn("index", F.col("copy") * F.lit(total) + F.col("i"))
        r = mix("index", F.lit(epoch), seed) % (F.lit(num_items) - F.col("positives"))
        negatives = nth_negatives(tallies, wanted.select("user", F.col("index").alias("draw"), r.alias("r")))
        both = both.unionByName(rows.select(F.col("i").alias("index"), "user", "item")).unionByName(
            negatives.select(F.col("draw").alias("index"), "user", "item"))
    spark = prepared.rows.sparkSession
    place = mix("index", F.lit(epoch), seed + 1)
    ranges = RANGES_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(total * (1 + num_neg)).select(F.col("id").alias("index"))
    out = batch_rows(both, batch, [place, "index"], cut=F.floor(place * ranges / MODULUS), like=numbers)
    label = (F.col("index") < F.lit(total)).cast("int")
    return out.select("index", "user", "item", label.alias("label"), "batch_id", "pos_in_batch")


def _epoch_lists(train: DataFrame, starts: DataFrame, total: int, num_items: int, num_neg: int, epoch: int, seed: int) -> DataFrame:
    """(index, user, item) of users with few positives: only their positives are shuffled."""
    per = train.groupBy("user").agg(F.sort_array(F.collect_list("item")).alias("items")).join(starts, "user")
    after = (epoch % MODULUS) * 69621 + (seed % MODULUS) * 16807 + 12345  # what the index is mixed with

    def lists(batches):
        for batch in _parts(batches, lambda sizes: sizes * (1 + num_neg)):
            positives, owner, rank, begins, sizes = _flat(batch.column("items"))
            i = batch.column("base").to_numpy()[owner] + rank
            index = (np.arange(1, num_neg + 1)[:, None] * total + i).ravel()
            user = np.tile(owner, num_neg)
            r = _remainder(_mixed(index % MODULUS * 48271 + after, 0), num_items - sizes[user])
            item = r + _before(positives - rank, owner, r, user, num_items, begins)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i, index]), pa.int64()), batch.column("user").take(pa.array(np.concatenate([owner, user]))), pa.array(np.concatenate([positives, item]), pa.int64())],
                ["index", "user", "item"],
            )

    return per.mapInArrow(lists, "index bigint, user bigint, item bigint")


def pad_last_batch(epoch: DataFrame, batch: int, num_users: int, num_items: int, rows: int | None = None) -> DataFrame:
    """Fill the last batch with spread-out users and items, marked by ``valid = 0``.

    ``rows`` is the number of rows of the epoch where the caller knows it, so that they are not made to be counted.
    """
    rows = epoch.count() if rows is None else rows
    missing = -rows % batch
    fill = epoch.sparkSession.range(missing).select(
        (F.col("id") + rows).alias("index"), (F.col("id") % num_users).alias("user"),
        (F.col("id") % num_items).alias("item"), F.lit(0).alias("label"),
        F.lit(rows // batch).cast("bigint").alias("batch_id"),
        (F.col("id") + rows % batch).alias("pos_in_batch"),
    )
    return epoch.withColumn("valid", F.lit(1)).unionByName(fill.withColumn("valid", F.lit(0)))


def write_epochs(epochs: dict[int, DataFrame], path: str, shards: int = 16) -> None:
    """One folder per cycle and shard; batches are dealt out to shards in turn."""
    for cycle, df in epochs.items():
        out = df.withColumn("shard", (F.col("batch_id") % shards).cast("int"))
        out.repartition("shard", "batch_id").write.partitionBy("shard").parquet(f"{path}/cycle={cycle}")


def write_eval(batches: DataFrame, path: str, shards: int = 16) -> None:
    """The folder ``eval`` beside the cycles: padded evaluation batches, dealt out to shards in turn."""
    out = batches.withColumn("shard", (F.col("batch_id") % shards).cast("int"))
    out.repartition("shard", "batch_id").sortWithinPartitions("shard", "row", "slot").write.partitionBy("shard").parquet(f"{path}/eval")


def ratings_summary(prepared: Prepared, num_neg: int, train_batch: int, eval_batch: int, negatives: int) -> DataFrame:
    """Counts of users, items, positives and batches."""
    n = prepared.rows.agg(
        (F.max("user") + 1).alias("users"), (F.max("item") + 1).alias("items"),
        F.count_if(F.col("split") == "train").alias("train_positives"),
        F.count_if(F.col("split") == "eval").alias("eval_positives"),
    )
    train = F.ceil(F.col("train_positives") * (1 + num_neg) / train_batch)
    evals = F.ceil(F.col("eval_positives") * (1 + negatives) / eval_batch)
    return n.withColumn("train_batches", train).withColumn("eval_batches", evals)
