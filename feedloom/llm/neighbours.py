"""Nearest neighbours by inner product: probed lists, scanned dimension by dimension.

A vector is scaled to length 1 at most and given one more component that makes it exactly 1, queries
are scaled to length 1; then the largest inner product is the smallest distance. A random rotation
spreads every distance evenly over the dimensions, so that the distance over the first ``d`` of ``D``
dimensions, times ``D / d``, estimates the whole one within a known error. Vectors are dealt into
lists by their nearest centre and stored in blocks of bounded size as columns: sixteen rotated
dimensions of all vectors of the block, then the next sixteen, and so on.

A query probes its nearest lists. Within each block it meets all vectors in the first dimensions,
takes the whole distances of the most promising as its limit, and then goes on dimension block by
dimension block; a candidate goes as soon as the hypothesis that it is within the limit is rejected
(its estimate is above ``limit * (1 + SURE / sqrt(d))``). What is left is scored in double precision
on the original vectors.

Copies of a vector are one entry with as many ids as an answer can use, and equal queries are asked
once, so a vector that a third of all rows hold is neither one task's work nor met pair by pair. A
long list is many blocks, short lists share one, and queries are dealt into blocks as well. The centres, the
rotation and the number of probes are learned from a bounded sample (``SAMPLE`` distinct vectors, by
hash, ``SAMPLE_BYTES`` at most); every vector is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import staged

#: Distinct vectors that the centres are learned from, and how many bytes of them at most.
SAMPLE, SAMPLE_BYTES = 1 << 15, 1 << 25
#: Lists at most; else as many as the square root of the number of distinct vectors.
LISTS = 4096
#: Share of true neighbours of the sample that the probed lists must hold.
TARGET = 0.97
#: How sure a candidate's distance must be above the limit before it goes, in standard deviations.
SURE = 2.1
#: Rotated bytes of a block of vectors, queries of a block, places of the ids of one vector.
BLOCK_BYTES, QUERIES, SALTS = 1 << 20, 512, 32
_SLACK = 1e-5
_PROBE = pa.schema([("shard", pa.int32()), ("parts", pa.int32()), ("qid", pa.int64()), ("q", pa.binary()), ("x", pa.binary()), ("wanted", pa.list_(pa.int32()))])


def _finite(name: str) -> Column:
    """Whether all components are finite numbers."""
    return F.forall(name, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v, h1, h2`` of the rows that take part; ``h1, h2`` are 128 bits that stand for the vector."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(_finite("v")).filter(F.exists("v", lambda x: x != 0))
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(17), F.col("v")).alias("h2"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``node, v, ids``: every distinct vector once with its ``most`` smallest ids; ``node`` is the smallest."""
    key = ["h1", "h2"]
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    first = Window.partitionBy(*key, "salt").orderBy("id")
    part = rows.select(*key, "id").distinct().withColumn("salt", salt).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most)
    final = Window.partitionBy(*key).orderBy("id")
    ids = part.select(*key, "id").withColumn("k", F.row_number().over(final)).filter(F.col("k") <= most)
    ids = ids.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows.groupBy(*key).agg(F.first("v").alias("v")).join(ids, key).select(F.col("ids")[0].alias("node"), "v", "ids")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of a matrix; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _placed(x: np.ndarray, model: dict, query: bool) -> np.ndarray:
    """Vectors on the unit sphere of one more dimension, rotated."""
    x = x / model["scale"]
    norm = np.sqrt((x * x).sum(axis=1))
    if query:
        x, last = x / np.maximum(norm, 1e-300)[:, None], np.zeros(len(x))
    else:
        x, last = x / model["longest"], np.sqrt(np.maximum(0.0, 1.0 - (norm / model["longest"]) ** 2))
    return (np.column_stack([x, last]) @ model["rotation"]).astype(np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *[_distances(x[k : k + 4096], centres).argmin(axis=1) for k in range(0, len(x), 4096)]])


def learn(nodes: DataFrame, neighbours: int, seed: int = 7) -> dict | None:
    """The model as plain arrays and numbers, or None for no vectors: what tasks need to place and probe."""
    shape = nodes.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count(F.lit(1))).first()
    if not shape[2]:
        return None
    width, scale, count = int(shape[0]), float(shape[1]), int(shape[2])
    longest = nodes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))).first()[0] ** 0.5
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0]
    model = {"width": width, "scale": scale, "longest": longest, "rotation": rotation}
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (width + 1))))
    some = nodes.select("v").orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(rows).toArrow()
    original = _matrix(some.column("v"), width)
    x = _placed(original, model, query=False).astype(np.float64)
    lists = max(1, min(LISTS, round(math.sqrt(count)), len(x) // 8))
    centres = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(8):
        own = _nearest_centre(x, centres)
        size = np.bincount(own, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), size=lists)])
    own = _nearest_centre(x, centres)
    # probes: how far down a query's order of lists its true neighbours in the sample lie
    asked = rng.permutation(len(x))[:256]
    true = original[asked] / scale @ (original / scale).T
    true[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-true, axis=1)[:, : min(neighbours, len(x) - 1)]
    order = np.argsort(_distances(_placed(original[asked], model, query=True).astype(np.float64), centres), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(lists), order.shape), axis=1)
    depth = np.take_along_axis(place, own[near], axis=1) if near.size else np.zeros((1, 1))
    return model | {"centres": centres, "probes": int(np.quantile(depth, TARGET)) + 1}


def _column_blocks(width: int) -> list[tuple[int, int]]:
    """Where blocks of sixteen dimensions begin and end; at most sixteen of them, wider for long vectors."""
    step = max(16, -(-width // 16))
    return [(k, min(k + step, width)) for k in range(0, width, step)]


def layout(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each list and how many blocks its shard has: small lists share a block, long ones have several."""
    shard, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    now, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > rows:
            now, held = now + 1, 0
        shard[k], parts[k] = now, max(1, -(-int(n) // rows))
        held += int(n)
    return shard, parts


def build(nodes: DataFrame, model: dict) -> tuple[DataFrame, dict]:
    """The index, one row per block, and the model with its layout.

    A row has ``shard, part, lists, starts`` (where each list of the block begins), ``nodes, ids,
    original`` and ``columns``.
    """
    width = model["width"]
    shared = nodes.sparkSession.sparkContext.broadcast(model)

    def place(batches):
        known = shared.value
        for batch in batches:
            x = _placed(_matrix(batch.column("v"), known["width"]), known, query=False)
            own = _nearest_centre(x.astype(np.float64), known["centres"])
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], ["list", *batch.schema.names])

    placed = staged(nodes.select("node", "v", "ids").mapInArrow(place, "list int, node bigint, v array<double>, ids array<bigint>"), "placed")
    found = placed.groupBy("list").count().toArrow()  # at most LISTS rows
    sizes = np.zeros(len(model["centres"]), dtype=np.int64)
    sizes[found.column("list").to_numpy()] = found.column("count").to_numpy()
    model = model | dict(zip(("shard", "parts"), layout(sizes, max(64, BLOCK_BYTES // (4 * (width + 1)))), strict=True))
    laid = nodes.sparkSession.sparkContext.broadcast(model)

    def deal(batches):
        known = laid.value
        for batch in batches:
            own = batch.column("list").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(known[c][own].astype(np.int32)) for c in ("shard", "parts")] + batch.columns, ["shard", "parts", *batch.schema.names])

    dealt = placed.mapInArrow(deal, "shard int, parts int, list int, node bigint, v array<double>, ids array<bigint>")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        known = shared.value
        table = table.sort_by("list")
        own = table.column("list").to_numpy()
        lists, starts = np.unique(own, return_index=True)
        original = _matrix(table.column("v"), known["width"])
        x = _placed(original, known, query=False)
        return pa.table({
            **{c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("shard", "part")},
            "lists": pa.array([lists.tolist()], pa.list_(pa.int32())), "starts": pa.array([[*starts.tolist(), len(own)]], pa.list_(pa.int32())),
            "nodes": pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())),
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "original": [original.tobytes()], "columns": [[np.ascontiguousarray(x[:, a:b].T).tobytes() for a, b in _column_blocks(x.shape[1])]]})

    ddl = "shard int, part int, lists array<int>, starts array<int>, nodes array<bigint>, ids array<array<bigint>>, original binary, columns array<binary>"
    return dealt.groupBy("shard", "part").applyInArrow(pack, ddl), model


def scan_list(columns: list[np.ndarray], asked: np.ndarray, keep: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among a query's ``keep`` nearest, and the queries' limits after this list.

    ``columns`` hold some dimensions of all vectors each, a dimension a row; ``asked`` a query a row;
    ``limit`` the distances up to which vectors are still of use.
    """
    count, width = columns[0].shape[1], asked.shape[1]
    spans = np.cumsum([0, *[c.shape[0] for c in columns]])
    part = asked[:, : spans[1]]
    seen = np.maximum((part * part).sum(axis=1)[:, None] + (columns[0] ** 2).sum(axis=0)[None, :] - 2.0 * (part @ columns[0]), 0.0)
    if count > keep:
        some = min(4 * keep, count)
        best = np.argpartition(seen, some - 1, axis=1)[:, :some]
        whole = np.zeros(best.shape, dtype=np.float32)
        for c, a in zip(columns, spans, strict=False):
            for k in range(c.shape[0]):
                whole += (asked[:, a + k, None] - c[k][best]) ** 2
        limit = np.minimum(limit, np.partition(whole, keep - 1, axis=1)[:, keep - 1])

    def bound(d: int) -> np.ndarray:
        return limit * (1.0 + SURE / math.sqrt(d)) ** 2 * (d / width) + _SLACK if d < width else limit + _SLACK

    query, vector = np.nonzero(seen <= bound(int(spans[1]))[:, None])
    total = seen[query, vector]
    for c, a, b in zip(columns[1:], spans[1:], spans[2:], strict=False):
        for k in range(c.shape[0]):
            total += (asked[query, a + k] - c[k][vector]) ** 2
        live = total <= bound(int(b))[query]
        query, vector, total = query[live], vector[live], total[live]
    order = np.lexsort((total, query))
    query, vector, total = query[order], vector[order], total[order]
    last = np.searchsorted(query, np.arange(len(asked))) + keep - 1  # where a query's last useful vector would stand
    there = np.flatnonzero(last < np.searchsorted(query, np.arange(len(asked)), side="right"))
    limit = limit.copy()
    limit[there] = np.minimum(limit[there], total[last[there]])
    close = total <= limit[query] + _SLACK
    return query[close], vector[close], limit


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed on its own in the same way, so equal rows give equal products."""
    step = max(1, (1 << 21) // max(a.shape[1], 1))
    return np.concatenate([np.zeros(0), *[(a[i[k : k + step]] * b[j[k : k + step]]).sum(axis=1) for k in range(0, len(i), step)]])


def search(asked: DataFrame, index: DataFrame, model: dict, keep: int) -> DataFrame:
    """``qid, best``: for every ``qid, v`` the ``keep`` nearest found, as ``k, score, id`` in order.

    Ids that share a vector are told apart here; ties go to the smaller id. A query goes once to
    every block of the shards that hold its lists.
    """
    shared = asked.sparkSession.sparkContext.broadcast(model)

    def probe(batches):
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                original = _matrix(some.column("v"), known["width"])
                x = _placed(original, known, query=True)
                far, probes = _distances(x.astype(np.float64), known["centres"]), known["probes"]
                lists = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < far.shape[1] else np.broadcast_to(np.arange(far.shape[1]), far.shape)
                rows = []
                for k, qid in enumerate(some.column("qid").to_pylist()):
                    own = np.sort(lists[k])
                    shards, starts = np.unique(known["shard"][own], return_index=True)
                    for shard, mine in zip(shards.tolist(), np.split(own, starts[1:]), strict=True):
                        rows.append((shard, int(known["parts"][mine[0]]), qid, original[k].tobytes(), x[k].tobytes(), mine.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PROBE.types, strict=True)], schema=_PROBE)

    probes = staged(asked.select("qid", "v").mapInArrow(probe, "shard int, parts int, qid bigint, q binary, x binary, wanted array<int>"), "probes")
    groups = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups"))  # at most LISTS rows
    left = index.join(F.broadcast(groups), "shard").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = probes.join(F.broadcast(groups), "shard").withColumn("grp", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["shard", "part", "grp"]

    def scan(block: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = {"qid": pa.int64(), "score": pa.float64(), "ids": pa.list_(pa.int64())}
        if not block.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        width = shared.value["width"]
        lists, starts, nodes, ids = (block.column(c)[0].as_py() for c in ("lists", "starts", "nodes", "ids"))
        nodes = np.array(nodes, dtype=np.int64)
        columns = [np.frombuffer(c, dtype=np.float32).reshape(-1, len(nodes)) for c in block.column("columns")[0].as_py()]
        original = np.frombuffer(block.column("original")[0].as_py(), dtype=np.float64).reshape(len(nodes), width)
        q = np.frombuffer(b"".join(rows.column("q").to_pylist()), dtype=np.float64).reshape(rows.num_rows, width)
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(rows.num_rows, width + 1)
        wanted = rows.column("wanted").combine_chunks()
        flat, owner = wanted.flatten().to_numpy(), np.repeat(np.arange(len(x)), np.diff(wanted.offsets.to_numpy()))
        limit, pairs = np.full(len(x), np.inf, dtype=np.float32), []
        for name, a, b in zip(lists, starts, starts[1:], strict=False):
            own = owner[flat == name]
            if len(own):
                i, j, limit[own] = scan_list([c[:, a:b] for c in columns], x[own], keep, limit[own])
                pairs.append((own[i], j + a))
        i, j = (np.concatenate([np.zeros(0, dtype=np.int64), *[p[k] for p in pairs]]) for k in (0, 1))
        score = _products(q, original, i, j)
        order = np.lexsort((nodes[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < keep
        i, j, score = i[first], j[first], score[first]
        qid = rows.column("qid").to_numpy()
        return pa.table({"qid": pa.array(qid[i], kinds["qid"]), "score": pa.array(score, kinds["score"]), "ids": pa.array([ids[k] for k in j], kinds["ids"])})

    found = left.select(*key, "lists", "starts", "nodes", "ids", "original", "columns").groupBy(*key).cogroup(
        right.select(*key, "qid", "q", "x", "wanted").groupBy(*key)).applyInArrow(scan, "qid bigint, score double, ids array<bigint>")
    near = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0])
    close = found.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= keep).select("qid", "score", F.explode("ids").alias("id"))
    final = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = close.withColumn("k", F.row_number().over(final)).filter(F.col("k") <= keep)
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", "score", "id"))).alias("best"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` the ``top`` nearest rows found.

    Nearness is the inner product, in double precision; ties go to the smaller id. All rows but those
    with the query's own id are candidates; with fewer than ``top`` all of them are returned. Rows
    whose id or vector is null, whose vector is empty, all zero or holds a null, NaN or infinite
    component take no part. A vector shorter than the longest one counts as filled up with zeros. A
    row repeated with its id counts once; different vectors under one id are rows and queries of
    their own (an id with ``m`` vectors may get up to ``m - 1`` answers fewer, as none is its own id). Vectors of any length are handled, a block holds fewer of them. Other columns are not
    read. An empty table gives an empty result.

    Answers are approximate: the number of probed lists is chosen so that they hold ``TARGET`` of
    the true neighbours within the sample, and a candidate may go wrongly with the small chance that
    ``SURE`` leaves.
    """
    rows = usable(vectors, id_col, vec_col)
    nodes = staged(distinct_vectors(rows, top + 1), "vectors")
    model = learn(nodes, top)
    ddl = "query_id bigint, rank int, vec_id bigint, score double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], ddl)
    asking = rows.filter(F.col("id") % every == 0)
    asked = staged(asking.groupBy("h1", "h2").agg(F.first("v").alias("v")).withColumn("qid", F.monotonically_increasing_id()), "asked")
    index, model = build(nodes, model)
    found = search(asked, staged(index, "index"), model, top + 1).join(asked.select("h1", "h2", "qid"), "qid")
    spread = found.select("h1", "h2", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = asking.select("id", "h1", "h2").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    answers = own.join(spread, ["h1", "h2", "salt"]).select("id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, top).alias("best"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))

