"""Near duplicates by min-max hashing: two signature values from every hash evaluation.

A document is its set of shingles (four words, or as many as asked for). Under each of ``HASHES`` hash functions both the
smallest and the largest hashed shingle are kept; either agrees between two sets with a chance equal
to their similarity, so ``2 * HASHES`` values cost ``HASHES`` evaluations. The first
``BANDS`` bands of four values find candidates; whole signatures drop the hopeless ones; links are confirmed on full sets.

No group is paired out. Equal sets are one node. In a bucket every node is first tried against one
hub; buckets that then still hold several components get a second hub, and only those that are open
after it are searched further, in blocks of bounded size, for pairs of different components that the
signatures hold possible. Members with such a partner bring their full sets to the block, where links
are confirmed and join components, so that only links that connect something leave it. Every pair of
a bucket is thus confirmed, ruled out or known to be connected, and no table of pairs is written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fresh, runs, staged, text_udf
from feedloom.llm.graph import components

SHINGLE, SIMILARITY = 4, 80  # words; per cent of the union
HASHES, ROWS, BANDS = 256, 4, 32
VALUES = 2 * HASHES
#: The values of the bands are kept in 16 bits, the others, which only measure, in 8.
WIDE = BANDS * ROWS
SIG_BYTES = WIDE + VALUES
#: Bits of the filters that pick rows ahead of a shuffle: eight for each key, this many at least and
#: at most; the driver and every task hold that much.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Members of a block, and shingles of all its sets together, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit word hashes, remembered while a task works."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes, known: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes; fewer words than ``size`` are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mixed(out * _M2 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Signer:
    """Signatures of many sets at a time."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.turn = rng.integers(1, 2**63, size=HASHES, dtype=np.uint64)
        self.factor = rng.integers(1, 2**63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """``SIG_BYTES`` for each set: all values, minima and maxima by turns; no set is empty.

        A band holds two minima and two maxima, all of different functions.
        """
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), VALUES), dtype=np.uint64)
        work = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat ^ self.turn[k], self.factor[k], out=work)
            out[:, 2 * k] = np.minimum.reduceat(work, starts)
            out[:, (2 * k + 5) % VALUES] = np.maximum.reduceat(work, starts)
        top = (_mixed(out) >> np.uint64(48)).astype(np.uint16)
        return np.column_stack([np.ascontiguousarray(top[:, :WIDE]).view(np.uint8), top[:, WIDE:].astype(np.uint8)])


def _parts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The wide and the narrow values of many signatures."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SIG_BYTES)
    return np.ascontiguousarray(raw[:, : 2 * WIDE]).view(np.uint16), raw[:, 2 * WIDE :]


NODE_DDL = "doc_id bigint, n bigint, f1 bigint, f2 bigint, sig binary"


def signed(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, sha: bool = False) -> DataFrame:
    """Each document's set size, a 128-bit digest of its set, its signature (null for an empty set) and, if asked for, its text's sha256."""

    def work(batches):
        known, signer = _Words(), Signer()
        for batch in batches:
            for at, data in runs(batch.column(1)):
                sets = [shingle_set(t, known, size) for t in data]
                full = [i for i, s in enumerate(sets) if len(s)]
                rows: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signer.signatures([sets[i] for i in full]), strict=True):
                        rows[i] = row.tobytes()
                digests = [(int(s.sum(dtype=np.uint64).view(np.int64)), int(_mixed(s ^ _M1).sum(dtype=np.uint64).view(np.int64))) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(data)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(rows, pa.binary()),
                    *[c.slice(at, len(data)) for c in batch.columns[2:]],
                ], ["doc_id", "n", "f1", "f2", "sig", *batch.schema.names[2:]])

    extra = [F.sha2(F.col(text_col), 256).alias("sha")] if sha else []
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"), *extra)
    return source.mapInArrow(work, NODE_DDL + (", sha string" if sha else ""))


def possible(percent: int) -> int:
    """Equal values, of ``VALUES``, that a pair needs to be confirmed on full sets.

    The largest number that loses no more pairs of just the similarity asked for than the bands
    lose, nor more than one in ten million (binomial tail); pairs above it are lost less often.
    """
    p = percent / 100
    most, lost = min((1 - p**ROWS) ** BANDS, 1e-7), 0.0
    for k in range(VALUES):
        lost += math.comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k)
        if lost > most:
            return k
    return VALUES


def _agreement(a: Column, b: Column) -> Column:
    """How many signature values agree."""

    def make():
        def work(x, y):
            (wide, narrow), (wide2, narrow2) = _parts(x), _parts(y)
            return pa.array(((wide == wide2).sum(axis=1) + (narrow == narrow2).sum(axis=1)).astype(np.int32))

        return work

    return text_udf(make, "int")(a, b)


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _bits(keys: DataFrame) -> int:
    """The size of a filter over a written table of keys."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys.count()).bit_length()))


def _spot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _cells(keys: DataFrame, bits: int) -> DataFrame:
    """The only column of ``keys`` as a filter: words ``w`` of 64 bits ``b``, at most ``bits / 64`` rows."""
    return keys.select(_spot(F.col(keys.columns[0]), bits).alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))


def _perhaps(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """All rows whose ``column`` is among the written ``keys``, and a few others, without moving any.

    The filter that is broadcast has a bounded size. A full one lets more through, which costs time
    and changes nothing, as an exact join follows.
    """
    bits = _bits(keys)
    met = rows.withColumn("s", _spot(F.col(column), bits)).join(F.broadcast(_cells(keys, bits)), F.expr("s div 64 = w"))
    return met.filter("(shiftright(b, cast(s % 64 as int)) & 1L) = 1L").select(*rows.columns)


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``g, s``: the full sets of the nodes ``g`` that are wanted.

    Texts are not moved: a filter of bounded size over the ids of wanted nodes picks those that are
    read again into sets, and the sets it lets through meet their nodes. A full filter lets more
    through, which costs time and changes nothing.
    """
    wanted = staged(wanted.distinct().join(nodes.select("g", "top", "n", "f1", "f2"), "g"), "wanted")
    bits = _bits(wanted)
    cells = _cells(wanted.select("top"), bits).toArrow()
    mask = np.zeros(bits // 64, dtype=np.int64)
    mask[cells.column("w").to_numpy()] = cells.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(mask.view(np.uint64))
    own, taken = fresh("__id", docs.columns), fresh("__text", docs.columns)
    source = docs.select(F.col(id_col).cast("bigint").alias(own), F.col(text_col).alias(taken)).select(_spot(F.col(own), bits).alias("s"), taken)

    def sets(batches):
        known, mask = _Words(), shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            may = (mask[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            for _, data in runs(batch.column(1).filter(pa.array(may))):
                found = [s for s in (shingle_set(t, known, size) for t in data) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(s) for s in found], pa.int64()), pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64()),
                    pa.array([int(_mixed(s ^ _M1).sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()),
                ], ["n", "f1", "f2", "s"])

    read = source.mapInArrow(sets, "n bigint, f1 bigint, f2 bigint, s binary").join(wanted.drop("top"), ["n", "f1", "f2"])
    return staged(read.select("g", "s").dropDuplicates(["g"]), "sets")


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two full sets are similar enough."""
    both = int(np.isin(s, t, assume_unique=True).sum()) if len(s) * len(t) < 64 else len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """The ``a, b`` pairs whose full sets are similar enough."""
    full = _full_sets(pairs.select(F.col("a").alias("g")).unionByName(pairs.select(F.col("b").alias("g"))), nodes, docs, id_col, text_col, size)

    def make():
        def work(x, y):
            sets = [[np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in c] for c in (x, y)]
            return pa.array([_similar(s, t, percent) for s, t in zip(*sets, strict=True)], pa.bool_())

        return work

    joined = pairs.join(full.select(F.col("g").alias("a"), F.col("s").alias("s1")), "a").join(full.select(F.col("g").alias("b"), F.col("s").alias("s2")), "b")
    return joined.select("a", "b", text_udf(make, "boolean")(F.col("s1"), F.col("s2")).alias("same")).filter("same").select("a", "b")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct ``a > b`` pairs that sizes and signatures do not rule out."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    side = [nodes.select(F.col("g").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab"]
    sized = pairs.join(side[0], "a").join(side[1], "b").filter(_sizes_allow("na", "nb", percent))
    return sized.select("a", "b", _agreement(F.col("sa"), F.col("sb")).alias("same")).filter(F.col("same") >= possible(percent)).select("a", "b")


def _hubs(members: DataFrame) -> DataFrame:
    """Every member of a bucket with its hub: the one that shares most with others over all bands.

    Copies of a document resemble it more than each other, so it meets more of them in more buckets.
    """
    hub = members.groupBy("bucket").agg(F.max(F.struct("weight", "g"))["g"].alias("hub"))
    return members.join(hub, "bucket").filter("g <> hub").select(F.col("g").alias("a"), F.col("hub").alias("b"))


def _open_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and the buckets with several: size, commonest component and its size."""
    known = members.join(labels.select(F.col("node").alias("g"), "component"), "g", "left").withColumn("component", F.coalesce("component", "g"))
    shares = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    buckets = shares.groupBy("bucket").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.sum("m").alias("k"), F.max("m").alias("m"))
    return known, buckets.filter("k > m")


def _second_hubs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """In buckets with several components, all members against the most central one outside the commonest."""
    known, buckets = _open_buckets(members, labels)
    inside = staged(known.join(buckets.select("bucket", "main"), "bucket"), "open")
    hub = inside.filter("component <> main").groupBy("bucket").agg(F.max(F.struct("weight", "g", "component")).alias("h"))
    met = inside.join(hub, "bucket").filter(F.col("component") != F.col("h.component"))
    return met.select(F.col("g").alias("a"), F.col("h.g").alias("b"))


def _blocks(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of open buckets in blocks ``bucket, i, j`` that together hold all pairs still to be met.

    A bucket's commonest component needs no search within itself: the others, in blocks, meet
    all members, in blocks. A block is bounded by its members and by their shingles, so a bucket of
    any size is many small tasks.
    """
    known, buckets = _open_buckets(members, labels)
    other = F.col("component") != F.col("main")
    inside = known.join(buckets.select("bucket", "main"), "bucket")
    load = inside.groupBy("bucket").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("all_blocks"),
        F.greatest(F.ceil(F.count_if(other) / BLOCK), F.ceil(F.sum(F.when(other, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).alias("other_blocks"))
    inside = inside.drop("n").join(load, "bucket").join(nodes.select("g", "n", "sig"), "g")
    spot = F.xxhash64("g", "bucket")
    every = inside.select("bucket", "g", "component", "n", "sig", F.lit(False).alias("other"),
                          F.pmod(spot, F.col("all_blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("j"))
    others = inside.filter(other).select("bucket", "g", "component", "n", "sig", F.lit(True).alias("other"),
                                         F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("i"), F.pmod(spot, F.col("other_blocks")).alias("j"))
    return every.unionByName(others)


def _candidates(block: pa.Table, percent: int, least: int) -> list[tuple[int, np.ndarray]]:
    """Rows of the block's ``other`` side, each with the rows of the whole side that it may be linked with."""
    if not block.num_rows:
        return []
    other = np.asarray(block.column("other").to_numpy(zero_copy_only=False), dtype=bool)
    c, n = (block.column(x).to_numpy() for x in ("component", "n"))
    wide, narrow = _parts(block.column("sig"))
    one, two = np.flatnonzero(other), np.flatnonzero(~other)
    bands = wide.view(np.uint64)  # a band is four values of 16 bits
    here = block.column("bucket")[0].as_py() % BANDS
    out = []
    for i in one:
        fit = two[(c[two] != c[i]) & (np.minimum(n[two], n[i]) * 100 >= np.maximum(n[two], n[i]) * percent)]
        fit = fit[(bands[fit] == bands[i]).argmax(axis=1) == here]  # a pair counts in its first band
        fit = fit[(wide[fit] == wide[i]).sum(axis=1) + (narrow[fit] == narrow[i]).sum(axis=1) >= least]
        if len(fit):
            out.append((int(i), fit))
    return out


def _rest(members: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """``a, b`` links between different components of a bucket, as many as connect them.

    First each block names its members with a possible partner; they alone come again with their
    full sets. There pairs are confirmed, and a link joins its components at once, so pairs that
    became connected are passed over and a block gives fewer links than it has members.
    """
    least = possible(percent)
    columns = "bucket bigint, i bigint, j bigint, g bigint, component bigint, n bigint, other boolean, sig binary"

    def name(block: pa.Table) -> pa.Table:
        found = _candidates(block, percent, least)
        return block.take(np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[np.append(fit, i) for i, fit in found]])))

    blocks = _blocks(members, nodes, labels).select(*[x.split()[0] for x in columns.split(", ")])
    named = staged(blocks.groupBy("bucket", "i", "j").applyInArrow(name, columns), "named")
    full = _full_sets(named.select("g"), nodes, docs, id_col, text_col, size)

    def confirm(block: pa.Table) -> pa.Table:
        g, component = block.column("g").to_numpy(), block.column("component").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in block.column("s").to_pylist()]
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        a, b = [], []
        for i, fit in _candidates(block, percent, least):
            for k in fit.tolist():
                x, y = top(component[i]), top(component[k])
                if x != y and _similar(sets[i], sets[k], percent):
                    above[x] = y
                    a.append(max(g[i], g[k]))
                    b.append(min(g[i], g[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return named.join(full, "g").groupBy("bucket", "i", "j").applyInArrow(confirm, "a bigint, b bigint").distinct()


def _answers(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int, sha: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n``, the set's ``component`` and its smallest id, ``links`` and the text's ``sha`` if asked for."""
    base = staged(signed(docs, id_col, text_col, size, sha), "signed")
    nodes = staged(base.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("top"), F.first("sig").alias("sig"))
                   .withColumn("g", F.monotonically_increasing_id()), "nodes")
    keys = [F.xxhash64(F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS)).bitwiseAND(-BANDS).bitwiseOR(b) for b in range(BANDS)]
    rows = nodes.select("g", "n", F.explode(F.array(*keys)).alias("bucket"))
    sizes = staged(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "buckets")
    members = staged(_perhaps(rows, "bucket", sizes.select("bucket")).join(sizes, "bucket"), "members")
    central = members.groupBy("g").agg(F.sum("k").alias("weight"))
    members = staged(members.drop("k").join(central, "g"), "members")
    met = staged(_perhaps(nodes, "g", members.select("g")), "met")
    pairs = staged(_possible(_hubs(members), met, percent), "pairs")
    links = staged(_linked(pairs, met, docs, id_col, text_col, percent, size), "links")
    more = _possible(_second_hubs(members, components(links)), met, percent).join(pairs, ["a", "b"], "left_anti")
    links = staged(links.unionByName(_linked(staged(more, "pairs"), met, docs, id_col, text_col, percent, size)), "links")
    links = staged(links.unionByName(_rest(members, met, components(links), docs, id_col, text_col, percent, size)).distinct(), "links")
    found = components(links)
    degree = links.select(F.col("a").alias("g")).unionByName(links.select(F.col("b").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("links"))
    named = nodes.select("g", "n", "f1", "f2", "top").join(found.withColumnRenamed("node", "g"), "g", "left").join(degree, "g", "left")
    named = staged(named.withColumn("component", F.coalesce("component", "g")), "named")
    least = named.groupBy("component").agg(F.min("top").alias("component_id"))
    answer = named.join(least, "component").select("n", "f1", "f2", "component", "component_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return base.drop("sig").join(answer, ["n", "f1", "f2"], "left")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, links``.

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of
    shingles of ``size`` words;
    ``component_id`` is the smallest id reachable, ``kept`` marks that document, ``links`` counts the
    other sets that a document's set was confirmed against (not its copies, nor sets that others had
    connected already). Null and empty texts have no
    shingles, are linked with nothing and stay. Ties take the smallest id; rows repeated with an id
    in a group are all marked, and so are null ids in a group without any other (:func:`drop_near`
    keeps one of them); null ids come after all others. Other columns are
    not read; an empty table gives an empty result. Shingles are compared by 64-bit hashes.
    """
    out = _answers(docs, id_col, text_col, percent, size, sha=False)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all columns stay.

    The row with the smallest id stays, a null id after all others; of different texts under that id
    the one with the smallest sha256, of equal texts the one with the smallest other columns. Rows
    with null and empty texts are in no group and all stay, and so do different texts that share an
    id or have none.
    """
    names = [fresh(x, docs.columns) for x in ("__none", "__id", "__sha")]
    ident, text = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    # without nulls, so that the join and the aggregate deal rows out by the same columns
    keys = [ident.isNull(), F.coalesce(ident, F.lit(0).cast("bigint")), F.sha2(text, 256)]
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.withColumns(dict(zip(names, keys, strict=True)))

    own = fresh("__key", docs.columns)
    answers = _answers(docs.filter(worded), id_col, text_col, percent, size)
    first = answers.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("k"))
    kept = first.select(F.col("k.none").alias(names[0]), F.coalesce("k.doc_id", F.lit(0).cast("bigint")).alias(names[1]), F.col("k.sha").alias(names[2]))

    # rows of one id and text become one ahead of the shuffle, so no key is hot
    rank = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    single = rows.filter(worded).groupBy(*names).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias(own))
    grouped = single.join(kept, names, "left_semi").select(*[F.col(own)[c].alias(c) for c in docs.columns])
    return grouped.unionByName(docs.filter(~worded))
