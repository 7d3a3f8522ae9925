"""A Merkle manifest of a table, with proofs found by a butterfly exchange.

Rows are leaves; the leaves of a group, in order of their key, are hashed up in runs of ``fanout`` to
the group's subroot, and the subroots, in order of their group, likewise to one root. H is the
lower-case hex SHA-256 of its inputs' hex texts, one after the other.

Leaves are dealt into aligned blocks of ``fanout ** k`` consecutive ones, each small enough for one
task, which hashes its own subtree. Then blocks exchange roots round by round: in round ``r`` the
blocks whose numbers differ only in digit ``r`` (base ``fanout``) hand each other the roots of the
subtrees they stand in, and each hashes the common ancestor for itself. After the last round every
block holds all siblings on its way to the root, and no pass goes back down. A group of the exchange
has at most ``fanout`` members; a last, shorter subtree has too few blocks to serve every partner, so
its blocks serve several each. Rounds are logarithmic in the number of blocks and only move digests.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import staged

#: A block has at most this many leaves.
BLOCK = 1024
#: Places that the blocks of one group are dealt over when they meet the group's way to the root.
SALTS = 64
PROOF = "array<struct<place:int,others:array<string>>>"
_LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*columns: Column) -> Column:
    """H over the columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(proof, leaf, lambda now, step: F.sha2(F.concat(
        F.array_join(F.slice(step["others"], F.lit(1), step["place"]), ""), now,
        F.array_join(F.slice(step["others"], step["place"] + 1, F.size(step["others"])), "")), 256))


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, most: int) -> list[list[str]]:
    """The leaves, then each level above, ``most`` of them."""
    out = [leaves]
    for _ in range(most):
        now = out[-1]
        out.append([_h(now[k : k + fanout]) for k in range(0, len(now), fanout)])
    return out


def _height(n: int, fanout: int, most: int) -> int:
    """How many levels ``n`` nodes are hashed up, at most ``most``."""
    height = 0
    while n > 1 and height < most:
        n, height = -(-n // fanout), height + 1
    return height


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``grp, none, key, leaf, carried``) with ``pos`` in its group and the group's ``n``; null keys first.

    Equal rows stand in the order in which they were written. Ranges of rows are ordered each on its
    own; the small table of range sizes gives their offsets.
    """
    order = ["grp", "key", "leaf", "carried", "tie"]
    source = staged(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    sized = source.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def count(batches):
        last, at = None, 0
        for batch in batches:
            out = []
            for grp in batch.column("grp").to_pylist():
                at = at + 1 if grp == last else 0
                last = grp
                out.append(at)
            yield batch.append_column("at", pa.array(out, pa.int64()))

    ddl = f"grp string, key {dict(source.dtypes)['key']}, leaf string, carried string, tie bigint, part int, at bigint"
    ranged = staged(sized.select("grp", "key", "leaf", "carried", "tie", "part").mapInArrow(count, ddl), "ranged")
    sizes = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("m"))
    window = Window.partitionBy("grp").orderBy("part")
    starts = sizes.select("grp", "part", (F.sum("m").over(window) - F.col("m")).alias("start"), F.sum("m").over(Window.partitionBy("grp")).alias("n"))
    return ranged.join(starts, ["grp", "part"]).select("grp", "key", "leaf", "carried", (F.col("start") + F.col("at")).alias("pos"), "n")


def _blocks(numbered: DataFrame, fanout: int, height: int) -> DataFrame:
    """One row per block of ``fanout ** height`` leaves: ``grp, block, blocks, n, keys, leaves, carried, root``."""
    size = fanout**height
    key = dict(numbered.dtypes)["key"]

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves, n = table.column("leaf").to_pylist(), table.column("n")[0].as_py()
        root = _levels(leaves, fanout, _height(n, fanout, height))[-1][0]
        lists = {c: pa.array([table.column(c).to_pylist()], pa.list_(table.column(c).type)) for c in ("key", "carried")}
        return pa.table({
            "grp": [table.column("grp")[0].as_py()], "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "blocks": pa.array([-(-n // size)], pa.int64()), "n": pa.array([n], pa.int64()),
            "keys": lists["key"], "leaves": [leaves], "carried": lists["carried"], "root": [root]})

    ddl = f"grp string, block bigint, blocks bigint, n bigint, keys array<{key}>, leaves array<string>, carried array<string>, root string"
    return numbered.withColumn("block", F.expr(f"pos div {size}")).groupBy("grp", "block").applyInArrow(build, ddl)


def _exchange(blocks: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The butterfly: ``grp, block, up`` (the proof above each block) and ``grp, root``."""
    state = blocks.select("grp", "block", "blocks", F.col("root").alias("now"))
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    roots, steps, width = [], [], 1
    while True:
        roots.append(state.filter((F.col("blocks") <= width) & (F.col("block") == 0)).select("grp", F.col("now").alias("root")))
        if most <= width:
            break
        live = state.filter(F.col("blocks") > width)
        digit, spot = F.expr(f"block div {width} % {fanout}"), F.expr(f"block % {width}")
        run = F.expr(f"block div {width * fanout}")
        # the blocks of a last, shorter subtree stand in for those it lacks, each for its fair share
        last = F.col("blocks") - 1
        short = (F.expr(f"block div {width} = (blocks - 1) div {width}")) & ((last + 1) % width != 0)
        there = (last % width) + 1
        serves = F.when(short, F.sequence(spot, F.lit(width - 1).cast("bigint"), there)).otherwise(F.array(spot))
        sent = live.select("grp", "blocks", "block", run.alias("run"), digit.alias("digit"), "now", spot.alias("own"), F.explode(serves).alias("spot"))
        met = sent.groupBy("grp", "run", "spot").agg(F.array_sort(F.collect_list(F.struct("digit", "now", "block", "blocks", "own"))).alias("all"))
        back = met.select("grp", "spot", "all", F.explode("all").alias("me")).filter("me.own = spot")
        place = F.col("me.digit").cast("int")
        state = staged(back.select(
            "grp", "me.block", "me.blocks", F.sha2(F.array_join(F.transform("all", lambda x: x["now"]), ""), 256).alias("now"),
            F.struct(place.alias("place"), F.transform(F.filter("all", lambda x: x["digit"] != F.col("me.digit")), lambda x: x["now"]).alias("others")).alias("step"),
        ), "butterfly")
        steps.append(state.select("grp", "block", F.lit(len(steps)).alias("round"), "step"))
        width *= fanout
    if not steps:
        return blocks.select("grp", "block", F.array().cast(PROOF).alias("up")), roots[0]
    up = reduce(DataFrame.unionByName, steps).groupBy("grp", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("round", "step"))), lambda x: x["step"]).cast(PROOF).alias("up"))
    alone = blocks.filter("blocks = 1").select("grp", "block", F.array().cast(PROOF).alias("up"))
    return up.unionByName(alone), reduce(DataFrame.unionByName, roots)


def _proofs(blocks: DataFrame, fanout: int, height: int, names: list[str]) -> DataFrame:
    """Every leaf with its whole proof: its siblings within the block, then the block's ``up``."""
    keep = [c for c in names if c in blocks.columns]
    kind = dict(blocks.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    ddl = ", ".join([f"{c} {dict(blocks.dtypes)[c]}" for c in keep] + [f"key {kind}", "leaf string", "carried string", f"proof {PROOF}"])
    step = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])

    def emit(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                leaves, n = row.column("leaves")[0].as_py(), row.column("n")[0].as_py()
                up = row.column("up")[0].as_py()
                levels = _levels(leaves, fanout, _height(n, fanout, height))[:-1]
                proofs = []
                for at in range(len(leaves)):
                    own = []
                    for nodes in levels:
                        begin = at - at % fanout
                        own.append({"place": at - begin, "others": nodes[begin:at] + nodes[at + 1 : begin + fanout]})
                        at //= fanout
                    proofs.append(own + up)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([row.column(c)[0].as_py()] * len(leaves), row.schema.field(c).type) for c in keep],
                     row.column("keys").flatten(), pa.array(leaves, pa.string()), row.column("carried").flatten(), pa.array(proofs, pa.list_(step))],
                    [*keep, "key", "leaf", "carried", "proof"])

    return blocks.select(*keep, "keys", "leaves", "carried", "n", "up").mapInArrow(emit, ddl)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = _LEAF_COLUMNS,
             carry: Column | None = None, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per input row: its id column, ``leaf, subroot, root, proof`` and ``carried``.

    ``proof`` lists, level by level from the leaf to the root, the leaf's ``place`` in its run and
    the run's ``others`` from left to right (none in a run of one); :func:`folded` turns a leaf and a
    proof into a root. Leaves ascend by id within their group (null ids first, then by digest), a
    null group comes before all others, which are in byte order. ``carry`` is any text to hand
    through with its row.

    Null and empty values have digests of their own; a text of any length is hashed in its own row
    and not moved. Repeated rows are leaves each. Other columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    height = _height(block, fanout, 64)
    height -= fanout**height > block
    if fanout < 2 or height < 1:
        raise ValueError("a run has at least two nodes and a block at least one run")
    group = F.col(f"`{group_col}`").cast("string")
    source = docs.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("grp"), F.col(f"`{id_col}`").alias("key"),
        leaf_digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"), (F.lit(None) if carry is None else carry).cast("string").alias("carried"))
    blocks = staged(_blocks(_numbered(source), fanout, height), "blocks")
    up, subroots = _exchange(blocks, fanout)

    # the same again over the subroots, which are the leaves of one group
    tops = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("carried"))
    top_blocks = staged(_blocks(_numbered(tops), fanout, height), "top-blocks")
    top_up, root = _exchange(top_blocks, fanout)
    whole = top_blocks.join(top_up, ["grp", "block"]).join(root.withColumnRenamed("root", "top"), "grp")
    ways = staged(_proofs(whole.drop("root"), fanout, height, ["top"]), "ways").select(
        F.col("key").alias("grp"), F.col("leaf").alias("subroot"), F.col("top").alias("root"), F.col("proof").alias("rest"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    met = blocks.drop("root").join(up, ["grp", "block"]).withColumn("salt", (F.col("block") % SALTS).cast("int")).join(ways, ["grp", "salt"])
    met = met.withColumn("up", F.concat("up", "rest"))
    out = _proofs(met, fanout, height, ["subroot", "root"])
    return out.select(F.col("key").alias(id_col), "leaf", "subroot", "root", "proof", "carried")
