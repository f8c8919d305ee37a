"""The prefix trie of conversations: ROLLUP over turn columns, in blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.operators.scan import prefix_scan, range_buckets
from cohortflow.session import stage

#: Turns of a block, and so grouping columns of the ROLLUP.
WIDTH = 8
#: Characters of a piece of a member list.
PIECE = 4096
#: Whole numbers that sums of digests need.
WIDE = "decimal(38,0)"
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, position, said, points) of the rows with a conversation, in order of turn, null first.

    ``said`` is a digest of role and text, ``points`` counts the text's code points. Rows of the same turn follow
    the digest. Long conversations are cut into ranges, so none is ordered in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        said.alias("said"), F.length(text).alias("points"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["known", "turn", "said", "row"]  # the last parts equal turns, however many
    bucketed = range_buckets(rows, ["conv_id", *order], "turns")
    placed = prefix_scan(bucketed, ["conv_id"], order, sums={"position": F.lit(1).cast("bigint")})
    return placed.select("conv_id", "position", "said", "points")


def with_shared_starts(placed: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, position, said, points): each conversation c with its first h turns, h = crc32(c) % ``most``, taken from
    conversation c - c % ``span`` (fewer if that has fewer, none if it is absent).

    Every conversation also gets a row of position 0, so one that has no turns left is there.
    """
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    starts = placed.where(F.col("position") < most).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("position", "said", "points"))).alias("start"))  # fewer than most
    plan = convs.join(starts, "base", "left").select("conv_id", "h", F.slice(F.coalesce("start", F.array().cast("array<struct<position:bigint,said:string,points:int>>")), 1, F.col("h")).alias("start"))
    plan = stage(plan, "plan")
    taken = plan.select("conv_id", F.explode("start").alias("s")).select("conv_id", "s.position", "s.said", "s.points")
    marks = plan.select("conv_id", F.lit(0).cast("bigint").alias("position"), F.lit("").alias("said"), F.lit(0).alias("points"))
    own = placed.join(plan.select("conv_id", "h", F.size("start").alias("got")), "conv_id").where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("got")).cast("bigint").alias("position"), "said", "points")
    return own.union(taken).union(marks)


def blocks(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, node, t1..tWIDTH, size): WIDTH turns of a conversation in a row, keyed by the node that the block before ends in.

    A turn is (x, y, points) with two 60-bit digests of its place and what is said. A node is (depth, x, y, points):
    the sums over its turns, so that sums from the root on name a node however many blocks come before it, and a
    running total gives every block its node without one round of work for each.
    """
    mark = F.md5(F.concat("said", F.lit("@"), F.col("position").cast("string")).cast("binary"))
    part = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("bigint")
    turn = F.struct(part(1).alias("x"), part(16).alias("y"), F.col("points").cast("bigint").alias("points"))
    slot, real = F.pmod(F.col("position") - 1, F.lit(WIDTH)), F.col("position") > 0
    rows = rebuilt.select("conv_id", F.when(real, F.floor((F.col("position") - 1) / WIDTH)).otherwise(0).cast("bigint").alias("block"), slot.alias("slot"), F.when(real, turn).alias("turn"))
    wide = rows.groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("slot") == i, F.col("turn"))).alias(c) for i, c in enumerate(TURNS)])
    total = lambda field: sum(F.coalesce(F.col(f"{c}.{field}"), F.lit(0)).cast(WIDE) for c in TURNS)
    filled = sum(F.col(c).isNotNull().cast("int") for c in TURNS)
    summed = wide.select("*", filled.alias("size"), total("x").cast(WIDE).alias("sx"), total("y").cast(WIDE).alias("sy"), total("points").cast("bigint").alias("sp"))
    scanned = prefix_scan(range_buckets(summed, ["conv_id", "block"], "blocks"), ["conv_id"], ["block"], sums={"ax": F.col("sx"), "ay": F.col("sy"), "ap": F.col("sp")})
    before = F.struct((F.col("block") * WIDTH).alias("depth"), (F.col("ax") - F.col("sx")).cast(WIDE).alias("x"), (F.col("ay") - F.col("sy")).cast(WIDE).alias("y"), (F.col("ap") - F.col("sp")).cast("bigint").alias("points"))
    return scanned.select("conv_id", before.alias("node"), *TURNS, "size")


def _rollup(rows: DataFrame, what: str, extra: str = "") -> DataFrame:
    """Groups of every prefix of a block's turns: node, turns, ``level`` (how many of them) and the aggregates ``what``.

    Groups of padding, and the empty prefix of every block but the first, which the block before has, go.
    """
    spark = rows.sparkSession
    rolled = spark.sql(
        f"SELECT node, {', '.join(TURNS)}, grouping_id() AS gid, {what} FROM {{rows}} GROUP BY node, ROLLUP ({', '.join(TURNS)})",
        rows=rows,
    )
    level = (F.lit(WIDTH) - F.bit_count("gid")).cast("int")
    last = F.get(F.array(*[F.col(c) for c in TURNS]), F.col("level") - 1)
    return rolled.withColumn("level", level).where(last.isNotNull() | (F.col("level") == 0) & (F.col("node.depth") == 0))


def _key(levels: Column) -> list[Column]:
    """x, y, points of the node ``levels`` turns into the block, as sums from the root."""
    held = F.slice(F.array(*[F.col(c) for c in TURNS]), 1, levels)
    sums = lambda field, kind: F.aggregate(held, F.col(f"node.{field}").cast(kind), lambda a, t: (a + t[field]).cast(kind))
    return [sums("x", WIDE), sums("y", WIDE), sums("points", "bigint")]


def _named(rolled: DataFrame, *more: str) -> DataFrame:
    x, y, points = _key(F.col("level"))
    px, py, before = _key(F.greatest(F.col("level") - 1, F.lit(0)))
    depth = F.col("node.depth") + F.col("level")
    top = F.col("level") == 0
    return rolled.select(depth.alias("depth"), x.alias("x"), y.alias("y"), points.alias("points"), F.when(~top, px).alias("px"), F.when(~top, py).alias("py"), before.alias("before"), *more)


def trie(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``rebuilt`` has (conv_id, position, said, points) with positions 1.. and a row of position 0 for each conversation.

    A first ROLLUP counts the members of every node and finds the smallest. A node's leaves are its members
    that are the smallest of a leaf. What a subtree saves is its members' code points from the node down
    to where each of them becomes the smallest member of its node, and it stays that below; so both
    are sums over members, and a second ROLLUP has them without walking down the tree.
    """
    cut = stage(blocks(rebuilt), "trie-blocks")
    nodes = stage(_named(_rollup(cut, "min(conv_id) AS conv_id, count(*) AS n_convs"), "conv_id", "n_convs"), "trie-nodes")
    children = nodes.where("px IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, ["depth", "x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    # For each conversation: code points up to where it is the smallest member, and whether it stands for a leaf.
    ends = cut.groupBy("conv_id").agg(F.max(F.struct(F.col("node.depth").alias("at"), "node", *TURNS, "size")).alias("e")).select("conv_id", "e.node", *[f"e.{c}" for c in TURNS], F.col("e.size").alias("level"))
    ends = stage(_named(ends, "conv_id"), "trie-ends")
    smallest = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("until"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    facts = ends.join(smallest, "conv_id", "left").select("conv_id", F.coalesce("until", "points").alias("until"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    known = cut.join(stage(facts, "trie-facts"), "conv_id")
    starts = [F.col("node.points")]
    for c in TURNS[:-1]:
        starts.append(starts[-1] + F.coalesce(F.col(f"{c}.points"), F.lit(0)))
    shared = [F.greatest(F.col("until") - s, F.lit(0)).alias(f"s{i}") for i, s in enumerate(starts, 1)]
    sums = ", ".join(f"sum(s{i}) AS s{i}" for i in range(1, WIDTH + 1))
    again = _rollup(known.select("node", *TURNS, "leaf", *shared), f"sum(leaf) AS n_leaves, {sums}")
    saved = F.get(F.array(*[F.col(f"s{i}") for i in range(1, WIDTH + 1)]), F.greatest(F.col("level") - 1, F.lit(0)))
    below = _named(again.withColumn("saved_tokens", saved), "n_leaves", "saved_tokens").select("depth", "x", "y", "n_leaves", "saved_tokens")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    lists = member_digests(ends.select("depth", "x", "y", "conv_id"))
    found = nodes.join(below, ["depth", "x", "y"]).join(lists, ["depth", "x", "y"], "left").join(parents, ["depth", "px", "py"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def member_digests(members: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the ids (conv_id) listed for each node in rising order.

    Ids are sorted over all tasks at once and joined to pieces of bounded length; a node's pieces then go through
    the digest in order, so a node with many members costs one task only its pieces and no memory.
    """
    key = "depth bigint, x string, y string"
    rows = members.select(F.col("depth").cast("bigint").alias("depth"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "conv_id")
    ranged = rows.repartitionByRange("depth", "x", "y", "conv_id").sortWithinPartitions("depth", "x", "y", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, size = None, [], 0
        for batch in batches:
            out = []
            for depth, x, y, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if (depth, x, y) != node or size >= PIECE:
                    if held:
                        out.append((*node, held[0], ",".join(map(str, held))))
                    node, held, size = (depth, x, y), [], 0
                held.append(conv)
                size += len(str(conv)) + 1
            yield _batch(out)
        if held:
            yield _batch([(*node, held[0], ",".join(map(str, held)))])

    cut = ranged.mapInArrow(pieces, f"{key}, first bigint, piece string")
    dealt = cut.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "first")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        names = ["depth", "x", "y", "ends_sha256"]
        for batch in batches:
            out = []
            for depth, x, y, _, piece in zip(*[c.to_pylist() for c in batch.columns]):
                if (depth, x, y) != node:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (depth, x, y), hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield _columns(out, names)
        if sha:
            yield _columns([(*node, sha.hexdigest())], names)

    hashed = dealt.mapInArrow(digests, f"{key}, ends_sha256 string")
    return hashed.select("depth", F.col("x").cast(WIDE).alias("x"), F.col("y").cast(WIDE).alias("y"), "ends_sha256")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return _columns(rows, ["depth", "x", "y", "first", "piece"])


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "first": pa.int64()}
    values = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.string())) for n, v in zip(names, values)], names=names)


def prefix_trie(turns: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations; see ``positions``, ``with_shared_starts`` and ``trie``.

    Null roles and texts are empty ones. Rows without a conversation take no part; repeated rows are turns of
    their own. Without conversations there is no node, not even the root. Other columns are ignored.
    """
    placed = stage(positions(turns), "placed")
    return trie(with_shared_starts(placed, span, most))
