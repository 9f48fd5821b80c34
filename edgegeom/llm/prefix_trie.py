"""Trie of conversation prefixes by van Emde Boas recursion over depth.

Turns are numbered within their conversation, and a turn's name is a digest of its role and text.

1. Names. The recursion ends at blocks of ``BLOCK`` depths, which are named turn by turn as one row, and is
   worked upwards from there. Within a block every turn has the name of its prefix of the block. When two
   blocks become one, the upper block's last name is the cut prefix; the lower block's names are hashed
   with it, in all blocks of all conversations at once. After ceil(log2(depth / BLOCK)) rounds the names
   are those of whole prefixes, so a node is a depth and a name.
2. Nodes. An aggregation gives a node's members and least conversation. The pair of that conversation and
   the depth identifies the node from here on.
3. Totals. A node's leaf count and saving go to its ancestors in its own block, which its least
   conversation's path names. Then, in the same order of blocks, the totals of the trees below a cut are
   summed at the node they hang on and added to all its ancestors in the upper block. So upper and lower
   parts are totalled side by side and grafted together, in as many rounds, for a trie of any depth.

Every step is a join against a unique side or an aggregation with partial sums: neither a first turn that
all conversations share nor a conversation that holds a third of all turns is ever one group of one task.
Each round is a written table. The numbering sorts by ranges, so equal rows spread as well.

Defined results: turns are ordered by turn, null first, then role, text; a null role or text is empty; a
repeated row is one more turn; a turn without a conv_id belongs to no conversation and is left out; very
long texts count whole and leave their task only as a digest and a length; other columns are not read; an
empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import text_of

#: Depths of the smallest blocks, at which the recursion ends.
BLOCK = 16
#: Ids that one row of a node's list of conversations has.
LISTED = 1024


def _name(*parts: Column) -> Column:
    """One digest for several strings or binaries."""
    return F.unhex(F.sha2(F.concat(*[F.unhex(F.sha2(p.cast("binary"), 256)) for p in parts]), 256))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers sorted rows within a conversation and partition."""
    last, place = None, 0
    for batch in batches:
        places = []
        for conv in batch.column(0).to_pylist():
            place = place + 1 if conv == last else 1
            last = conv
            places.append(place)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, position`` (from 1), ``name, n_chars`` of every turn."""
    given = rows.where("conv_id is not null").select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), F.monotonically_increasing_id().alias("copy")
    )
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    dealt = given.repartitionByRange(*keys).sortWithinPartitions(*keys)
    narrow = dealt.select("conv_id", _name(F.col("role"), F.col("text")).alias("name"), F.length("text").cast("bigint").alias("n_chars"), F.spark_partition_id().alias("part"))
    numbered = stage(narrow.mapInArrow(_number, "conv_id bigint, name binary, n_chars bigint, part int, place bigint"), "turns")
    ends = numbered.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A partition continues one conversation at most, so the offsets have no more rows than there are partitions.
    offsets = ends.select("conv_id", "part", F.sum("n").over(before).alias("offset")).where("offset is not null")
    found = numbered.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return found.select("conv_id", (F.coalesce("offset", F.lit(0)) + F.col("place")).alias("position"), "name", "n_chars")


def _block(depth: Column, size: int) -> Column:
    return F.floor((depth - 1) / size)


def prefix_names(turns: DataFrame, deepest: int) -> DataFrame:
    """``turns`` with the name of the prefix that ends there in place of the turn's own."""
    rows = turns.groupBy("conv_id", _block(F.col("position"), BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("position", "name", "n_chars"))).alias("own"))
    hashed = lambda names, x: F.unhex(F.sha2(F.concat(F.element_at(names, -1), x["name"]), 256))
    names = F.aggregate(F.slice("own", 2, BLOCK), F.array(F.get("own", F.lit(0))["name"]), lambda names, x: F.array_append(names, hashed(names, x)))
    named = rows.select("conv_id", F.inline(F.arrays_zip(F.col("own"), names.alias("names")))).select(
        "conv_id", F.col("own.position").alias("depth"), F.col("names").alias("name"), F.col("own.n_chars").alias("n_chars"))
    named, size = stage(named, "prefixes"), BLOCK
    while size < deepest:
        block = _block(F.col("depth"), size)
        cuts = named.where(F.col("depth") % (2 * size) == size).select("conv_id", F.floor(F.col("depth") / size).alias("block"), F.col("name").alias("upper"))
        lower = named.where(block % 2 == 1).withColumn("block", block).join(cuts, ["conv_id", "block"])
        lower = lower.select("conv_id", "depth", F.unhex(F.sha2(F.concat("upper", "name"), 256)).alias("name"), "n_chars")
        named = stage(named.where(block % 2 == 0).union(lower), "prefixes")
        size *= 2
    return named


def _grafted(nodes: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens`` over whole subtrees from the nodes' own values."""
    sums = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    block = _block(F.col("depth"), BLOCK).alias("block")
    held = paths.groupBy(F.col("member").alias("conv_id"), block).agg(F.collect_list(F.struct(F.col("depth").alias("at"), F.col("conv_id").alias("above"))).alias("held"))
    rows = nodes.select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens", block).join(held, ["conv_id", "block"])
    rows = rows.withColumn("held", F.filter("held", lambda x: x["at"] <= F.col("depth"))).select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens", F.inline("held"))
    own = (F.col("at") == F.col("depth")) & (F.col("above") == F.col("conv_id"))
    rows = rows.withColumn("parent_conv_id", F.when(own, F.col("parent_conv_id"))).drop("conv_id", "depth").withColumnsRenamed({"above": "conv_id", "at": "depth"})
    totals = rows.groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("parent_conv_id"), *sums)
    totals, size = stage(totals.select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens"), "totals"), BLOCK
    while size < deepest:
        roots = totals.where((F.col("depth") - 1) % (2 * size) == size)
        below = roots.groupBy(F.col("parent_conv_id").alias("member"), (F.col("depth") - 1).alias("cut")).agg(*sums)
        below = below.select("member", _block(F.col("cut"), size).alias("block"), "n_leaves", "saved_tokens")
        upper = paths.withColumn("block", _block(F.col("depth"), size)).where("block % 2 = 0")
        grafts = upper.join(below, ["member", "block"]).groupBy("conv_id", "depth").agg(*sums)
        grafts = grafts.select("conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_leaves", "saved_tokens")
        totals = totals.union(grafts).groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("parent_conv_id"), *sums)
        totals = stage(totals.select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens"), "totals")
        size *= 2
    return totals


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the ends of the trie of ``turns(conv_id, position, name, n_chars)``.

    ``conversations(conv_id)`` has every conversation once, also those without a turn, which end at the
    root. Nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``. Ends:
    ``conv_id, depth`` of the node at which conversation ``member`` ends.
    """
    deepest = turns.agg(F.max("position")).first()[0] or 0
    named = prefix_names(turns, deepest)
    found = stage(named.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars")), "nodes")
    paths = named.withColumnRenamed("conv_id", "member").join(found.select("depth", "name", "conv_id"), ["depth", "name"])
    paths = stage(paths.select("member", "depth", "conv_id"), "paths")

    above = paths.select(F.col("member").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    linked = found.select("conv_id", "depth", "n_convs", "n_chars").join(above, ["conv_id", "depth"], "left")
    linked = stage(linked, "linked")
    children = linked.where("depth > 1").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    own = linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    own = stage(own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")}), "own")
    totals = _grafted(own, paths, deepest)

    least, n_convs = conversations.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    number = lambda x: F.lit(x).cast("bigint")
    # An aggregation without keys has one row: the root.
    top = totals.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = top.where(F.lit(n_convs > 0)).select(
        number(least).alias("conv_id"), number(0).alias("depth"), number(None).alias("parent_conv_id"), number(n_convs).alias("n_convs"), "n_children",
        F.coalesce("n_leaves", number(1)).alias("n_leaves"), F.coalesce("saved_tokens", number(0)).alias("saved_tokens"),
    )
    below = own.drop("n_leaves", "saved_tokens").join(totals.drop("parent_conv_id"), ["conv_id", "depth"])
    below = below.select("conv_id", "depth", F.coalesce("parent_conv_id", number(least)).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")

    last = paths.groupBy("member").agg(F.max(F.struct("depth", "conv_id")).alias("x")).select("member", "x.conv_id", "x.depth")
    told = conversations.select(F.col("conv_id").alias("member")).join(last, "member", "left")
    ends = told.select(F.coalesce("conv_id", number(least)).alias("conv_id"), F.coalesce("depth", number(0)).alias("depth"), "member")
    return root.union(below), ends


def _list_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and member as lists of up to LISTED members."""
    names = ["conv_id", "depth", "first", "members"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    node, held, rows = None, [], []
    for batch in batches:
        for conv, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and (node != (conv, depth) or len(held) == LISTED):
                rows.append((*node, held[0], ",".join(map(str, held))))
                held = []
            node = conv, depth
            held.append(member)
        if len(rows) > 4096:
            yield made(rows)
            rows = []
    if held:
        rows.append((*node, held[0], ",".join(map(str, held))))
    yield made(rows)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest a node of its sorted lists, of which one is held at a time."""
    node, sha, rows = None, None, []
    for batch in batches:
        for conv, depth, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if node != (conv, depth):
                if node:
                    rows.append((*node, sha.hexdigest()))
                node, sha = (conv, depth), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(members.as_buffer())
    if node:
        rows.append((*node, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: the hash of each node's ended conversations, ascending, comma-joined.

    Lists of LISTED ids are made in ranges, so a node where a third of all conversations end is read by
    many tasks; the one task that hashes it, as such a hash is sequential, streams over these lists.
    """
    keys = ["conv_id", "depth", "member"]
    lists = ends.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys).mapInArrow(_list_ids, "conv_id bigint, depth bigint, first bigint, members string")
    node = ["conv_id", "depth"]
    return lists.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_digest, "conv_id bigint, depth bigint, ends_sha256 string")
