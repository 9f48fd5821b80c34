"""Two-hop work in blocks of nodes: triangles, codegrees and walks without a row per path.

Paths through a node number the square of its degree, so as rows they are many times the edges. Here the nodes of
all graphs are laid out by id and cut into blocks of about equal load, the number of paths their work follows. A
block gets each neighbour list it needs once, as packed bytes, and counts its paths in arrays. What is shuffled is the
lists, once per block that needs them, and one row per result. No block takes more than ``BLOCK`` paths; nodes of
a larger load are handed back, and their callers treat them by joins.

Lists that are dealt to blocks grow with the paths and are many times the edges, so blocks are worked off in waves: what
is dealt for one is deleted before the next, and only results stay, packed and compressed. Disk grows with the edges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..columns import GRAPH
from ..staging import stage, stage_at

#: Paths of one block: what it holds at most if no two of its nodes share a neighbour.
BLOCK = 1 << 24
#: Least paths of a block, unless there are fewer in all.
LEAST = 1 << 20
#: Blocks for each core, where there is enough work.
PER_CORE = 4
#: Paths and cells of node tables that are held at once within a block.
STEP, CELLS = 1 << 16, 1 << 23
#: Bytes of lists that are dealt to blocks at once.
DEALT = 1 << 25
#: Bytes of lists that are dealt to blocks before these are worked off, about, and least blocks for each core of a wave.
#: Each wave reads all lists, so waves are not made smaller than what earlier steps take on disk for large graphs.
WAVE, WAVE_PER_CORE = 1 << 32, 2
#: Rows of results that are brought together at once, and the least where there are many cores.
HOME, LEAST_HOME = 1 << 20, 1 << 16
GAPS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _at(raw: np.ndarray, kind: type) -> np.ndarray:
    """The bytes as numbers of a kind from every byte on; none of them is copied."""
    return np.ndarray((max(0, len(raw) - np.dtype(kind).itemsize + 1),), kind, raw, strides=(1,))


def _pack_all(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lists of ascending ids, one after the other, each as its first id and the gaps in as few bytes as the largest takes."""
    if not len(size):
        return pa.array([], pa.binary())
    start = np.cumsum(size) - size
    gaps = np.diff(ids, prepend=ids[:1]).view(np.uint64)
    gaps[start] = 0
    most, width = np.maximum.reduceat(gaps, start), np.full(len(size), 8)
    for w in (4, 2, 1):
        width[most <= np.iinfo(GAPS[w]).max] = w
    ends = np.cumsum(np.concatenate([[0], 9 + (size - 1) * width]))
    raw, at = np.empty(ends[-1], np.uint8), ends[:-1]
    raw[at] = width
    _at(raw, np.int64)[at + 1] = ids[start]
    for w, kind in GAPS.items():
        some = np.flatnonzero(width == w)
        if len(some):
            count = size[some] - 1
            place = _runs(np.zeros(len(some), np.int64), count) * w + np.repeat(at[some] + 9, count)
            _at(raw, kind)[place] = gaps[_runs(start[some] + 1, count)].astype(kind)
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
    return packed.cast(pa.binary())


def _pack(ids: np.ndarray) -> bytes:
    return _pack_all(ids, np.array([len(ids)]))[0].as_py()


def _unpack(data: bytes) -> np.ndarray:
    return _unpack_all(pa.array([data]))[0]


def _unpack_all(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all packed lists one after the other, and the size of each; a null is an empty list."""
    data = pc.fill_null(data.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    there = np.flatnonzero(np.diff(offsets))
    at, length, size = offsets[there], np.diff(offsets)[there], np.zeros(len(data), np.int64)
    if not len(there):
        return np.empty(0, np.int64), size
    width = raw[at].astype(np.int64)
    size[there] = (length - 9) // width + 1
    start = (np.cumsum(size) - size)[there]
    ids = np.empty(size.sum(), np.int64)
    ids[start] = _at(raw, np.int64)[at + 1]
    for w, kind in GAPS.items():
        some = np.flatnonzero(width == w)
        if len(some):
            gaps = size[there[some]] - 1
            first = _runs(np.zeros(len(some), np.int64), gaps) * w + np.repeat(at[some] + 9, gaps)
            ids[_runs(start[some] + 1, gaps)] = _at(raw, kind)[first].astype(np.uint64, copy=False).view(np.int64)
    # Sums run on over all lists and wrap around; what was there before a list is taken off.
    firsts = ids[start]
    np.cumsum(ids, out=ids)
    ids -= np.repeat(ids[start] - firsts, size[there])
    return ids, size


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order and the place of each; by a table where they lie close, without a sort."""
    low, high = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
    if high - low > 4 * len(ids) + (1 << 16):
        return np.unique(ids, return_inverse=True)
    there = np.zeros(high - low + 1, bool)
    there[ids - low] = True
    # A table of smaller numbers is looked up faster.
    return np.flatnonzero(there) + low, (np.cumsum(there, dtype=np.int32 if high - low < 1 << 30 else np.int64) - 1)[ids - low].astype(np.int64)


LISTS = pa.schema([(GRAPH, pa.string()), ("node", pa.int64()), ("ns", pa.binary()), ("k", pa.int32()), ("load", pa.float64())])


def _begins(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where another node than that of the row before begins, the first row left out."""
    names = rows.column(GRAPH)
    names = (names.combine_chunks() if isinstance(rows, pa.Table) else names).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero((np.diff(names) != 0) | (np.diff(rows.column("node").to_numpy()) != 0)) + 1


def _packed_nodes(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Whole nodes' arcs in order, packed to a row a node."""
    table = pa.Table.from_batches(rows)
    start = np.concatenate([[0], _begins(table)])
    size = np.diff(np.append(start, table.num_rows))
    names = table.column(GRAPH).take(pa.array(start)).combine_chunks().cast(pa.string())
    lists = _pack_all(table.column("d").to_numpy(), size)
    load = np.add.reduceat(table.column("load").to_numpy(), start)
    return pa.RecordBatch.from_arrays([names, pa.array(table.column("node").to_numpy()[start]), lists, pa.array(size, pa.int32()), pa.array(load)], schema=LISTS)


def _pack_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs ordered by node and end to packed lists; the arcs of the last node wait for the next batch."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = lambda at: (batch.column(GRAPH)[at].as_py(), batch.column("node")[at].as_py())  # noqa: E731, B023
        begins = [*([0] if held and key(0) != last else []), *_begins(batch).tolist()]
        last = key(batch.num_rows - 1)
        if begins:
            yield _packed_nodes([*held, batch.slice(0, begins[-1])])
            held = []
        held.append(batch.slice(begins[-1] if begins else 0))
    if held:
        yield _packed_nodes(held)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs ordered by ``key`` alone to arcs ordered by node and end; those of the last key wait for the next batch."""
    held = []

    def ordered(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).drop_columns("key").combine_chunks()
        names = table.column(GRAPH).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("d").to_numpy(), names, table.column("node").to_numpy()))
        return table.take(pa.array(order)).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        if held and held[-1].column("key")[-1].as_py() != keys[0]:
            yield ordered(held)
            held = []
        # Where the last key begins.
        begin = int(np.searchsorted(keys, keys[-1]))
        if begin:
            yield ordered([*held, batch.slice(0, begin)])
            held = []
        held.append(batch.slice(begin))
    if held:
        yield ordered(held)


def packed_lists(arcs: DataFrame) -> DataFrame:
    """``(graph_id, node, ns, k, load)``: the packed ends ``d`` of each ``s``, their number and the sum of their ``load``, staged."""
    rows = arcs.select(GRAPH, F.col("s").alias("node"), "d", F.col("load").cast("double").alias("load"))
    # Arcs are sorted as rows: as arrays they would be made, merged and sorted one object at a time. They are sorted by
    # one number, which takes no comparisons; the few arcs of equal numbers are told apart in the batch. Nodes of one
    # id in many graphs, or of ids that agree in their lower bits, differ in the hash.
    key = (F.shiftleft("node", 20).bitwiseOR(F.xxhash64(GRAPH, "node").bitwiseAND(F.lit((1 << 20) - 1)))).alias("key")
    dealt = rows.repartition(GRAPH, "node").select("*", key).sortWithinPartitions("key")
    return stage(dealt.mapInArrow(lambda batches: _pack_sorted(_in_order(batches)), from_arrow_schema(LISTS)), "lists")


def with_onward(arcs: DataFrame, hops: int) -> DataFrame:
    """``(graph_id, s, d, load)``: arcs with the number of paths of up to ``hops`` arcs that begin with them."""
    arcs = arcs.select(GRAPH, "s", "d")
    rows = arcs.withColumn("load", F.lit(1.0))
    for _ in range(hops - 1):
        onward = rows.groupBy(GRAPH, F.col("s").alias("d")).agg(F.sum("load").alias("onward"))
        rows = arcs.join(onward, [GRAPH, "d"], "left").select(GRAPH, "s", "d", F.least(F.lit(1.0) + F.coalesce("onward", F.lit(0.0)), F.lit(1e18)).alias("load"))
    return rows


def in_blocks(loads: DataFrame, block: int = BLOCK, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Nodes ``(graph_id, node, block)`` up to ``block`` paths, the nodes above, and the number of blocks.

    ``loads`` is a staged table ``(graph_id, node, load)``. Neighbouring ids share a block, as they often share
    neighbours. What a block holds is bounded by its paths, but also by the arcs of its graphs: with ``whole``, the lists of
    all nodes, blocks of a graph of up to ``block`` arcs take the load of a fair share, and ``loads`` has ``k`` too. So long walks,
    which pass most of such a graph, do not need it once for each ``block`` paths.
    """
    loads = loads.select(GRAPH, "node", "load", *(["k"] if whole is not None else []))
    light = loads.filter(F.col("load") <= block)
    total = light.agg(F.sum("load")).first()[0] or 0.0
    fair = total / (PER_CORE * loads.sparkSession.sparkContext.defaultParallelism)
    part = float(max(1, min(block, max(min(LEAST, block), fair))))
    weight = F.col("load") / part
    if whole is not None and fair > part:
        small = whole.groupBy(GRAPH).agg(F.sum("k").alias("arcs")).filter(F.col("arcs") <= block)
        light = light.join(small, GRAPH, "left")
        # Own nodes of many small graphs have no more arcs than those of a large one.
        weight = F.when(F.col("arcs").isNull(), weight).otherwise(F.greatest(F.col("load") / fair, F.col("k") / float(block)))
    light = light.select(GRAPH, "node", weight.alias("load"))
    ranges = stage(light.repartitionByRange(GRAPH, "node").withColumn("range", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum("load").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # One row per range.
    sums = ranges.groupBy("range").agg(F.sum("load").alias("load"))
    offsets = sums.select("range", before(Window.orderBy("range")).alias("offset"))
    inside = before(Window.partitionBy("range").orderBy(GRAPH, "node"))
    numbered = ranges.withColumn("inside", inside).join(F.broadcast(offsets), "range").select(
        GRAPH, "node", F.floor(F.col("offset") + F.col("inside")).alias("block"))
    return stage(numbered, "blocks"), loads.filter(F.col("load") > block).select(GRAPH, "node", "load"), int(sums.agg(F.sum("load")).first()[0] or 0) + 1


def delivered(arcs: DataFrame, lists: DataFrame, own: DataFrame, hops: int, extra: DataFrame | None = None) -> DataFrame:
    """``(block, graph_id, node, own, ns)``: packed lists of all nodes within ``hops`` of a block.

    ``extra`` names more nodes ``(graph_id, block, node)`` whose lists a block needs.
    """
    step = arcs.select(GRAPH, F.col("s").alias("node"), "d")
    seen = own.select(GRAPH, "block", "node")
    for _ in range(hops):
        seen = seen.join(step, [GRAPH, "node"]).select(GRAPH, "block", F.col("d").alias("node")).union(seen).distinct()
    if extra is not None:
        seen = seen.union(extra.select(GRAPH, "block", "node"))
    flagged = seen.withColumn("own", F.lit(False)).union(own.select(GRAPH, "block", "node", F.lit(True)))
    needed = flagged.groupBy(GRAPH, "block", "node").agg(F.max("own").alias("own"))
    return needed.join(lists.select(GRAPH, "node", "ns"), [GRAPH, "node"], "left").select("block", GRAPH, "node", "own", "ns")


BUNDLES = pa.schema([("block", pa.int64()), (GRAPH, pa.string()), *((c, pa.binary()) for c in ("nodes", "own", "sizes", "ns"))])


def _starts_in(starts: list[tuple[str, int]], name: str) -> tuple[int, np.ndarray]:
    """How many of the starts, which are in order, lie before a graph, and the nodes of those within it."""
    low, high = bisect_left(starts, (name, -(1 << 63))), bisect_right(starts, (name, (1 << 63) - 1))
    return low, np.array([x[1] for x in starts[low:high]], np.int64)


def _deal(starts: list[tuple[str, int, int]], wave: tuple[int, int] | None = None):
    """A function of packed lists: for each block the lists of its nodes and of all next to them, many in a row.

    ``starts`` holds the first graph and node and the number of every block, in order; ``wave`` the places in it
    from which on and before which blocks get something, all by default. A list with ``to`` goes to the blocks of the nodes that
    are packed there, not of its own; one with a false ``light`` belongs to no block.
    """
    names, numbers = [x[:2] for x in starts], np.array([x[2] for x in starts], np.int64)
    begin, end = wave or (0, len(starts))

    def of_graph(name: str, nodes: np.ndarray, data: pa.Array, to: pa.Array, light: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, firsts = _starts_in(names, name)
        if begin > low - 1 + len(firsts) or end < low:
            return
        ends, size = _unpack_all(to)
        home = np.searchsorted(firsts, nodes, "right")
        # Ends ascend, so equal blocks of a list follow each other.
        keys = np.repeat(np.arange(len(nodes)), size) * (len(firsts) + 1) + np.searchsorted(firsts, ends, "right")
        pairs = np.unique(np.concatenate([keys[np.flatnonzero(np.diff(keys, prepend=-1))], np.arange(len(nodes)) * (len(firsts) + 1) + home]))
        row, at = np.divmod(pairs, len(firsts) + 1)
        asked = (at >= begin - (low - 1)) & (at < end - (low - 1))
        row, at, pairs = row[asked], at[asked], pairs[asked]
        lengths = pc.fill_null(pc.binary_length(data), 0).to_numpy().astype(np.int64)
        parts = np.cumsum(lengths[row]) // DEALT
        for part in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(parts)) + 1):
            part = part[np.argsort(at[part], kind="stable")]
            rows, block = row[part], at[part]
            begins = np.flatnonzero(np.diff(block, prepend=-1))
            cuts, ns = np.append(begins, len(part)), data.take(pa.array(rows))
            offsets = np.concatenate([[0], np.cumsum(lengths[rows])])

            def column(raw: np.ndarray | pa.Buffer, places: np.ndarray) -> pa.Array:
                buffers = [None, pa.py_buffer(places.astype(np.int32)), raw if isinstance(raw, pa.Buffer) else pa.py_buffer(raw)]
                return pa.BinaryArray.from_buffers(pa.binary(), len(begins), buffers)

            yield pa.RecordBatch.from_arrays([
                pa.array(numbers[low - 1 + block[begins]]), pa.repeat(pa.scalar(name, pa.string()), len(begins)),
                column(nodes[rows], 8 * cuts), column((block == home[rows]) & light[rows], cuts), column(lengths[rows].astype(np.int32), 4 * cuts),
                column(ns.buffers()[2], offsets[cuts])], schema=BUNDLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(GRAPH).unique():
                part = batch.filter(pc.equal(batch.column(GRAPH), name))
                if part.num_rows:
                    given = part.schema.names
                    light = part.column("light").to_numpy(zero_copy_only=False) if "light" in given else np.ones(part.num_rows, bool)
                    yield from of_graph(name.as_py(), part.column("node").to_numpy(), part.column("ns"), part.column("to" if "to" in given else "ns"), light)

    return run


def _starts(own: DataFrame) -> list[tuple[str, int, int]]:
    """The first graph and node and the number of every block in order, one row a block, which is all that is collected."""
    starts = own.groupBy("block").agg(F.min(F.struct(GRAPH, "node")).alias("first")).collect()
    return sorted((x["first"][GRAPH], x["first"]["node"], x["block"]) for x in starts)


def dealt(lists: DataFrame, starts: list[tuple[str, int, int]], wave: tuple[int, int] | None = None) -> DataFrame:
    """The packed lists of all nodes of blocks and of those next to them, many in a row: see :func:`_opened`.

    Blocks are ranges of nodes and lists name all that touches a node, so each list tells which blocks need it and
    none is joined.
    """
    given = [c for c in ("to", "light") if c in lists.columns]
    return lists.select(GRAPH, "node", "ns", *given).mapInArrow(_deal(starts, wave), from_arrow_schema(BUNDLES))


def _opened(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The nodes of one graph in one block, which are its own, and their packed lists."""
    if "nodes" not in rows.column_names:
        return rows["node"].to_numpy(), rows["own"].to_numpy(), rows["ns"].chunk(0) if isinstance(rows["ns"], pa.ChunkedArray) else rows["ns"]
    nodes, own, sizes, raw = (np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in (
        ("nodes", np.int64), ("own", bool), ("sizes", np.int32), ("ns", np.uint8)))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return nodes, own, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(nodes), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _by_block(rows: DataFrame, count: int, work: Callable[[Lists, pa.Table], Iterator[dict]], schema: pa.Schema) -> DataFrame:
    # By number: a block is little to move and much to do, so blocks are not put together by bytes.
    dealt = rows.repartition(max(1, min(2 * count, 4096)), "block")
    return dealt.groupBy("block").applyInArrow(_by_graph(work, schema), from_arrow_schema(schema))


def _squeezed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, each as its least one and what the rows lie above it, byte by byte and compressed."""
    head, planes = [len(columns[0])], []
    for x in columns:
        above = (x - x.min()).view(np.uint64)
        width = (int(above.max()).bit_length() + 7) // 8
        head += [int(x.min()), width]
        planes.append(above.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unsqueezed(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    head, at, made = raw[:8 * (1 + 2 * columns)].view(np.int64), 8 * (1 + 2 * columns), []
    rows = int(head[0])
    for low, width in head[1:].reshape(-1, 2).tolist():
        above = np.zeros((rows, 8), np.uint8)
        above[:, :width] = raw[at:at + width * rows].reshape(width, rows).T
        made.append(above.view(np.int64).ravel() + low)
        at += width * rows
    return made


#: What a block found for one graph, as it is written, and as it goes to the homes.
FOUND = pa.schema([(GRAPH, pa.string()), ("homes", pa.list_(pa.int32())), ("rows", pa.list_(pa.binary()))])
SENT = pa.schema([("home", pa.int32()), (GRAPH, pa.string()), ("rows", pa.binary())])


def _send(made: pa.Table, homes: list[tuple[str, int]], split: int) -> Iterator[pa.RecordBatch]:
    """Results to the homes of their edges, the ranges of nodes that the lower end lies in, cut into ``split``."""
    columns = [c for c in made.column_names if c != GRAPH]
    for name in made.column(GRAPH).unique():
        part = made.filter(pc.equal(made.column(GRAPH), name))
        rows = [part.column(c).to_numpy() for c in columns]
        u, v = rows[columns.index("u")], rows[columns.index("v")]
        low, firsts = _starts_in(homes, name.as_py())
        home = (low - 1 + np.searchsorted(firsts, u, "right")) * split
        if split > 1:
            home += ((u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % split
        order = np.lexsort((v, u, home))
        rows, home = [x[order] for x in rows], home[order]
        begins = np.flatnonzero(np.diff(home, prepend=-1))
        packed = [_squeezed([x[a:b] for x in rows]) for a, b in zip(begins, np.append(begins[1:], len(home)))]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name.as_py(), home[begins], packed), FOUND)], schema=FOUND)


def _each_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        homes, rows = batch.column("homes"), batch.column("rows")
        names = batch.column(GRAPH).take(pc.list_parent_indices(homes))
        yield pa.RecordBatch.from_arrays([homes.flatten(), names, rows.flatten()], schema=SENT)


def _gather(columns: list[str], added: set[str], schema: pa.Schema):
    """A function of what was sent to one home: one row an edge, of the sums of the columns in ``added``, else the largest."""
    def run(table: pa.Table) -> pa.Table:
        made = []
        for name in table.column(GRAPH).unique():
            parts = [_unsqueezed(x, len(columns)) for x in table.filter(pc.equal(table.column(GRAPH), name)).column("rows").to_pylist()]
            rows = dict(zip(columns, map(np.concatenate, zip(*parts))))
            order = np.lexsort((rows["v"], rows["u"]))
            u, v = rows["u"][order], rows["v"][order]
            begins = np.append(0, 1 + np.flatnonzero((np.diff(u) != 0) | (np.diff(v) != 0)))
            ends = {"u": u[begins], "v": v[begins]}
            values = {c: (np.add if c in added else np.maximum).reduceat(rows[c][order], begins) for c in columns if c not in ends}
            arrays = [pa.repeat(name, len(begins)) if f.name == GRAPH else pa.array({**ends, **values}[f.name], f.type) for f in schema]
            made.append(pa.Table.from_arrays(arrays, schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    return run


def in_waves(
    lists: DataFrame, own: DataFrame, work: Callable[[Lists, pa.Table], Iterator[dict]], schema: pa.Schema, added: set[str], path: str,
) -> DataFrame:
    """One row an edge from the rows that ``work`` finds for it in the blocks: columns in ``added`` are summed, the others' largest is taken.

    Blocks are worked off in waves of about ``WAVE`` bytes of lists; what they find is written below ``path``, so ``lists`` and
    ``own`` are not read again.
    """
    spark, starts = lists.sparkSession, _starts(own)
    cores, columns = spark.sparkContext.defaultParallelism, [f.name for f in schema if f.name != GRAPH]
    moved, arcs = lists.agg(F.sum(F.length("ns") * F.least(F.col("k") + 1, F.lit(len(starts)))), F.sum("k")).first()
    each = max(1, WAVE_PER_CORE * cores, int(len(starts) * WAVE / max(1, moved or 0)))
    wanted = max(-(-(arcs or 0) // HOME), min(PER_CORE * cores, -(-(arcs or 0) // LEAST_HOME)), 1)
    together, split = max(1, len(starts) // wanted), max(1, -(-wanted // max(1, len(starts))))
    homes = [x[:2] for x in starts[::together]]
    find = _by_graph(work, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, schema=BUNDLES)
        for block in held.column("block").unique():
            yield from _send(find(held.filter(pc.equal(held.column("block"), block))), homes, split)

    paths = []
    for begin in range(0, len(starts), each):
        wave = starts[begin:begin + each]
        # A part for each block, so none waits for another.
        part = F.array_position(F.array(*[F.lit(x[2]).cast("long") for x in wave]), F.col("block")).cast("int") - 1
        rows = dealt(lists, starts, (begin, begin + len(wave))).withColumn("part", part).repartitionById(len(wave), "part").drop("part")
        paths.append(f"{path}/{begin}")
        stage_at(rows.mapInArrow(run, from_arrow_schema(FOUND)), paths[-1])
    found = spark.read.schema(from_arrow_schema(FOUND)).parquet(*paths) if paths else spark.createDataFrame([], from_arrow_schema(FOUND))
    sent = found.mapInArrow(_each_home, from_arrow_schema(SENT))
    return sent.repartitionById(max(1, len(homes) * split), "home").groupBy("home").applyInArrow(
        _gather(columns, added, schema), from_arrow_schema(schema))


class Lists:
    """The neighbour lists of one graph in one block; nodes are places in ``ids``."""

    def __init__(self, nodes: np.ndarray, own: np.ndarray, data: pa.Array):
        ends, size = _unpack_all(data)
        self.ids, places = _numbered(np.concatenate([ends, nodes]))
        at = places[len(ends):]
        self.flat, self.own = places[:len(ends)], np.sort(at[own])
        # A node without a list has the last one, which is empty.
        self.size = np.append(size, 0)
        self.start = np.cumsum(self.size) - self.size
        self.of = np.full(len(self.ids), len(nodes))
        self.of[at] = np.arange(len(nodes))
        self.rows = max(1, CELLS // len(self.ids))
        self.place = np.zeros(len(self.ids), np.int32)

    def ends(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the nodes one after the other: which node, which end."""
        of = self.of[nodes]
        size = self.size[of]
        owner = np.repeat(np.arange(len(nodes)), size)
        shift = self.start[of] - (np.cumsum(size) - size)
        return owner, self.flat[np.arange(len(owner)) + shift[owner]]

    def steps(self, hops: int) -> Iterator[np.ndarray]:
        """Own nodes in runs of about ``STEP`` paths, whose cells are a row of all nodes for each."""
        for own, _ in self._runs_of_own(hops, False):
            yield own

    def near_steps(self) -> Iterator[tuple[np.ndarray, int]]:
        """Own nodes in runs of about ``STEP`` paths of two arcs, and the cells of a run: a row of the nodes that it meets for each.

        So a run does not get shorter where the nodes of a block have few neighbours in common.
        """
        return self._runs_of_own(2, True)

    def _runs_of_own(self, hops: int, near: bool) -> Iterator[tuple[np.ndarray, int]]:
        # Paths of no arc and of up to one take no lists, and those of all arcs are counted for own nodes only.
        load = 1.0 + (self.size[self.of] if hops > 1 else 0.0 * self.of)
        for _ in range(hops - 2):
            gone = np.concatenate([[0.0], np.cumsum(load[self.flat])])
            load = 1.0 + (gone[self.start + self.size] - gone[self.start])[self.of]
        owner, end = self.ends(self.own)
        of_own = 1.0 + np.bincount(owner, load[end], len(self.own)) if hops else np.ones(len(self.own))
        width, so_far, at = len(self.ids), np.cumsum(of_own), 0
        while at < len(self.own):
            gone = so_far[at - 1] if at else 0.0
            stop = max(at + 1, int(np.searchsorted(so_far, STEP + gone)))
            met = (lambda to: min(width, int(so_far[to - 1] - gone))) if near else lambda to: width
            while stop > at + 1 and (stop - at) * met(stop) > CELLS:
                stop = max(at + 1, min(stop - 1, at + max(self.rows, (stop - at) * 3 // 4)))
            yield self.own[at:stop], (stop - at) * met(stop)
            at = stop

    def met(self, ends: np.ndarray) -> tuple[np.ndarray, int]:
        """A number for each of the ends of a run, equal for equal ones, and how many there are."""
        if len(self.ids) <= len(ends):
            return ends, len(self.ids)
        order = np.arange(len(ends), dtype=np.int32)
        self.place[ends] = order
        first = ends[self.place[ends] == order]
        self.place[first] = np.arange(len(first), dtype=np.int32)
        return self.place[ends].astype(np.int64), len(first)


def _by_graph(work: Callable[[Lists, pa.Table], Iterator[dict]], schema: pa.Schema):
    """A function of a block's table: ``work`` on each graph in it, whose columns get the graph's name."""
    def run(table: pa.Table) -> pa.Table:
        made = []
        names = table.column(GRAPH)
        for name in names.unique():
            part = table.filter(pc.equal(names, name)).combine_chunks()
            lists = Lists(*_opened(part))
            for columns in work(lists, part):
                rows = len(next(iter(columns.values())))
                arrays = [pa.repeat(name, rows) if f.name == GRAPH else columns[f.name] for f in schema]
                made.append(pa.Table.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    return run


def _schema(**columns: pa.DataType) -> pa.Schema:
    return pa.schema([(GRAPH, pa.string()), *columns.items()])


def _edge(lists: Lists, a: np.ndarray, b: np.ndarray) -> dict:
    # Places are in the order of ids.
    return {"u": lists.ids[np.minimum(a, b)], "v": lists.ids[np.maximum(a, b)]}


def _count_triangles(lists: Lists, _: pa.Table) -> Iterator[dict]:
    width = len(lists.ids)
    steps = [*lists.near_steps()]
    touches = np.zeros(max((cells for _, cells in steps), default=0), bool)
    for own, _ in steps:
        row, y = lists.ends(own)
        arc, z = lists.ends(y)
        number, met = lists.met(np.concatenate([y, z]))
        mark = row * met + number[:len(y)]
        touches[mark] = True
        hit = np.flatnonzero(touches[row[arc] * met + number[len(y):]])
        touches[mark] = False
        x, y, z = own[row[arc[hit]]], y[arc[hit]], z[hit]
        edges, times = np.unique(np.concatenate([np.minimum(a, b) * width + np.maximum(a, b) for a, b in ((x, y), (x, z), (y, z))]), return_counts=True)
        if len(edges):
            yield {**_edge(lists, edges // width, edges % width), "n": times}


def triangle_counts(lists: DataFrame, above: DataFrame, own: DataFrame, path: str) -> DataFrame:
    """``(graph_id, u, v, n)``: triangles found from the nodes of the blocks.

    ``lists`` holds each edge once, from the lower to the higher end of an order of the nodes, and ``above`` from the
    higher one: a list goes to the blocks of the nodes below its own.
    """
    ends = above.select(GRAPH, "node", F.col("ns").alias("to"), F.col("k").alias("below"))
    # A node above all others has no list; no path goes on from it.
    rows = lists.select(GRAPH, "node", "ns").join(ends, [GRAPH, "node"], "left").select(
        GRAPH, "node", "ns", "to", F.coalesce("below", F.lit(0)).alias("k"))
    in_a_block = own.select(GRAPH, "node", F.lit(True).alias("light"))
    rows = rows.join(in_a_block, [GRAPH, "node"], "left").withColumn("light", F.coalesce("light", F.lit(False)))
    schema = _schema(u=pa.int64(), v=pa.int64(), n=pa.int64())
    return in_waves(stage(rows, "wanted-lists"), own, _count_triangles, schema, {"n"}, path)


def _closed(lists: Lists, arc: np.ndarray, end: np.ndarray, asked: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each path p - c - q of ``asked``, the common neighbours of p, c and q.

    ``arc`` and ``end`` are all paths by arc (p, c), in order; ``near`` marks those whose end touches p.
    """
    width, found = len(lists.ids), np.zeros(len(arc), np.int64)
    wanted = np.zeros(int(arc[-1]) + 1, bool)
    wanted[arc[asked]] = True
    at = np.flatnonzero(near & wanted[arc])
    sizes = np.cumsum(lists.size[lists.of[end[at]]])
    places = np.flatnonzero(asked)
    keys = arc[places] * width + end[places]
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(sizes, STEP + (sizes[start - 1] if start else 0))))
        some = at[start:stop]
        owner, q = lists.ends(end[some])
        key = arc[some][owner] * width + q
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found += np.bincount(places[place[keys[place] == key]], minlength=len(found))
        start = stop
    return found


def _count_codegrees(lists: Lists, _: pa.Table) -> Iterator[dict]:
    steps = [*lists.near_steps()]
    most = max((cells for _, cells in steps), default=0)
    times, touches, one = np.zeros(most, np.int32), np.zeros(most, bool), np.int32(1)
    for own, _ in steps:
        row, c = lists.ends(own)
        arc, q = lists.ends(c)
        number, met = lists.met(np.concatenate([c, q]))
        mark, key = row * met + number[:len(c)], row[arc] * met + number[len(c):]
        touches[mark] = True
        np.add.at(times, key, one)
        # The other common neighbours of p and q; p itself counts for none.
        others, near, back = times[key] - 1, touches[key], q == own[row][arc]
        others[back] = 0
        asked = ~near & ~back & (others > 0)
        times[key], touches[mark] = 0, False
        is_open = asked & (others > _closed(lists, arc, q, asked, near)) if asked.any() else asked
        first = np.flatnonzero(np.diff(arc, prepend=-1))
        deg_p, deg_c, p_first = lists.size[lists.of[own]][row], lists.size[lists.of[c]], own[row] < c
        yield {
            **_edge(lists, own[row], c), "deg_u": np.where(p_first, deg_p, 0), "deg_v": np.where(p_first, deg_c, 0),
            "both": np.where(p_first, np.add.reduceat(near.astype(np.int64), first), 0),
            "through": np.maximum.reduceat(others, first), "open": np.add.reduceat(is_open.astype(np.int64), first)}


def codegree_counts(lists: DataFrame, own: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """``(graph_id, u, v)`` and those of ``deg_u, deg_v, both, through, open`` that are in ``columns``, which paths p - c - q add to an edge.

    ``lists`` holds both directions of every edge, and every node with a list is in a block. ``both`` is the number of q next to p, which are the
    common neighbours of p and c, ``through`` the largest number of other common neighbours of an end and a q next to the other one, ``open`` the
    number of q not next to their end for which one of these does not touch the other one. What does not depend on the end is told
    by the lower one only.
    """
    schema = _schema(**dict.fromkeys(("u", "v", *columns), pa.int64()))
    return in_waves(lists, own, _count_codegrees, schema, {"open"}, path)


def _only_far(lists: Lists, _: pa.Table) -> Iterator[dict]:
    steps = [*lists.near_steps()]
    touches = np.zeros(max((cells for _, cells in steps), default=0), bool)
    for own, _ in steps:
        row, c = lists.ends(own)
        arc, q = lists.ends(c)
        number, met = lists.met(np.concatenate([c, q]))
        mark = row * met + number[:len(c)]
        touches[mark] = True
        alone = ~touches[row[arc] * met + number[len(c):]] & (q != own[row][arc])
        touches[mark] = False
        ends = np.concatenate([[0], np.cumsum(np.bincount(arc[alone], minlength=len(c)))])
        yield {**_edge(lists, own[row], c), "far_u": c < own[row], "nodes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lists.ids[q[alone]]))}


def far_neighbors(lists: DataFrame, own: DataFrame, count: int, block: int) -> DataFrame:
    """``(graph_id, u, v, far_u, nodes)``: for each edge of a node p of the blocks, what its other end touches and p does not.

    ``far_u`` tells that the other end is u. ``lists`` holds both directions of every edge; nodes of more than ``block`` paths
    are in no block.
    """
    schema = _schema(u=pa.int64(), v=pa.int64(), far_u=pa.bool_(), nodes=pa.list_(pa.int64()))
    return _by_block(dealt(lists.withColumn("light", F.col("load") <= block), _starts(own)), count, _only_far, schema)


def _walk(lists: Lists, own: np.ndarray, depth: int, seen: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Per depth the cells (row of own, node) first reached there, by row; they stay marked in ``seen`` by depth + 1."""
    width = len(lists.ids)
    levels = [np.arange(len(own)) * width + own]
    seen[levels[0]] = 1
    for step in range(1, depth + 1):
        owner, end = lists.ends(levels[-1] % width)
        cell = (levels[-1] // width)[owner] * width + end
        cell = cell[seen[cell] == 0]
        number = np.arange(len(cell), dtype=last.dtype)
        last[cell] = number
        cell = cell[last[cell] == number]
        seen[cell] = step + 1
        levels.append(cell)
    return levels


def _reach(depth: int):
    def work(lists: Lists, _: pa.Table) -> Iterator[dict]:
        width = len(lists.ids)
        seen, last = np.zeros((2, lists.rows * width), np.int32)
        for own in lists.steps(depth):
            levels = _walk(lists, own, depth, seen, last)
            for dist, cells in enumerate(levels):
                seen[cells] = 0
                sizes = np.bincount(cells // width, minlength=len(own))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield {"source": lists.ids[own], "dist": np.full(len(own), dist), "nodes": pa.ListArray.from_arrays(ends, pa.array(lists.ids[cells % width]))}

    return work


def reached(arcs: DataFrame, lists: DataFrame, own: DataFrame, count: int, depth: int) -> DataFrame:
    """``(graph_id, source, dist, nodes)``: all nodes at each distance up to ``depth`` from the nodes of the blocks."""
    schema = _schema(source=pa.int64(), dist=pa.int32(), nodes=pa.list_(pa.int64()))
    return _by_block(delivered(arcs, lists, own, depth - 1), count, _reach(depth), schema)


def _meet(depth: int):
    def work(lists: Lists, rows: pa.Table) -> Iterator[dict]:
        width = len(lists.ids)
        seen, last = np.zeros((2, lists.rows * width), np.int32)
        wanted = rows["wanted"].combine_chunks()
        sources = np.repeat(rows["node"].to_numpy(), wanted.value_lengths().fill_null(0).to_numpy())
        order = np.argsort(sources, kind="stable")
        sources, targets = np.searchsorted(lists.ids, sources[order]), np.searchsorted(lists.ids, wanted.flatten().to_numpy()[order])
        for own in lists.steps(depth - 1):
            levels = _walk(lists, own, depth - 1, seen, last)
            low, high = np.searchsorted(sources, own[0]), np.searchsorted(sources, own[-1], "right")
            source, target = sources[low:high], targets[low:high]
            owner, end = lists.ends(target)
            step = seen[np.searchsorted(own, source)[owner] * width + end]
            hit = step > 0
            dist = np.full(len(source), depth + 1)
            np.minimum.at(dist, owner[hit], step[hit].astype(dist.dtype))
            for cells in levels:
                seen[cells] = 0
            near = dist <= depth
            yield {"source": lists.ids[source[near]], "node": lists.ids[target[near]], "dist": dist[near]}

    return work


def pair_distances(arcs: DataFrame, lists: DataFrame, own: DataFrame, wanted: DataFrame, count: int, depth: int) -> DataFrame:
    """``(graph_id, source, node, dist)`` of the wanted pairs of two nodes that lie up to ``depth`` apart.

    Walks from the sources, which are the nodes of the blocks, end one step before; the last one is the lists of
    the wanted nodes.
    """
    pairs = wanted.join(own.withColumnRenamed("node", "source"), [GRAPH, "source"])
    rows = delivered(arcs, lists, own, max(depth - 2, 0), pairs.select(GRAPH, "block", "node").distinct())
    asked = pairs.groupBy(GRAPH, "block", F.col("source").alias("node")).agg(F.collect_list("node").alias("wanted"))
    schema = _schema(source=pa.int64(), node=pa.int64(), dist=pa.int32())
    return _by_block(rows.join(asked, [GRAPH, "block", "node"], "left"), count, _meet(depth), schema)
