"""All pairs of rows in tiles: blocks of nodes meet each other, and no row is made for a common member.

A join over common members makes a row for each of them and each pair. Where that is more than
the table dealt once to every block, the pairs are counted by workers in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import written

#: Nodes of a block, about.
WIDTH = 4_096
#: Fewest blocks, so that small tables keep some workers busy.
FEWEST = 4
#: Rows that are packed together before they are shuffled, about.
PACK_ROWS = 1_000_000

Run = Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]]


def blocks_of(nodes: int, wide: int = 1) -> int:
    """Blocks of ``wide`` times ``WIDTH`` nodes; each is dealt out as often as there are blocks."""
    return max(FEWEST, -(-nodes // (WIDTH * wide)))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``rows`` rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def places(column: pa.ChunkedArray, values: pa.Array) -> np.ndarray:
    return pc.index_in(column.cast(values.type), value_set=values).to_numpy().astype(np.int32)


def _lists(ids: pa.Array, key: np.ndarray, values: int) -> bytes:
    """Nodes with their members, as steps from one to the next; ``key``: the distinct place of a node * ``values`` + member, in order."""
    node, member = key // values, key % values
    start = np.flatnonzero(np.diff(node, prepend=-1))
    step = np.diff(member, prepend=0)
    step[start] = member[start]
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(step.astype(np.int32)))
    table, sink = pa.table({"node": ids.take(pa.array(node[start])), "members": lists}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def listed(data: pa.Scalar) -> pa.Table:
    """(node, member) of a block of :func:`packed`, in order."""
    table = pa.ipc.open_stream(data.as_buffer()).read_all()
    lists = table["members"].combine_chunks()
    step, n = lists.values.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
    start = np.cumsum(n) - n
    total = np.cumsum(step)
    return pa.table({"node": table["node"].take(pa.array(np.repeat(np.arange(len(n)), n))), "member": total - np.repeat(total[start] - step[start], n)})


def packed(rows: DataFrame, values: pa.Array, blocks: int, least: int) -> DataFrame:
    """(block, data): by blocks of nodes, the distinct members of each node that has ``least`` or more. ``rows`` are (node, item)
    without nulls; a member is the item's place in ``values``. Rows are packed before they are shuffled, too."""
    handed, size = rows.sparkSession.sparkContext.broadcast(values), len(values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_parts(batches, PACK_ROWS):
            (ids, u), member, of = coded(table["node"]), places(table["item"], handed.value), table["block"].to_numpy()
            block = np.zeros(len(ids), dtype=np.int64)
            block[u] = of
            order = np.argsort(block, kind="stable")
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.arange(len(ids))
            key = np.unique(rank[u] * size + member)
            cut = np.searchsorted(block[order][key // size], np.arange(blocks + 1))
            on, ids = np.flatnonzero(np.diff(cut)), ids.take(pa.array(order))
            data = [_lists(ids, key[cut[i] : cut[i + 1]], size) for i in on]
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(data, pa.binary())], names=["block", "data"])

    def merge(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([listed(x) for x in table["data"]])
        ids, u = coded(rows["node"])
        order = pc.sort_indices(ids)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(ids))
        key = np.unique(rank[u] * size + rows["member"].to_numpy())
        key = key[np.bincount(key // size, minlength=len(ids))[key // size] >= least]  # a node with fewer has no edge
        data = [_lists(ids.take(order), key, size)] if len(key) else []
        return pa.table({"block": table["block"][: len(data)], "data": pa.array(data, pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).mapInArrow(pack, "block int, data binary")
    return written(dealt.groupBy("block").applyInArrow(merge, "block int, data binary"), "blocks")


def over_pairs(rows: DataFrame, node: str, blocks: int, run: Run, schema: str, opened: Callable[[pa.Scalar], pa.Table] | None = None) -> DataFrame:
    """``run`` over every two blocks of ``rows``: it gets their tables in the order of ``node``, and
    whether they are one block. Blocks are packed once; a row of the shuffle is a block. With ``opened``
    the rows are blocks (block, data) already, which it opens."""

    def pack(table: pa.Table) -> pa.Table:
        block, sink = table["_block"][:1], pa.BufferOutputStream()
        table = table.drop_columns(["_block"]).sort_by(node)
        for i, column in enumerate(table.columns):  # ratings repeat, and their bytes do not compress
            if pa.types.is_floating(column.type):
                table = table.set_column(i, table.column_names[i], column.combine_chunks().dictionary_encode())
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.table({"block": block, "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def plain(data: pa.Scalar) -> pa.Table:
        table = pa.ipc.open_stream(data.as_buffer()).read_all()
        return table.cast(pa.schema([(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in table.schema]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch["a"][i].as_py(), batch["b"][i].as_py()
                table = (opened or plain)(batch["data"][i])
                if pair[0] == pair[1]:
                    yield from run(table, table, True)
                elif pair == last:
                    yield from run(held, table, False)
                    last, held = None, None
                else:
                    last, held = pair, table

    if opened is None:
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int"))
        rows = written(dealt.groupBy("_block").applyInArrow(pack, "block int, data binary"), "blocks")
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "data")
    pairs = blocks * (blocks + 1) // 2
    return met.repartition(min(pairs, 1_000), "a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(work, schema)


def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a sorted column in order, and the place of each row's value."""
    got = column.combine_chunks().dictionary_encode()
    return got.dictionary, got.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ordered(x: pa.Array, y: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Both blocks' nodes in one array, and the ranks of each block's."""
    both = pa.concat_arrays([x, y])
    rank = np.empty(len(both), dtype=np.int64)
    rank[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
    return both, rank[: len(x)], rank[len(x) :]


def shared(x: pa.Table, y: pa.Table, same: bool, least: int, share: float | None = None) -> tuple[pa.Array, pa.Array, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The nodes of both blocks, and for the place of each node of the first that shares enough with others: the
    places of those, how many members both have, and how many either has. See :func:`common`."""
    (ids, u), (others, v) = coded(x["node"]), coded(y["node"])
    m, n = x["member"].to_numpy(), y["member"].to_numpy()
    sizes, others_sizes = np.bincount(u, minlength=len(ids)), np.bincount(v, minlength=len(others))
    order = np.argsort(n, kind="stable")
    known, start = np.unique(n[order], return_index=True)
    lists = np.split(v[order], start[1:])
    at = np.minimum(np.searchsorted(known, m), len(known) - 1)
    hit = known[at] == m
    u, at = u[hit], at[hit].tolist()
    ends = np.searchsorted(u, np.arange(len(ids) + 1)).tolist()

    def counted() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(len(ids)):
            lo, hi = ends[i], ends[i + 1]
            if hi - lo < least:
                continue
            n_common = np.bincount(np.concatenate([lists[k] for k in at[lo:hi]]), minlength=len(others))
            if same:
                n_common[: i + 1] = 0
            enough = n_common >= least
            if share is not None:
                enough &= n_common >= (sizes[i] + others_sizes - n_common) * share
            found = np.flatnonzero(enough)
            if len(found):
                yield i, found, n_common[found], sizes[i] + others_sizes[found] - n_common[found]

    return ids, others, counted()


def common(least: int, share: float | None = None) -> Run:
    """(a, b, common) of the nodes that share ``least`` members or more, or with a ``share`` (a, b,
    common, either) of those that share that part of the members that either has; rows are
    distinct (node, member) with whole numbers as members. A node's members name the lists of
    the other block's nodes, whose entries are counted."""

    def run(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        ids, others, counted = shared(x, y, same, least, share)
        both, rank, ranks = ordered(ids, others)
        left, right, counts, wholes, size = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            i, j = np.concatenate(left), np.concatenate(right)
            first = rank[i] < ranks[j] if not same else np.ones(len(i), dtype=bool)
            a, b = np.where(first, i, len(ids) + j), np.where(first, len(ids) + j, i)
            columns = {"a": both.take(pa.array(a)), "b": both.take(pa.array(b)), "common": pa.array(np.concatenate(counts))}
            if share is not None:
                columns["either"] = pa.array(np.concatenate(wholes))
            return pa.RecordBatch.from_pydict(columns)

        for i, found, n_common, either in counted:
            left.append(np.full(len(found), i))
            right.append(found)
            counts.append(n_common)
            wholes.append(either)
            size += len(found)
            if size > 200_000:
                yield batch()
                left, right, counts, wholes, size = [], [], [], [], 0
        if size:
            yield batch()

    return run


#: Nodes of one side and members that are laid out as matrices at a time.
ROWS, COLUMNS = 256, 256


class _Cells:
    """The rows (node, member, rating, ..) of a block; members are whole numbers."""

    def __init__(self, table: pa.Table):
        self.ids, u = coded(table["node"])
        m = table["member"].to_numpy()
        rated = table["rated"].to_numpy() if "rated" in table.column_names else np.ones(len(u), dtype=bool)
        x = np.nan_to_num(table["rating"].to_numpy().astype(float))
        part = m // COLUMNS
        self.parts = np.unique(part[rated]).tolist()
        self.at = {p: np.flatnonzero(rated & (part == p)) for p in self.parts}
        self.u, self.m, self.x = u, m % COLUMNS, x
        self.columns = min(COLUMNS, int(m.max(initial=0)) + 1)
        if "mean" in table.column_names:
            near = table["near"].to_numpy()
            dev = table["rating"].to_numpy().astype(float) - table["mean"].to_numpy().astype(float)
            self.dev, self.near = np.nan_to_num(np.where(near, dev, 0.0)), near.astype(float)
            ask = np.flatnonzero(~rated)
            self.wanted = {p: ask[part[ask] == p] for p in np.unique(part[ask]).tolist()}
        self.width = len(self.ids)

    def laid(self, part: int, lo: int, hi: int, columns: int, *values: np.ndarray) -> list[np.ndarray]:
        """Sums of each of ``values`` by node (``lo`` to ``hi``) and member of a part, of which there are ``columns``."""
        at = self.at[part] if part in self.at else np.zeros(0, dtype=np.int64)
        a, b = np.searchsorted(self.u[at], (lo, hi))
        at = at[a:b]
        cell = (self.u[at] - lo) * columns + self.m[at]
        return [np.bincount(cell, v[at], minlength=(hi - lo) * columns).reshape(hi - lo, columns) for v in values]


def _correlated(x: _Cells, y: _Cells, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, n, weight) for tiles of the first block's nodes and all of the second's; NaN where there is no weight."""
    parts = [p for p in x.parts if p in y.at]
    columns = max(x.columns, y.columns)
    sides = {}
    for lo in range(0, x.width, ROWS):
        hi = min(lo + ROWS, x.width)
        n, sx, sy, sxy, sxx, syy = (np.zeros((hi - lo, y.width)) for _ in range(6))
        for p in parts:
            m, r, q = x.laid(p, lo, hi, columns, np.ones(len(x.x)), x.x, x.x * x.x)
            if p not in sides:
                sides = {} if len(parts) > 1 else sides
                sides[p] = [np.ascontiguousarray(v.T) for v in y.laid(p, 0, y.width, columns, np.ones(len(y.x)), y.x, y.x * y.x)]
            k, s, t = sides[p]
            for out, one, two in ((n, m, k), (sx, r, k), (sy, m, s), (sxy, r, s), (sxx, q, k), (syy, m, t)):
                out += one @ two
        with np.errstate(divide="ignore", invalid="ignore"):
            cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
            # Sums of rounded numbers: what is below 1e-9 is zero.
            ok = (n >= least) & (np.abs(cov) > 1e-9) & (vx > 1e-9) & (vy > 1e-9)
            w = cov / np.sqrt(vx) / np.sqrt(vy)
            w = np.where(ok, np.copysign(np.floor(np.abs(w) * 1e6 + 0.5) / 1e6, w) + 0.0, np.nan)
        yield lo, hi, n, w


def pearson(least: int) -> Run:
    """(a, b, n, weight) of all pairs with ``least`` common members or more; rows are (node, member, rating)."""

    def run(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        one, two = _Cells(x), _Cells(y)
        both, rank, ranks = ordered(one.ids, two.ids)
        for lo, hi, n, w in _correlated(one, two, least):
            met = n >= least
            if same:
                met &= np.arange(lo, hi)[:, None] < np.arange(two.width)
            cell = np.flatnonzero(met)
            for at in np.array_split(cell, max(1, len(cell) // 100_000)):
                i, j = lo + at // two.width, at % two.width
                first = np.ones(len(at), dtype=bool) if same else rank[i] < ranks[j]
                a, b = np.where(first, i, len(rank) + j), np.where(first, len(rank) + j, i)
                weight = w.ravel()[at]
                yield pa.RecordBatch.from_arrays(
                    [both.take(pa.array(a)), both.take(pa.array(b)), pa.array(n.ravel()[at].astype(np.int64)), pa.array(weight, mask=np.isnan(weight))], names=["a", "b", "n", "weight"]
                )

    return run


def neighbours(least: int) -> Run:
    """(node, member, num, den): for each wanted cell the sums of weight * dev and of the weights'
    sizes over the other block's nodes that rated the member. Rows are (node, member, rating,
    mean, near, rated), ``mean`` that of the node; those that are not rated are wanted, and ``near`` marks neighbours."""

    def run(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        one, two = _Cells(x), _Cells(y)
        columns = max(one.columns, two.columns)
        back = {p: np.zeros((2, len(at))) for p, at in two.wanted.items()}
        for lo, hi, _, w in _correlated(one, two, least):
            w = np.nan_to_num(w)
            if same:
                w[np.arange(hi - lo), np.arange(lo, hi)] = 0.0
            size = np.abs(w)
            for p, at in one.wanted.items():
                at = at[(one.u[at] >= lo) & (one.u[at] < hi)]
                if len(at) and p in two.at:
                    dev, near = two.laid(p, 0, two.width, columns, two.dev, two.near)
                    cell = one.u[at] - lo, one.m[at]
                    yield from _sums(one, p, at, (w @ dev)[cell], (size @ near)[cell])
            for p, at in () if same else two.wanted.items():
                if p in one.at:
                    dev, near = one.laid(p, lo, hi, columns, one.dev, one.near)
                    cell = two.u[at], two.m[at]
                    back[p] += (w.T @ dev)[cell], (size.T @ near)[cell]
        for p, at in () if same else two.wanted.items():
            yield from _sums(two, p, at, *back[p])

    return run


def _sums(cells: _Cells, part: int, at: np.ndarray, num: np.ndarray, den: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(den > 0)
    node, member = cells.ids.take(pa.array(cells.u[at][some])), pa.array(part * COLUMNS + cells.m[at][some])
    yield pa.RecordBatch.from_arrays([node, member, pa.array(num[some]), pa.array(den[some])], names=["node", "member", "num", "den"])
