"""Coreness of graphs by blocks of vertices, which tell each other their values and nothing else.

A block has its vertices' neighbours as numbers of places, in a file of its own in the shared folder; what a round
shuffles is one row for each pair of blocks: the values of those vertices of one that have neighbours in the other.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospect.sources.scratch import cut, file_bytes, new_file, shared_folder

#: Ends of edges that a block has, about: ``LEAST`` at first, and more as a graph grows that has ``GRID`` blocks, up to ``ENDS``. No vertex of a block has more of them.
LEAST, GRID, ENDS = 1 << 18, 24, 1 << 21
#: Edges that a task deals out at a time.
DEALT = 1 << 18
#: Groups whose number of blocks may be sent to all tasks.
SENT_GROUPS = 1 << 18


def put(folder: str, **arrays: np.ndarray) -> str:
    """The address of a new file with these arrays."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    return new_file(folder, ".npz", held.getbuffer())


def get(uri: str):
    return np.load(io.BytesIO(file_bytes(uri)))


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the greatest takes."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else "u1")


def settled(values: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values, of which the first are the block's own, when each of these is at most the h-index of its neighbours'.

    ``places[starts[i] : starts[i + 1]]`` are the neighbours of the vertex ``i``; the others' values stay as they are.
    """
    own, degree, values = len(starts) - 1, np.diff(starts), values.copy()
    while True:
        near, now = values[places], values[:own]
        low = np.add.reduceat(near >= np.repeat(now, degree), starts[:-1], dtype=np.int64) < now
        if not low.any():
            return values
        # of each vertex in ``low`` how many neighbours have which value, then how many at least that
        most = now[low].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(most + 1)])
        capped = np.minimum(near[np.repeat(low, degree)], np.repeat(now[low], degree[low]))
        count = np.bincount(np.repeat(at[:-1], degree[low]) + capped, minlength=at[-1])
        least = np.append(np.cumsum(count[::-1])[::-1], 0)
        level = np.arange(at[-1]) - np.repeat(at[:-1], most + 1)
        met = (least[:-1] - np.repeat(least[at[1:]], most + 1) >= level) & (level > 0)
        values[:own][low] = np.add.reduceat(met, at[:-1], dtype=np.int64)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, to, src, dst, frm) from edges (g, src, dst, a, b): a row for each block that has ends of them, with these as arrays."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if not n or batch is not None and n < DEALT:
            continue
        table = pa.Table.from_batches(held)
        g = pc.dictionary_encode(table.column("g").combine_chunks(), null_encoding="encode")
        g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
        src, dst, a, b = (table.column(c).to_numpy() for c in ("src", "dst", "a", "b"))
        to, codes = np.concatenate([a, b]), np.tile(g.indices.to_numpy().astype(np.int64), 2)
        key = codes * (int(to.max()) + 1) + to
        order = np.argsort(key.astype(np.min_scalar_type(int(key.max()))), kind="stable")  # numbers of two bytes are sorted without comparing
        at = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = [np.concatenate(x)[order] for x in ((src, dst), (dst, src), (b, a))]
        lists = [pa.array([part.tobytes() for part in np.split(x, at[1:])], pa.binary()) for x in ends]
        first = order[at]
        yield pa.RecordBatch.from_arrays([g.dictionary.take(pa.array(codes[first])), pa.array(to[first], pa.int32()), *lists], ["g", "to", "src", "dst", "frm"])
        held, n = [], 0


def _built(table: pa.Table, folder: str) -> tuple[int, str, list[tuple[int, np.ndarray]]]:
    """A block's number, its file, and from which block it asks for which vertices."""
    block = table.column("to")[0].as_py()
    src, dst, of = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("src", np.int64), ("dst", np.int64), ("frm", np.int32)))
    order = np.argsort(src, kind="stable")
    src, dst, of = src[order], dst[order], of[order]
    starts = np.append(np.flatnonzero(np.diff(src, prepend=src[0] - 1)), len(src))
    own = src[starts[:-1]]
    places, far = np.zeros(len(dst), np.int32), of != block
    places[~far] = np.searchsorted(own, dst[~far])
    asked, first, code_far = np.unique(dst[far], return_index=True, return_inverse=True)
    home = of[far][first]
    by_home = np.argsort(home, kind="stable")
    place = np.empty(len(asked), np.int32)
    place[by_home] = np.arange(len(asked), dtype=np.int32) + len(own)
    places[far] = place[code_far]
    homes, at = np.unique(home[by_home], return_index=True)
    lists = np.split(asked[by_home], at[1:]) if len(homes) else []
    file = put(folder, ids=own, starts=starts, places=places, homes=homes, counts=np.array([len(x) for x in lists], np.int64))
    return block, file, list(zip(homes.tolist(), lists))


def cores(edges: DataFrame) -> DataFrame:
    """(g, vid, core) of the vertices of each graph g of edges (g, src, dst), whole numbers, each edge once and none a loop.

    Each vertex takes the h-index of its neighbours' values until nothing changes. No vertex may have more than ``ENDS`` neighbours.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["g"]
    ends = F.count(F.lit(1)) * 2
    blocks = cut(edges.groupBy("g").agg(F.least(F.ceil(ends / LEAST), F.greatest(F.lit(GRID), F.ceil(ends / ENDS))).cast("int").alias("blocks")), "blocks")
    n_groups, n_blocks = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    if n_groups == 1:
        one = blocks.first()["blocks"]
        known = edges.withColumn("blocks", F.lit(one))
    else:
        known = edges.join(F.broadcast(blocks) if n_groups <= SENT_GROUPS else blocks.hint("merge"), "g")
    tasks = max(1, min(n_blocks, 16 * spark.sparkContext.defaultParallelism))
    folder = f"{shared_folder(spark)}/cores-{uuid.uuid4().hex}"
    sent = f"g {kind}, to int, frm int, data binary, file string, routes string, changed boolean"

    def rows(table: pa.Table, to: list, frm: list, data: list, file: list, routes: list, changed: list) -> pa.RecordBatch:
        g = pa.array([table.column("g")[0].as_py()] * len(to), table.schema.field("g").type)
        return pa.RecordBatch.from_arrays([g, pa.array(to, pa.int32()), pa.array(frm, pa.int32()), pa.array(data, pa.binary()), pa.array(file, pa.string()), pa.array(routes, pa.string()), pa.array(changed, pa.bool_())], ["g", "to", "frm", "data", "file", "routes", "changed"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        block, file, asks = _built(table, folder)
        yield rows(table, [block], [block], [b""], [file], [None], [True])
        for home, ids in asks:
            yield rows(table, [home], [block], [ids.tobytes()], [None], [None], [True])

    def told(table: pa.Table, block: int, file: str, routes: str, values: np.ndarray, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """The values to those who asked, one row for each, and to the block itself."""
        to, yes = get(routes), False
        for listener, part in zip(to["blocks"].tolist(), np.split(to["places"], np.cumsum(to["counts"])[:-1]) if len(to["blocks"]) else []):
            yes = yes or before is None or bool((values[part] != before[part]).any())
            yield rows(table, [listener], [block], [_packed(values[part])], [None], [None], [False])
        # a change counts if somebody hears of it
        yield rows(table, [block], [block], [_packed(values)], [file], [routes], [yes])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        frm, data = table.column("frm").to_pylist(), table.column("data")
        block = table.column("to")[0].as_py()
        file = table.column("file")[frm.index(block)].as_py()
        held = get(file)
        ids = held["ids"]
        asked = sorted((f, i) for i, f in enumerate(frm) if f != block)
        found = [np.searchsorted(ids, np.frombuffer(data[i].as_py(), np.int64)).astype(np.int32) for _, i in asked]
        routes = put(folder, blocks=np.array([f for f, _ in asked], np.int32), counts=np.array([len(x) for x in found], np.int64), places=np.concatenate(found) if found else np.zeros(0, np.int32))
        yield from told(table, block, file, routes, np.diff(held["starts"]), None)

    def heard(table: pa.Table):
        """A block's number, its own row, its file and the values of all places."""
        frm, data = table.column("frm").to_pylist(), table.column("data")
        block = table.column("to")[0].as_py()
        by = {f: i for i, f in enumerate(frm)}
        held = get(table.column("file")[by[block]].as_py())
        own = _unpacked(data[by[block]].as_py(), len(held["ids"]))
        others = [_unpacked(data[by[h]].as_py(), n) for h, n in zip(held["homes"].tolist(), held["counts"].tolist())]
        return block, by[block], held, np.concatenate([own, *others]).astype(np.int32)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        block, at, held, before = heard(table)
        values = settled(before, held["starts"], held["places"])
        own = len(held["ids"])
        yield from told(table, block, table.column("file")[at].as_py(), table.column("routes")[at].as_py(), values[:own], before[:own])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = get(batch.column("file")[i].as_py())["ids"]
                core = _unpacked(batch.column("data")[i].as_py(), len(ids))
                g = pa.array([batch.column("g")[i].as_py()], batch.schema.field("g").type).take(pa.array(np.zeros(len(ids), np.int64)))
                yield pa.RecordBatch.from_arrays([g, pa.array(ids, pa.int64()), pa.array(core.astype(np.int64))], ["g", "vid", "core"])

    def grouped(df: DataFrame, f) -> DataFrame:
        return df.repartition(tasks, "g", "to").groupBy("g", "to").applyInArrow(f, sent)

    block_of = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    dealt = known.select("g", "src", "dst", block_of("src").alias("a"), block_of("dst").alias("b")).mapInArrow(_dealt, f"g {kind}, to int, src binary, dst binary, frm binary")
    now = cut(grouped(grouped(dealt, build), begin), "cores")
    while True:
        now = cut(grouped(now, step), "cores")
        if now.where("changed").isEmpty():
            break
    return now.where("frm = to").select("g", "to", "data", "file").repartition(tasks, "g", "to").mapInArrow(end, f"g {kind}, vid long, core long")
