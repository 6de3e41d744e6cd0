"""Near-duplicate embeddings by an exact metric range join (operator 6).

Unit vectors at cosine c lie at Euclidean distance r = sqrt(2 - 2c). Pivots partition the vectors: each belongs to the
cell of its nearest pivot. The triangle inequality sets the boundary replication. A vector y of the cell of pivot q lies on
q's side of the plane midway between q and any other pivot p, so a vector x of p's cell that is further than r from that
plane reaches no such y; nor does it if it is further from q than r and the radius of q's cell. x meets the cells that
neither bound rules out.

The number of pivots follows from the data: for several numbers a sample tells how often a vector would be replicated and
how many pairs would be compared, and the cheapest one for the size of the table is taken. Identical vectors are one class
first. A cell is cut into blocks of bounded size, which are written once to the shared folder, and a task reads the blocks
that its own block may have links with one after the other: replicas are read, never shuffled or stored. Each two blocks
meet once, in a matrix product; it returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch, connected_components, held, store, temporary
from pathloom.llm.dac import _opened
from pathloom.runtime import hadoop_path


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``: the components as doubles, or null for null, empty and zero vectors and those with null or non-finite parts."""
    kind = table.schema[id_col].dataType
    out = pa.schema([("id", _arrow(kind)), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            got = []
            for x in b.column(1):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    a = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                    if np.isfinite(a).all() and a.any():
                        v = (a + 0.0).tobytes()  # -0.0 becomes 0.0
                got.append(v)
            yield batch({"id": b.column(0), "v": got}, out)

    return table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind.simpleString()}, v binary")


def unit(rows: list[bytes], size: int) -> np.ndarray:
    """Unit vectors, padded with zeros to a common size."""
    out = np.zeros((len(rows), size))
    for k, r in enumerate(rows):
        a = np.frombuffer(r, "<f8")
        out[k, : len(a)] = a
    peak = np.abs(out).max(1, keepdims=True)
    out /= np.where(peak > 0, peak, 1)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def _squares(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ pivots.T) + np.einsum("ij,ij->i", pivots, pivots))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the distance to it; a bounded number of distances is held at once."""
    at, d, step = np.zeros(len(x), np.int64), np.zeros(len(x)), max(16, (1 << 20) // len(pivots))
    for s in range(0, len(x), step):
        some = _squares(x[s : s + step], pivots)
        at[s : s + step] = some.argmin(1)
        d[s : s + step] = some.min(1)
    return at, np.sqrt(d)


class Cells:
    """Cells around pivots: where a vector lives and which cells it can reach within ``radius``."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius
        self.reach = np.full(len(pivots), np.inf)

    def bound(self, furthest: dict[int, float]) -> None:
        """Take the radius of each cell that has vectors; the others are out of reach."""
        self.reach = np.array([furthest[j] + self.radius + 1e-9 if j in furthest else -1.0 for j in range(len(self.pivots))])

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector and the distance to it."""
        return _nearest(x, self.pivots)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each vector, and which cells it must be copied to (its home among them)."""
        d = _squares(x, self.pivots)
        each = np.arange(len(d))
        at = d.argmin(1)
        apart = np.sqrt(_squares(self.pivots[at], self.pivots))
        # further than the radius from the plane between home and the other pivot: twice their distance from it times their own
        near = (d - d[each, at][:, None] <= 2 * self.radius * apart + 1e-9) & (np.sqrt(d) <= self.reach)
        near[each, at] = True
        return at, near

    def across(self, x: np.ndarray, home: int, other: int) -> np.ndarray:
        """Which vectors of cell ``home`` must meet those of another cell: the column of ``near`` for it."""
        d = _squares(x, self.pivots[[home, other]])
        apart = math.sqrt(_squares(self.pivots[[home]], self.pivots[[other]])[0, 0])
        return np.flatnonzero((d[:, 1] - d[:, 0] <= 2 * self.radius * apart + 1e-9) & (np.sqrt(d[:, 1]) <= self.reach[other]))

    def meets(self, cell: int) -> np.ndarray:
        """Cells that may hold links with vectors of a cell: balls around both pivots come within the radius of each other."""
        apart = np.sqrt(_squares(self.pivots[[cell]], self.pivots)[0])
        return (apart <= self.reach + self.reach[cell] - self.radius + 1e-6) & (self.reach >= 0)


def means(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Pivots: the first vectors of a sample, moved a few times to the mean of their cells; equal ones are left out."""
    pivots = sample[:count].copy()
    for _ in range(rounds):
        home = _nearest(sample, pivots)[0]
        size = np.bincount(home, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, home, sample)
        pivots = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], pivots)
    order = np.lexsort(pivots.T)
    same = np.concatenate(([False], (np.abs(np.diff(pivots[order], axis=0)) < 1e-6).all(1)))
    return pivots[np.sort(order[~same])]


def plan(sample: np.ndarray, n: int, radius: float, least: int = 16, most: int = 4096, row_cost: float = 2000.0) -> tuple[Cells, float, float]:
    """Cells for a table of ``n`` vectors, the copies of a vector, and the share of all pairs that will be compared.

    row_cost: how many compared pairs one copied vector costs as much as. ``least`` cells are made wherever eight vectors
    live in each; more only where the sample says that the copies cost less than the pairs that they save. Copies are
    counted on vectors that the pivots were not made of: a pivot's own vector lies next to it and looks as if it had none.
    """
    best, count = None, max(1, min(least, n // 8))
    apart = min(1024, len(sample) // 4)
    probe, sample = (sample[-apart:], sample[:-apart]) if apart else (sample, sample)
    while best is None or (count <= most and count * 8 <= n and count * 4 <= len(sample)):
        cells = Cells(means(sample, count), radius)
        home, far = cells.home(sample)
        size = np.bincount(home, minlength=len(cells.pivots)) / max(1, len(sample))
        cells.bound({int(j): float(far[home == j].max()) for j in np.unique(home)})
        near = cells.near(probe)[1]
        copies, share = float(near.sum(1).mean()), float((near @ size).mean())
        cost = n * copies * row_cost + float(n) * n * share
        if best is None or cost < best[0]:
            best = (cost, cells, copies, share)
        elif cost > 2 * best[0]:
            break
        count *= 2
    return best[1:]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a bipartite link matrix as stars: ``(root row, node)``; columns are numbered after the rows."""
    h = len(linked)
    left = linked.any(1)
    edges: list[tuple[int, int]] = []
    fresh = np.ones(linked.shape[1], bool)
    while left.any():
        root = int(left.argmax())
        left[root] = False
        rows = np.array([root])
        while len(rows):
            cols = linked[rows].any(0) & fresh
            fresh &= ~cols
            new = np.flatnonzero(cols)
            edges += [(root, h + int(c)) for c in new]
            if not len(new):
                break
            rows = np.flatnonzero(linked[:, new].any(1) & left)
            left[rows] = False
            edges += [(root, int(r)) for r in rows]
    return edges


class Blocks:
    """Blocks of unit vectors in files of record batches; local files are mapped, others are read a block at a time."""

    def __init__(self, top: str, size: int):
        self.top, self.size, self.files, self.open = top, size, {}, contextlib.ExitStack()

    def __call__(self, file: str, index: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """The rows ``(id, h, copies, bytes, v)`` of a block and its vectors."""
        if file not in self.files:
            files, where = _opened(f"{self.top}/{file}")
            source = pa.memory_map(where) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(where)
            self.files[file] = pa.ipc.open_file(self.open.enter_context(source))
        rows = self.files[file].get_batch(index)
        v = rows.column(4)
        return rows, np.frombuffer(v.buffers()[1], "<f8", len(v) * self.size, v.offset * self.size * 8).reshape(-1, self.size)


def hits(x: np.ndarray, y: np.ndarray, cosine: float, step: int = 256):
    """``(rows, linked)``: rows of ``x`` and which of ``y`` they are linked with, some rows at a time, only such as may have links.

    Single precision finds the rows that come close; sums of so many products differ from it by less than the margin.
    """
    low, y4 = cosine - (x.shape[1] + 8) * 2.0**-23, y.astype(np.float32)
    for s in range(0, len(x), step):
        rows = s + np.flatnonzero((x[s : s + step].astype(np.float32) @ y4.T).max(1, initial=-2) >= low)
        if len(rows):
            yield rows, x[rows] @ y.T >= cosine


def _write_blocks(classes: DataFrame, shared, slots, top: str, size: int, id_type, id_name: str) -> DataFrame:
    """Write the classes as blocks ``(cell, slot)`` under ``top``: a row ``(cell, slot, file, at, n)`` for each.

    Each task writes one file, which gets its name once it is whole.
    """
    placed_schema = pa.schema([("id", id_type), ("h", pa.int64()), ("copies", pa.int64()), ("v", pa.binary()), ("cell", pa.int32()), ("slot", pa.int32())])
    block_schema = pa.schema([("id", id_type), ("h", pa.int64()), ("copies", pa.int64()), ("bytes", pa.int64()), ("v", pa.binary(8 * size))])
    list_schema = pa.schema([("cell", pa.int32()), ("slot", pa.int32()), ("file", pa.string()), ("at", pa.int32()), ("n", pa.int64())])

    def place(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                t = b.slice(s, 1024)
                home = shared.value.home(unit([x.as_buffer() for x in t.column(3)], size))[0]
                slot = t.column(1).to_numpy() % slots.value[home]
                yield batch({k: t.column(i) for i, k in enumerate(("id", "h", "copies", "v"))} | {"cell": home.astype(np.int32), "slot": slot.astype(np.int32)}, placed_schema)

    def write(batches):
        from pyspark import TaskContext

        context, done, key, parts = TaskContext.get(), [], None, []
        name = f"part-{context.partitionId():05d}.arrow"
        files, where = _opened(f"{top}/{name}")
        draft = f"{where}.{context.attemptNumber()}-{context.taskAttemptId()}"
        sink = out = None

        def close():
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            raw = [x.as_buffer() for x in rows.column(3)]
            v = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), len(raw), [None, pa.py_buffer(unit(raw, size))])
            out.write_batch(batch({"id": rows.column(0), "h": rows.column(1), "copies": rows.column(2), "bytes": [x.size for x in raw], "v": v}, block_schema))
            done.append((*key, name, len(done), len(raw)))

        for b in batches:
            if sink is None:
                sink = files.open_output_stream(draft)
                out = pa.ipc.new_file(sink, block_schema)
            cell, slot = b.column(4).to_numpy(), b.column(5).to_numpy()
            edge = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(slot) != 0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if key != (k := (int(cell[s]), int(slot[s]))):
                    if parts:
                        close()
                    key, parts = k, []
                parts.append(b.slice(s, e - s))
        if parts:
            close()
        if sink is not None:
            out.close()
            sink.close()
            files.move(draft, where)
        if done:
            yield batch(dict(zip(list_schema.names, map(list, zip(*done, strict=True)), strict=True)), list_schema)

    placed = classes.select("id", "h", "copies", "v").mapInArrow(place, f"id {id_name}, h long, copies long, v binary, cell int, slot int")
    dealt = placed.repartition("cell", "slot").sortWithinPartitions("cell", "slot")
    return store(dealt.mapInArrow(write, "cell int, slot int, file string, at int, n long"), "blocks")


class Meetings:
    """Which blocks a block is compared with: itself and those after it whose cells may hold links with its own.

    A unit of work is a block and a part of these, of about ``rows`` vectors.
    """

    def __init__(self, cells: Cells, blocks: list[tuple], rows: int):
        self.cells, self.blocks, self.rows = cells, blocks, rows
        self.cell, self.n = np.array([b[0] for b in blocks], np.int64), np.array([b[4] for b in blocks], np.int64)
        # told by one computer, as rounding may differ on another
        self.meets = {int(c): np.packbits(cells.meets(c)) for c in np.unique(self.cell)}
        parts, self.pairs = [], 0.0
        for k in range(len(blocks)):
            others = int(self.n[self.others(k)].sum())
            parts.append(-(-others // rows))
            self.pairs += float(self.n[k]) * others
        self.ends = np.cumsum(np.array(parts, np.int64))

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def others(self, k: int) -> np.ndarray:
        """Blocks that meet block ``k``, itself first."""
        cell = int(self.cell[k])
        yes = np.unpackbits(self.meets[cell], count=len(self.cells.pivots)).view(bool)[self.cell[k:]]
        return k + np.flatnonzero(yes | (self.cell[k:] == cell))

    def unit(self, u: int) -> tuple[int, np.ndarray]:
        """The block and the others of a unit."""
        k = int(np.searchsorted(self.ends, u, side="right"))
        others = self.others(k)
        begin = np.cumsum(self.n[others]) - self.n[others]
        return k, others[begin // self.rows == u - (int(self.ends[k - 1]) if k else 0)]


def components(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, block: int = 4096, pivots: int = 16, sample_rows: int = 16384
) -> DataFrame:
    """Rows ``(id, n_links, component_id, kept)``, one for each row of ``table``.

    Links join vectors at ``cosine`` or more, in double precision; vectors of different sizes never link, nor do null,
    empty, zero or non-finite ones. n_links counts the other vectors linked directly, copies included. Rows that share
    an id are one node of the components, and each counts the links of its own vector. Null ids get a null component; an
    empty table gives no rows; other columns are not looked at.

    ``block``: vectors of a block, at most 16 MB of them; a task holds the links between two blocks. ``pivots``: the least
    number of cells of a table of eight times as many vectors. ``sample_rows``: vectors that the
    driver chooses pivots from, about, at most 64 MB; the pivots are a quarter of them at most and all that is broadcast.
    """
    spark = table.sparkSession
    rows = store(_vectors(table, id_col, vec_col), "vectors")
    kind = table.schema[id_col].dataType
    arrow, name = _arrow(kind), kind.simpleString()
    classes = rows.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = store(classes.withColumn("h", F.xxhash64("v")), "vector-classes")
    n, longest = classes.agg(F.count("*"), F.max(F.length("v"))).head()
    size = (longest or 8) // 8

    radius = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + 1e-9
    wanted = min(sample_rows, max(64, (64 << 20) // (8 * size)))
    chance = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, wanted / max(1, n))))
    sample = sorted((r["h"], bytes(r["v"])) for r in classes.where(chance).select("h", "v").collect())
    sample = unit([v for _, v in sample], size) if sample else unit([np.ones(1).tobytes()], size)
    cells = plan(sample, n, radius, least=pivots)[0]
    shared = spark.sparkContext.broadcast(cells)

    place_schema = pa.schema([("home", pa.int32()), ("d", pa.float64())])

    def place(batches):
        held("vectors", dict)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                home, d = shared.value.home(unit([x.as_buffer() for x in b.column(0).slice(s, 1024)], size))
                yield batch({"home": home.astype(np.int32), "d": d}, place_schema)

    # one row for each cell: bounded by the number of pivots
    homes = classes.select("v").mapInArrow(place, "home int, d double").groupBy("home").agg(F.max("d").alias("far"), F.count("*").alias("n")).collect()
    cells.bound({r["home"]: r["far"] for r in homes})
    block = min(block, max(256, (16 << 20) // (8 * size)))
    slots = np.ones(len(cells.pivots), np.int64)
    for r in homes:
        slots[r["home"]] = -(-r["n"] // block)
    top = temporary(spark, "cells")
    fs, where = hadoop_path(spark, top)
    fs.mkdirs(where)
    # one row for each block
    blocks = sorted(tuple(r) for r in _write_blocks(classes, shared, spark.sparkContext.broadcast(slots), top, size, arrow, name).collect())
    meetings = Meetings(cells, blocks, 64 * block)
    work = spark.sparkContext.broadcast(meetings)

    join_schema = pa.schema([("id", arrow), ("h", pa.int64()), ("links", pa.int64()), ("root", arrow)])

    def counted(rows, links):
        yes = pa.array(np.flatnonzero(links))
        return batch({"id": rows.column(0).take(yes), "h": rows.column(1).take(yes), "links": links[links > 0].astype(np.int64), "root": pa.nulls(len(yes), arrow)}, join_schema)

    def join(batches):
        held("vectors", dict)
        all_, read = work.value, Blocks(top, size)
        with read.open:
            for u in (u for b in batches for u in b.column(0).to_pylist()):
                k, others = all_.unit(u)
                own, x = read(*all_.blocks[k][2:4])
                mine, links = own.column(2).to_numpy().astype(np.float64), np.zeros(len(x))
                for m in others.tolist():
                    p, q = int(all_.cell[k]), int(all_.cell[m])
                    rows, y = (own, x) if m == k else read(*all_.blocks[m][2:4])
                    a = np.arange(len(x)) if p == q else all_.cells.across(x, p, q)
                    b = np.arange(len(y)) if p == q else all_.cells.across(y, q, p)
                    if not len(a) or not len(b):
                        continue
                    bytes_a, bytes_b = own.column(3).to_numpy()[a], rows.column(3).to_numpy()[b]
                    mixed = min(bytes_a.min(), bytes_b.min()) != max(bytes_a.max(), bytes_b.max())
                    theirs, back, found, linked = rows.column(2).to_numpy()[b].astype(np.float64), np.zeros(len(y)), [], []
                    for r, yes in hits(x if p == q else x[a], y if p == q else y[b], cosine):
                        if mixed:
                            yes &= bytes_a[r][:, None] == bytes_b[None, :]
                        if m == k:
                            yes[np.arange(len(r)), r] = False
                        some = yes.any(1)
                        if some.any():
                            found.append(a[r[some]])
                            linked.append(yes[some])
                            links[found[-1]] += linked[-1] @ theirs
                            if m != k:
                                back[b] += mine[found[-1]] @ linked[-1]
                    if found:
                        found = np.concatenate(found)
                        edges = forest(np.concatenate(linked))
                        names = pa.concat_arrays([own.column(0).take(pa.array(found)), rows.column(0).take(pa.array(b))])
                        root, node = (names.take(pa.array([e[j] for e in edges], pa.int64())) for j in range(2))
                        yield batch({"id": node, "h": [0] * len(edges), "links": [0] * len(edges), "root": root}, join_schema)
                        if m != k:
                            yield counted(rows, back)
                if links.any():
                    yield counted(own, links)

    tasks = max(1, min(len(meetings), max(24, int(meetings.pairs) >> 28)))
    found = store(spark.range(0, len(meetings), 1, tasks).mapInArrow(join, f"id {name}, h long, links long, root {name}"), "links")
    fs.delete(where, True)
    totals = found.where("root is null").groupBy("id", "h").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("root is not null"), "id", "root")

    named = (
        classes.join(totals, ["id", "h"], "left").join(component.withColumnRenamed("node", "id"), "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    named = store(named, "named")
    own_id = F.coalesce("component", "id")
    # vectors that link with nothing never meet in one task of the join
    out = rows.where("v is not null").join(named, "v", "left").select("id", "links", "component")
    out = out.unionByName(rows.where("v is null").select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast(kind).alias("component")))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), (own_id == F.col("id")).alias("kept"))
