"""Searches over vectors: an exact one through M-trees, an approximate one through quantised tables.

Both deal rows by the nearest of some routing vectors into cells, and cells into blocks with an
index each. A query first meets a block of its own cell. What it finds there is a bound: of the other cells it
visits only those whose ball can hold something as good, and takes the bound along. Blocks lie together in
regions: a query goes to a region once, whatever it meets there.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import map_arrow

PAGE = 256
FAN = 16
#: There are so many cells at most, whatever the data; their centres and balls go with each task.
MOST_CELLS = 1024
#: So many rows are compared with all cells, or coded, at a time.
ROWS = 512
#: Queries of so many full blocks meet a region in a task.
SHARE = 64
#: Blocks of a region at most, and tasks below which regions are made smaller.
REGION, TASKS = 16, 24
#: Rows of a row group where each holds an index or a block of queries.
BLOBS = 16
#: So many queries have their tables added up together, over so many rows at a time; so many pairs of the two are scored together.
ASKED, PIECE, PAIRS = 128, 1024, 8192


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array of doubles) of the rows whose vectors hold finite numbers only."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length: shorter ones are filled up with zeros, which changes no inner product."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def fitted(v: np.ndarray, wide: int) -> np.ndarray:
    """The rows cut or filled up to a width."""
    return np.ascontiguousarray(v[:, :wide]) if v.shape[1] >= wide else np.pad(v, ((0, 0), (0, wide - v.shape[1])))


class Cells:
    """Routing vectors, and of each cell how far its rows lie from there, its longest row, and the numbers of its blocks."""

    def __init__(self, sample: np.ndarray, cells: int, rounds: int = 4):
        """Centres are means of a sample's rows, moved a few times."""
        with np.errstate(over="ignore", invalid="ignore"):
            good = sample[np.isfinite((sample * sample).sum(1))] if len(sample) else sample
        self.centres = good[np.linspace(0, len(good) - 1, min(cells, len(good))).astype(int)] if len(good) else np.zeros((1, max(1, sample.shape[1] if sample.ndim == 2 else 1)))
        for _ in range(rounds if len(self.centres) > 1 else 0):
            own = self.nearest(good)[0]
            count = np.bincount(own, minlength=len(self.centres))
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, good)
            self.centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centres)
        self.radius = self.longest = self.first = self.blocks = None

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its cell, the distance to the centre there (a little more, never less), and its length. ROWS at a time, so that memory hangs on the cells alone."""
        if len(v) > ROWS:
            return tuple(map(np.concatenate, zip(*[self.nearest(v[i : i + ROWS]) for i in range(0, len(v), ROWS)], strict=True)))
        wide = self.centres.shape[1]
        x = fitted(v, wide)
        with np.errstate(over="ignore", invalid="ignore"):
            square = np.einsum("ij,ij->i", v, v)
            gap = np.einsum("ij,ij->i", self.centres, self.centres) - 2.0 * (x @ self.centres.T)
            own = np.where(np.isfinite(square), gap.argmin(1), 0)
            least = square + gap[np.arange(len(v)), own]
            far = np.sqrt(np.maximum(0.0, least)) + 1e-6 * (1.0 + np.sqrt(square))
        return own, np.where(np.isfinite(far), far, np.inf), np.sqrt(square)

    def most(self, v: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The largest inner product that a row of each cell, or of some, can have with each of the vectors."""
        longest = self.longest[some]
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            ball = fitted(v, self.centres.shape[1]) @ self.centres[some].T + size * self.radius[some]
            out = np.minimum(ball, size * longest)
            out = out + 1e-6 * (1.0 + np.abs(out)) + 1e-9 * size * longest
        return np.where(np.isnan(out), np.inf, out)

    def of(self, blocks: np.ndarray) -> np.ndarray:
        """The cells of blocks; cells without blocks have the first of the next one."""
        return np.searchsorted(self.first, blocks, side="right") - 1


def slim(v: np.ndarray) -> np.ndarray:
    """The same numbers in single precision, if it holds them."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return short if (short == v).all() else v


def best_of(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score, place from 0) of the k best of each query, ties to the smaller vec_id."""
    order = np.lexsort((v, ~s if s.dtype == np.int64 else -s, q))
    q, v, s = q[order], v[order], s[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1])))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    keep = place < k
    return q[keep], v[keep], s[keep], place[keep]


def raised(ids: np.ndarray, bounds: np.ndarray, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The bounds of queries, raised where q has a score, though never above the score itself."""
    y = s.astype(np.float64)
    y = np.where(np.abs(y) < 2**53, y, np.nextafter(y, -np.inf)) if s.dtype == np.int64 else y
    order = np.argsort(ids)
    out, at = bounds.copy(), order[np.searchsorted(ids, q, sorter=order)]
    out[at] = np.fmax(out[at], y)
    return out


def dealt(base: DataFrame, block_rows: int, every: int, width: str) -> tuple[DataFrame, Cells, np.ndarray, np.ndarray]:
    """(table of vec_id, vec, cell), its cells, and the rows and queries in each.

    Routing vectors come from a sample of 16 rows a cell, those whose ids have the smallest hashes. width: float, if it holds all components, or double.
    """
    kind = pa.list_(pa.float32() if width == "float" else pa.float64())
    rows = base.count()
    cells = min(MOST_CELLS, max(1, round(rows / block_rows)))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(16 * cells).select("vec").toArrow()
    routes = Cells(matrix(sample.column("vec")) if len(sample) else np.zeros((0, 1)), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far, size = routes.nearest(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(kind), pa.array(own, pa.int64()), pa.array(far, pa.float64()), pa.array(size, pa.float64())], ["vec_id", "vec", "cell", "far", "size"])

    table = materialize(map_arrow(base.select("vec_id", "vec"), run, f"vec_id long, vec array<{width}>, cell long, far double, size double"), "cells")
    found = table.groupBy("cell").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max("far").alias("far"), F.max("size").alias("size")).collect()
    n = len(routes.centres)
    counts, asked, routes.radius, routes.longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for r in found:
        counts[r.cell], asked[r.cell], routes.radius[r.cell], routes.longest[r.cell] = r.n, r.q, r.far, r["size"] * (1 + 1e-12)
    routes.blocks = -(-counts // block_rows)
    routes.first = np.cumsum(routes.blocks) - routes.blocks
    return table.select("vec_id", "vec", "cell"), routes, counts, asked


def split(df: DataFrame, first: np.ndarray, parts: np.ndarray, name: str, place: bool) -> DataFrame:
    """Rows with the number of their part of the cell, by a hash of the id, and of the place in the table, which is read as written."""
    at = df.sparkSession.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, parts, strict=True)) if p], "cell long, first_ long, parts_ long")
    hashed = F.xxhash64("vec_id", *([F.monotonically_increasing_id()] if place else []))
    rows = df.withColumn("hash_", hashed).join(F.broadcast(at), "cell")  # MOST_CELLS rows at most
    return rows.withColumn(name, F.col("first_") + F.pmod("hash_", "parts_")).drop("hash_", "first_", "parts_")


def search(base: DataFrame, k: int, every: int, build: Callable, find: Callable, score: str, block_rows: int, query_rows: int, width: str = "double") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, a row whose id is divisible by every.

    Each block builds its index once, and meets at once the queries that begin there. Queries go in blocks of their own, each with what has been found
    so far. Then they meet a region, up to REGION blocks of candidates, in shares of SHARE * query_rows, and its indexes are copied for each
    share, so that the bytes of a task have a bound; what a query finds in a block of the region bounds what it looks for in the next.
    The queries that go to a region are made while they are shuffled there, and not stored before.
    """
    table, cells, _, asked = dealt(base, block_rows, every, width)
    kind, number = (pa.int64(), np.int64) if score == "long" else (pa.float64(), np.float64)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number))
    parts = -(-asked // query_rows)
    blocks = int(cells.blocks.sum())
    # shares: by the queries that blocks of them have on average
    shares = np.cumsum(np.repeat(asked / np.maximum(parts, 1), parts)) // (SHARE * query_rows)
    region = max(1, min(REGION, blocks * (1 + int(shares[-1]) if len(shares) else 1) // TASKS))

    def opened(blob: pa.Scalar) -> dict:
        made = pickle.loads(blob.as_py())
        return made | {"vectors": made["vectors"].astype(np.float64)}

    def pack(rows: pa.Table) -> pa.Table:
        v = matrix(rows.column("vec"))
        home = int(rows.column("cell")[0].as_py())
        number = int(rows.column("asked")[0].as_py())
        block = int(cells.first[home] + number % cells.blocks[home])
        blob = pickle.dumps((rows.column("vec_id").to_numpy(), slim(v), np.full(len(v), -np.inf), block), 5)
        return pa.table({"place": [block], "share": [int(shares[number])], "queries": pa.array([blob], pa.binary())})

    queries = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "cell")).alias("r")).select("vec_id", "r.*")
    packed = split(queries, np.cumsum(parts) - parts, parts, "asked", False).groupBy("asked").applyInArrow(pack, "place long, share long, queries binary")

    def looked(own: dict, ids: np.ndarray, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, x, s = find(own, ids, v, k, bound)
        return np.array(q, np.int64), np.array(x, np.int64), np.array(s, number)

    def begin(rows: pa.Table, asking: pa.Table) -> pa.Table:
        """The index of a block, and every query that has its first block here; it goes on with the last of its k best as its bound."""
        out, found, blobs, own = [], [], [], None
        if len(rows):  # else the hashes left the block empty
            ids = rows.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            own = build(ids[order], matrix(rows.column("vec"))[order])
            blobs = [pickle.dumps(own | {"vectors": slim(own["vectors"])}, 5)]
        for blob in asking.column("queries"):
            ids, v, bound, block = pickle.loads(blob.as_py())
            q, x, s, place = best_of(*(looked(own, ids, v.astype(np.float64), bound) if own else nothing), k)
            last = place == k - 1
            out.append(pickle.dumps((ids, v, raised(ids, bound, q[last], s[last]), block), 5))
            found.append(pickle.dumps((q, x, s), 5))
        fill = lambda x, y, kind: pa.array((x or [None] * len(blobs)) + (y or [None] * len(out)), kind)
        at, share = rows.column("block").slice(0, 1).to_pylist(), asking.column("share").to_pylist()
        binary = {"index": fill(blobs, [], pa.binary()), "queries": fill([], out, pa.binary()), "found": fill([], found, pa.binary())}
        return pa.table({"block": fill(at, [], pa.int64()), "share": fill([], share, pa.int64()), **binary})

    def rows_of(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> dict:
        return {"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, kind)}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                yield pa.RecordBatch.from_pydict(rows_of(*pickle.loads(blob.as_py())))

    def going(blob: pa.Scalar) -> Iterator[tuple[int, tuple, np.ndarray]]:
        """Each region with a block, other than the first, that can hold something as good, and those queries that it can."""
        ids, v, bound, block = held = pickle.loads(blob.as_py())
        wide = v.astype(np.float64)
        open_ = np.concatenate([cells.most(wide[i : i + ROWS]) >= bound[i : i + ROWS, None] for i in range(0, len(v), ROWS)])
        for r in range(-(-blocks // region)):
            there = np.arange(r * region, min(blocks, (r + 1) * region))
            pick = open_[:, np.unique(cells.of(there[there != block]))].any(1)
            if pick.any():
                yield r, held, pick

    def where_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for share, blob in zip(b.column(0), b.column(1), strict=True):
                to = [r for r, _, _ in going(blob)]
                yield pa.RecordBatch.from_pydict({"place_": pa.array(to, pa.int64()), "share_": pa.array([share.as_py()] * len(to), pa.int64())})

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for share, blob in zip(b.column(0), b.column(1), strict=True):
                for r, (ids, v, bound, block), pick in going(blob):
                    sent = pickle.dumps((ids[pick], v[pick], bound[pick], block), 5)
                    yield pa.RecordBatch.from_pydict({"place": [r], "share": [share.as_py()], "queries": pa.array([sent], pa.binary())})

    def end(asking: pa.Table, held: pa.Table) -> pa.Table:
        """The blocks of a region one after the other, with the bounds that the k best of those before them give."""
        there = held.column("block").to_numpy()
        own, out = [opened(x) for x in held.column("index")], []
        of = cells.of(there)
        for blob in asking.column("queries"):
            ids, v, bound, block = pickle.loads(blob.as_py())
            v = v.astype(np.float64)
            most = np.concatenate([cells.most(v[i : i + ROWS], of) for i in range(0, len(v), ROWS)])
            best = nothing
            for n in np.argsort(there).tolist():
                at = np.flatnonzero(most[:, n] >= bound)
                if there[n] == block or not len(at):
                    continue
                *best, place = best_of(*map(np.concatenate, zip(best, looked(own[n], ids[at], v[at], bound[at]), strict=True)), k)
                last = place == k - 1
                bound = raised(ids, bound, best[0][last], best[2][last])
            out.append(best)
        return pa.table(rows_of(*map(np.concatenate, zip(*out, strict=True))) if out else rows_of([], [], []))

    shape = f"query_id long, vec_id long, score {score}"
    begun = split(table, cells.first, cells.blocks, "block", True).groupBy("block").cogroup(packed.groupBy("place"))
    begun = materialize(begun.applyInArrow(begin, "block long, share long, index binary, queries binary, found binary"), "indexes", group_rows=BLOBS)
    found = map_arrow(begun.where("found is not null").select("found"), unpack, shape)
    if blocks > 1:
        left = begun.where("queries is not null").select("share", "queries")
        visits = map_arrow(left, go_on, "place long, share long, queries binary")
        wanted = map_arrow(left, where_to, "place_ long, share_ long").distinct()  # few numbers
        held = begun.where("index is not null").withColumn("place", F.expr(f"block div {region}")).join(F.broadcast(wanted), F.col("place") == F.col("place_"))
        held = held.select("place", F.col("share_").alias("share"), "block", "index")
        found = found.unionByName(visits.groupBy("place", "share").cogroup(held.groupBy("place", "share")).applyInArrow(end, shape))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- exact: M-tree


def widened(v: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with one more component, so that all have the same length: the nearest is then the one of largest inner product."""
    rest = np.maximum(0.0, norm2 - np.einsum("ij,ij->i", v, v))
    return np.hstack((v, np.sqrt(rest)[:, None]))


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """An M-tree, loaded from the top: an inner page's entries are routing vectors with their covering radius, distance to the page's own vector and child page."""
    with np.errstate(over="ignore"):
        norm2 = float(np.einsum("ij,ij->i", vectors, vectors).max())
    # lengths that overflow have no distances: every row then lies in one page after the other, without bounds
    points = widened(vectors, norm2) if norm2 < 1e300 else np.zeros((len(vectors), 1))
    pages: list[dict] = []
    order: list[np.ndarray] = []  # rows, page by page
    placed = 0

    def grow(members: np.ndarray, parent: np.ndarray | None) -> int:
        nonlocal placed
        number = len(pages)
        pages.append({})
        own = points[members]
        far = np.zeros(len(members)) if parent is None else np.sqrt(((own - parent) ** 2).sum(1))
        if len(members) <= PAGE:
            pages[number] = {"leaf": True, "first": placed, "last": placed + len(members), "parent": far}
            order.append(members)
            placed += len(members)
            return number
        picked, gap, nearest = [], np.full(len(members), np.inf), np.zeros(len(members), np.int64)
        at = int(far.argmax()) if parent is not None else 0
        for j in range(FAN):  # routing vectors: each the farthest from those before
            picked.append(at)
            d = np.sqrt(((own - own[at]) ** 2).sum(1))
            closer = d < gap
            gap[closer], nearest[closer] = d[closer], j
            at = int(gap.argmax())
            if gap[at] == 0:
                break
        if len(picked) == 1:  # nothing but copies of one vector
            parts = [(members[i : i + PAGE], picked[0], 0.0) for i in range(0, len(members), PAGE)]
        else:
            parts = [(members[nearest == j], p, float(gap[nearest == j].max())) for j, p in enumerate(picked)]
        children = [grow(rows, own[p]) for rows, p, _ in parts]
        pages[number] = {"leaf": False, "route": own[[p for _, p, _ in parts]], "radius": np.array([r for *_, r in parts]), "parent": far[[p for _, p, _ in parts]], "child": children}
        return number

    grow(np.arange(len(ids)), None)
    rows = np.concatenate(order)
    return {"ids": ids[rows], "vectors": vectors[rows], "norm2": norm2, "pages": pages, "scored": 0}


def scan_whole(tree: dict, q: int, row: np.ndarray, k: int, bound: float) -> list[tuple[int, int]]:
    """(vec_id, score) of the k best of all rows, in Python's integers: for numbers whose sums floating point can't hold."""
    scores = [(-sum(int(x) * int(y) for x, y in zip(v, row.tolist(), strict=True)), i) for v, i in zip(tree["vectors"].tolist(), tree["ids"].tolist(), strict=True) if i != q]
    tree["scored"] += len(scores)
    return [(i, -s) for s, i in heapq.nsmallest(k, scores) if -s >= bound]


def search_tree(tree: dict, ids: np.ndarray, vectors: np.ndarray, k: int, bounds: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Best first, for a block of queries at once: pages wait in a queue by the least distance that they can hold for any of the queries that still want them.

    Distances to a page's own vector are stored with its entries and rule these out, for each query, before a distance or
    product with them is computed; what is left of a page is computed for all its queries together.
    bounds: the score that each query has k of already. Distances are floating point and their limits kept a little wide. Scores are
    whole numbers, exact below 2 ** 53; where sums could come to more, all rows are scored in Python's integers.
    """
    pages, owner, data, norm2 = tree["pages"], tree["ids"], tree["vectors"], tree["norm2"]
    rows = fitted(vectors, data.shape[1])
    with np.errstate(over="ignore"):
        q2 = np.einsum("ij,ij->i", rows, rows)
    exact = (q2 < 2.0**52) & (norm2 < 2.0**52)
    best_s, best_v = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    least = bounds.copy()  # what a row has to score to matter

    def limit(at: np.ndarray) -> np.ndarray:
        wide = np.sqrt(np.maximum(0.0, q2[at] + norm2 - 2.0 * np.maximum(least[at], -1e300))) + 1e-6 * (1.0 + np.sqrt(q2[at] + norm2))
        return np.where(least[at] > -np.inf, wide, np.inf)

    live = np.flatnonzero(exact)
    reach = np.full(len(ids), np.inf)
    reach[live] = limit(live)
    points = np.hstack((rows, np.zeros((len(rows), 1))))
    queue: list[tuple] = [(0.0, 0, live, np.zeros(len(live)), None)] if len(live) else []
    while queue:
        _, number, at, low, to_own = heapq.heappop(queue)
        wanted = low <= reach[at]
        if not wanted.any():
            continue
        at, page = at[wanted], pages[number]
        near = np.abs(page["parent"][None] - to_own[wanted][:, None]) if to_own is not None else None
        if page["leaf"]:
            span = np.arange(page["first"], page["last"])
            if near is not None:
                alive = (near <= reach[at][:, None]).any(0)
                if 2 * alive.sum() < len(span):  # else the whole page costs less than picking rows
                    span = span[alive]
            if not len(span):
                continue
            tree["scored"] += len(span) * len(at)
            scores = rows[at] @ data[span].T
            kept = (scores >= least[at][:, None]) & (owner[span][None] != ids[at][:, None])
            for i in np.flatnonzero(kept.any(1)).tolist():
                q, hit = at[i], kept[i]
                s, v = np.concatenate((best_s[q], scores[i, hit])), np.concatenate((best_v[q], owner[span[hit]]))
                top = np.lexsort((v, -s))[:k]
                best_s[q], best_v[q] = s[top], v[top]
                least[q] = max(least[q], best_s[q, -1])
            reach[at] = limit(at)
            continue
        open_ = np.ones((len(at), len(page["child"])), bool) if near is None else near - page["radius"] <= reach[at][:, None]
        for j in np.flatnonzero(open_.any(0)).tolist():
            some = at[open_[:, j]]
            d = np.sqrt(((points[some] - page["route"][j]) ** 2).sum(1))
            low = np.maximum(0.0, d - page["radius"][j])
            wanted = low <= reach[some]
            if wanted.any():
                heapq.heappush(queue, (float(low[wanted].min()), page["child"][j], some[wanted], low[wanted], d[wanted]))
    out_q, out_v, out_s = [], [], []
    for i, q in enumerate(ids.tolist()):
        if exact[i]:
            found = [(int(v), int(s)) for v, s in zip(best_v[i].tolist(), best_s[i].tolist(), strict=True) if s > -np.inf]
        else:
            found = scan_whole(tree, q, rows[i], k, float(bounds[i]))
        out_q += [q] * len(found)
        out_v += [v for v, _ in found]
        out_s += [max(-(2**63), min(2**63 - 1, s)) for _, s in found]
    return out_q, out_v, out_s


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = 8192, query_rows: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long) for the rows whose id is divisible by every.

    Components become floor(scale * x); the score is the integer inner product, ties go to the
    smaller vec_id. Scores beyond 64 bits are given as the nearest number that fits, and tie there. Null vectors and those with null or non-finite components take
    no part, nor do those that the scale makes infinite, or rows without an id. Shorter vectors count as filled up with zeros; one without components scores 0. All rows
    of a query's id are its own; of a query id's different vectors the smallest asks.
    """
    scaled = F.transform("vec", lambda x: F.when(F.abs(x) < 2.0**52 / scale, F.floor(x * F.lit(float(scale))).cast("double")).otherwise(x * F.lit(float(scale))))
    base = usable(df, id_col, vec_col).select("vec_id", scaled.alias("vec")).where(~F.exists("vec", lambda x: F.abs(x) == float("inf")))
    return search(base, k, every, build_tree, search_tree, "long", block_rows, query_rows)


# --- approximate: score-aware quantisation


def residual_terms(x: np.ndarray, unit: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, subspace and centre: the squared residual, and the residual along the vector."""
    m, centres, width = books.shape
    diff = x.reshape(len(x), m, 1, width) - books[None]
    return (diff**2).sum(3), np.einsum("nmcw,nmw->nmc", diff, unit.reshape(len(x), m, width))


def choose(x: np.ndarray, books: np.ndarray, extra: float, rounds: int = 2) -> np.ndarray:
    """Codes that make the score-aware loss small: the squared residual and extra times the square of its part along the vector, a subspace at a time."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    square, along = residual_terms(x, unit, books)
    codes = square.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for j in range(books.shape[0]):
            others = total - along[rows, j, codes[:, j]]
            codes[:, j] = (square[:, j] + extra * (others[:, None] + along[:, j]) ** 2).argmin(1)
            total = others + along[rows, j, codes[:, j]]
    return codes


def fit_books(x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 5) -> tuple[np.ndarray, float]:
    """(books [subspace, 16, width], extra): alternates between codes and centres, each solved for the score-aware loss."""
    dims = x.shape[1]
    m = dims // width
    parts = x.reshape(len(x), m, width)
    pick = np.random.default_rng(7).choice(len(x), 16, replace=len(x) < 16)
    books = parts[pick].transpose(1, 0, 2).copy()
    extra = max(0.0, (dims - 1) * threshold**2 / (1 - threshold**2) - 1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    us = unit.reshape(len(x), m, width)
    rows = np.arange(len(x))
    for step in range(2 * rounds):
        e = 0.0 if step < rounds else extra  # plain rounds first, for a start
        codes = choose(x, books, e, 1)
        chosen = books[np.arange(m), codes]
        along = ((parts - chosen) * us).sum(2)
        total = along.sum(1)
        for j in range(m):
            others = total - along[:, j]
            left, right = np.zeros((16, width, width)), np.zeros((16, width))
            np.add.at(left, codes[:, j], np.eye(width) + e * us[:, j, :, None] * us[:, j, None, :])
            np.add.at(right, codes[:, j], parts[:, j] + e * us[:, j] * (others + (parts[:, j] * us[:, j]).sum(1))[:, None])
            used = np.bincount(codes[:, j], minlength=16) > 0
            books[j, used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
            along[:, j] = ((parts[:, j] - books[j, codes[rows, j]]) * us[:, j]).sum(1)
            total = others + along[:, j]
    return books, extra


def leading(guess: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest numbers; of equal ones the first, which in a block are those of the smallest ids."""
    if len(guess) <= n:
        return np.arange(len(guess))
    least = -np.partition(-guess, n - 1)[n - 1]
    above = np.flatnonzero(guess > least)
    return np.concatenate((above, np.flatnonzero(guess == least)[: n - len(above)]))


def angles(vectors: np.ndarray, coded: np.ndarray) -> dict:
    """Of each row: its length, the inverse of its coded vector's, and cosine and sine of the angle between the two."""
    n = max(vectors.shape[1], coded.shape[1])
    x, y = (np.pad(v, ((0, 0), (0, n - v.shape[1]))) for v in (vectors, coded))
    norm, short = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    inverse = np.where(short > 0, 1 / np.maximum(short, 1e-300), 0.0)
    y = y * inverse[:, None]
    along = np.einsum("ij,ij->i", x, y)
    return {"norm": norm, "inverse": inverse, "cos": along / norm, "sin": np.where(short > 0, np.linalg.norm(x - along[:, None] * y, axis=1) / norm, 1.0)}


def reach(index: dict, guess: np.ndarray, parts: int) -> np.ndarray:
    """The most that the inner product of each row with a query of length 1 can be.

    guess is the query's with the coded rows, in single precision. The angle between query and row is
    no less than that between query and coded row less that between row and coded row.
    """
    a = np.minimum(1.0, guess * index["inverse"] + (parts + 4) * 2.0**-22)
    a = np.maximum(-1.0, a)
    bound = np.where(a >= index["cos"], 1.0, a * index["cos"] + np.sqrt(1.0 - a * a) * index["sin"])
    return index["norm"] * (bound + 1e-9)


def possible(index: dict, books: np.ndarray, units: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) of the pairs whose inner product can come to the query's bound, by tables added up over the codes.

    units: the queries at length 1, as wide as the books; size: their lengths. It is the bound of reach(), for some queries at once and in
    single precision, so a little wider. Where it leaves many pairs of a piece of the block, a product with the rows at length 1, a
    little wide too, rules out most of them. What isn't a number there rules nothing out.
    """
    norm = index["norm"]
    with np.errstate(all="ignore"):
        if "single" not in index:  # once a block and task
            sure = (norm > 1e-140) & (norm < 1e140)
            longest = norm[sure].max(initial=1e-140)
            columns = (index["inverse"], index["cos"], index["sin"], np.where(sure, longest / norm, np.nan))
            index["single"] = (*(x[:, None].astype(np.float32) for x in columns), (index["vectors"] / norm[:, None]).astype(np.float32), longest)
        inverse, cos, sin, short, rows, longest = index["single"]
        sure = (size > 1e-140) & (size < 1e140) & (np.abs(bounds) < 1e280)
        goal = np.where(sure, np.clip(bounds / size / longest, -1e6, 1e6), np.nan).astype(np.float32)
        # the tables of a query: its products with the centres of a subspace, added for pairs of subspaces
        each = np.einsum("mcw,qmw->mcq", books, units.reshape(len(units), len(books), books.shape[2])).astype(np.float32)
        tables = (each[0::2, :, None] + each[1::2, None]).reshape(len(books) // 2, 256, len(units))
        same = min(rows.shape[1], units.shape[1])
        to = np.ascontiguousarray(units[:, :same].T, np.float32)
        wide = np.float32((max(rows.shape[1], units.shape[1]) + len(books) + 32) * 2.0**-22)
        room, found = np.empty((3, min(PIECE, len(rows)), len(units)), np.float32), []
        for i in range(0, len(rows), PIECE):
            piece = slice(i, i + PIECE)
            a, most, least = room[:, : len(rows[piece])]
            codes = index["codes"][:, piece]
            tables[0].take(codes[0], axis=0, out=a, mode="clip")
            for t, c in zip(tables[1:], codes[1:], strict=True):
                a += t.take(c, axis=0, out=most, mode="clip")
            a *= inverse[piece]
            a += wide
            np.multiply(short[piece], goal, out=least)
            least -= wide
            np.multiply(a, a, out=most)
            np.subtract(1.0, most, out=most)
            np.sqrt(most, out=most)
            most *= sin[piece]
            closed = a < cos[piece]
            a *= cos[piece]
            most += a
            closed &= most < least
            if 32 * (closed.size - np.count_nonzero(closed)) > closed.size:
                closed |= np.matmul(rows[piece, :same], to, out=a) < least
            found.append(np.flatnonzero(~closed) + i * len(units))
    return np.divmod(np.concatenate(found), len(units))


def nearest(df: DataFrame, k: int = 20, every: int = 20, sample: int = 8192, rerank: int = 200, block_rows: int = 4096, query_rows: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double) for the rows whose id is divisible by every: the k of largest inner product, ties to the smaller vec_id.

    Centres are fitted on a sample of rows, those whose ids have the smallest hashes; every row is
    coded, at four bits for two dimensions. A query's tables for pairs of codes are added up over the
    codes of a block, and of the block that a query meets first the best rerank rows are scored exactly on the original vectors
    in double precision, as is every other row, there and in the blocks that follow, that by the bound on its quantisation error can still
    reach the k-th of these scores, so that none of the k best is lost. Null, empty and zero vectors, those with null or non-finite components and rows
    without an id take no part. Shorter vectors count as filled up with zeros. All rows of a query's id are its own.
    """
    base = usable(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    width = "float" if dict(df.dtypes)[vec_col] == "array<float>" else "double"
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").toArrow()
    found = matrix(some.column("vec")) if len(some) else np.zeros((1, 4))
    wide = -(-found.shape[1] // 4) * 4
    books, extra = fit_books(np.pad(found, ((0, 0), (0, wide - found.shape[1]))))

    def build(ids: np.ndarray, vectors: np.ndarray) -> dict:
        x = np.zeros((len(vectors), wide))
        n = min(wide, vectors.shape[1])
        x[:, :n] = vectors[:, :n]
        codes = np.concatenate([choose(x[i : i + ROWS], books, extra).astype(np.uint8) for i in range(0, len(x), ROWS)])  # rows are coded each for itself
        coded = books[np.arange(len(books)), codes].reshape(len(x), wide)
        return {"ids": ids, "vectors": vectors, "codes": np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T), **angles(vectors, coded)}

    def find(index: dict, ids: np.ndarray, vectors: np.ndarray, k: int, bounds: np.ndarray) -> tuple[list[int], list[int], list[float]]:
        owner, own, codes = index["ids"], index["vectors"], index["codes"]
        n = min(wide, vectors.shape[1])
        size = np.linalg.norm(vectors, axis=1)
        x = np.zeros((len(vectors), wide))
        x[:, :n] = vectors[:, :n] / size[:, None]
        same = min(own.shape[1], vectors.shape[1])
        own = own[:, :same]
        raws = np.ascontiguousarray(vectors[:, :same])
        out_q, out_v, out_s = [], [], []
        bounded = np.flatnonzero(bounds > -np.inf)
        for i in range(0, len(bounded), ASKED):  # those with a bound don't need the leading rows for one
            at = bounded[i : i + ASKED]
            rows, columns = possible(index, books, x[at], size[at], bounds[at])
            other = owner[rows] != ids[at][columns]
            rows, columns = rows[other], columns[other]
            exact = np.concatenate([np.zeros(0)] + [(own[rows[j : j + PAIRS]] * raws[at[columns[j : j + PAIRS]]]).sum(1) for j in range(0, len(rows), PAIRS)])
            kept = exact >= bounds[at][columns]
            q, v, s, _ = best_of(ids[at][columns[kept]], owner[rows[kept]], exact[kept], k)
            out_q += q.tolist()
            out_v += v.tolist()
            out_s += s.tolist()
        free = np.flatnonzero(~(bounds > -np.inf))
        tables = np.einsum("qmw,mcw->qmc", x[free].reshape(len(free), len(books), books.shape[2]), books)
        tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(free), len(books) // 2, 256).astype(np.float32)
        for q, table, raw, long, bound in zip(ids[free].tolist(), tables, raws[free], size[free].tolist(), bounds[free].tolist(), strict=True):
            guess = np.zeros(len(owner), np.float32)
            for t, c in zip(table, codes, strict=True):
                guess += t[c]
            mine = owner == q
            most = reach(index, guess, len(books)) * long
            open_ = ~((most < bound) | mine)
            if bound > -np.inf and not open_.any():
                continue
            guess[~open_] = -np.inf
            take = leading(guess, rerank)
            take = take[open_[take]]
            exact = (own[take] * raw).sum(1)
            least = max(bound, -np.partition(-exact, k - 1)[k - 1] if len(exact) >= k else -np.inf)
            open_ &= ~(most < least)
            open_[take] = False
            more = np.flatnonzero(open_)
            if 8 * len(more) > len(guess):  # many: a product over the block, a little wide, rules out most
                more = more[~((own @ raw)[more] < least - 1e-9 * (abs(least) + long * index["norm"][more]))]
            take = np.concatenate((take, more))
            exact = np.concatenate((exact, (own[more] * raw).sum(1)))
            best = np.lexsort((owner[take], -exact))[:k]
            best = best[exact[best] >= bound]
            out_q += [q] * len(best)
            out_v += owner[take[best]].tolist()
            out_s += exact[best].tolist()
        return out_q, out_v, out_s

    return search(base, k, every, build, find, "double", block_rows, query_rows, width)
