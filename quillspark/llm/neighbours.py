"""Most similar vectors for every vector: inverted file, product-quantised residuals, exact reranking.

Coarse centroids of two levels and residual codebooks are fitted on a bounded sample; every usable vector is
assigned to its cell and coded. How many cells a query probes is measured: a bounded set of queries is compared
with all vectors, and the probes are as many as give the recall wanted. Vectors are laid out once in blocks of whole
cells (a cell beyond the block size spans several), in the folder that all executors share; a block is read as members, and
as a slice of the queries, by each task that needs it, so what is written follows the vectors, not the meetings of blocks. One task
scores one slice's queries against one block: for the queries that probe a cell, the asymmetric scores of its members, the query's table against centroid
plus coded residual, come from one matrix product; every member whose score and coding error reach the k-th
best so far is reranked with its exact vector, so coding loses none. Copies of one vector are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import xxhash
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import staged, staged_by


@dataclass(frozen=True)
class Plan:
    """Parameters of index and search."""

    dim: int = 64
    k: int = 5
    #: Rows that the centroids and codebooks are fitted on at most.
    sample: int = 20_000
    #: Recall of the k nearest that the probes are chosen for, and the queries compared with all vectors for that.
    recall: float = 0.93
    judged: int = 256
    #: Cells grow with the square root of the vectors; beyond first_cells a second level of centroids multiplies them.
    cells_per_root: float = 5.0
    first_cells: int = 2048
    #: Parts of a residual; each has 256 codewords.
    parts: int = 32
    #: Members of a block and queries of a slice at most.
    block: int = 131_072
    rounds: int = 8
    #: Neighbours below this cosine are searched for like all others, but don't come out.
    least: float = -1.0


#: More than the error of a product of two unit vectors in single precision.
ROUNDING = 1e-5
#: More than the difference of a closeness computed among other cells.
REACH = 1e-5
#: Row numbers that are broadcast at most.
BROADCAST_ROWS = 200_000


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


@dataclass(frozen=True)
class Index:
    """Centroids of the first level (cells, dim), of their residuals (more, dim), codebooks (parts, 256, dim / parts)."""

    first: np.ndarray
    second: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, cells: int, plan: Plan, seed: int = 7) -> Index:
        rng = np.random.default_rng(seed)
        first = _kmeans(x, min(cells, plan.first_cells), plan.rounds, rng)
        left = x - first[_nearest(x, first)]
        more = max(1, round(cells / plan.first_cells))
        second = _kmeans(left, more, plan.rounds, rng) if more > 1 else np.zeros((1, x.shape[1]), np.float32)
        left = left - second[_nearest(left, second)]
        width = plan.dim // plan.parts
        few = left[rng.choice(len(left), min(len(left), 6000), replace=False)]
        books = np.zeros((plan.parts, 256, width), np.float32)
        for p in range(plan.parts):
            book = _kmeans(few[:, p * width : (p + 1) * width], 256, 6, rng)
            books[p, : len(book)] = book
            books[p, len(book) :] = book[0]
        return Index(first, second, books)

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def centroids(self, cell: np.ndarray) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        a = _nearest(x, self.first)
        return a * len(self.second) + _nearest(x - self.first[a], self.second)

    def code(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = x - self.centroids(cell)
        parts, _, width = self.books.shape
        codes = np.empty((len(x), parts), np.uint8)
        for p in range(parts):
            codes[:, p] = _nearest(left[:, p * width : (p + 1) * width], self.books[p])
        return codes

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        left = self.books[np.arange(parts)[None, :], codes].reshape(len(codes), parts * width)
        return self.centroids(cell) + left

    def closeness(self, x: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """(rows, cells): larger for nearer cells; of all cells, or of some."""
        every = self.centroids(np.arange(self.cells) if cells is None else cells)
        half = (every * every).sum(1) / 2
        if cells is not None or len(self.second) == 1:
            return x @ every.T - half
        levels = (x @ self.first.T)[:, :, None] + (x @ self.second.T)[:, None, :]
        return levels.reshape(len(x), -1) - half



def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if len(c) == 1:
        return np.zeros(len(x), np.int64)
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ c.T - half).argmax(1) for i in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


def usable_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of the rows whose vector has dim components, none null or not finite, and isn't all zero."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 1e30)) & F.exists(vector, lambda e: e != 0)
    return rows.filter((F.size(vector) == dim) & fine & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    x = np.concatenate([np.asarray(v, np.float32) for v in values]).reshape(-1, dim) if len(values) else np.empty((0, dim), np.float32)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-38) if len(x) else x
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if len(x) else x


def _best(q: np.ndarray, x: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keep best x of each q, best first."""
    order = np.argsort(4.0 * q - s)  # cosines are at most 1: queries stay apart
    q, x, s = q[order], x[order], s[order]
    m = np.arange(len(q)) - np.searchsorted(q, q) < keep
    return q[m], x[m], s[m]


def search_block(index: Index, plan: Plan, qv: np.ndarray, xv: np.ndarray, cell: np.ndarray, codes: np.ndarray, reach: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of the k best members for each query, out of the cells as close as reach, of at least plan.least.

    same: for each query its own place among the members, or -1.
    """
    order = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    probe_q, probe_c, best = [], [], []
    for i in range(0, len(qv), 2048):
        here = index.closeness(qv[i : i + 2048], cells)
        hit = np.flatnonzero((here >= reach[i : i + 2048, None]).ravel())
        probe_q.append((hit // len(cells) + i).astype(np.int32))
        probe_c.append((hit % len(cells)).astype(np.int32))
        top = here.argmax(1)
        best.append(np.where(here[np.arange(len(here)), top] >= reach[i : i + 2048], top, -1))
    pq, pc, best = np.concatenate(probe_q), np.concatenate(probe_c), np.concatenate(best)
    by = np.argsort(pc, kind="stable")
    pq, pc = pq[by], pc[by]
    bounds = np.searchsorted(pc, np.arange(len(cells) + 1))
    floor = np.full(len(qv), float(plan.least))  # what is below can't come out, so it needn't be reranked or held
    own = np.full(len(qv), -1) if same is None else same
    none = np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, np.empty(0))]
    size = 0

    def settle() -> None:
        nonlocal held, size
        q, x, s = _best(*(np.concatenate(z) for z in zip(*held, strict=True)), plan.k)
        held, size = [(q, x, s)], 0
        last = np.r_[q[1:] != q[:-1], True] if len(q) else np.empty(0, bool)
        full = last & (np.bincount(q, minlength=len(qv))[q] == plan.k)
        floor[q[full]] = np.maximum(floor[q[full]], s[full])

    def visit(c: int, asks: np.ndarray) -> None:
        nonlocal size
        members = np.sort(order[starts[c] : ends[c]])
        for b in range(0, len(members), 256):
            mem = members[b : b + 256]
            coded = index.decode(codes[mem], cell[mem])
            # a score is off by the length of its member's coding error at most, as queries are unit vectors
            error = (np.linalg.norm(xv[mem] - coded, axis=1) + ROUNDING).astype(np.float32)
            for a in range(0, len(asks), 2048):
                ask = asks[a : a + 2048]
                wanted = (floor[ask] - ROUNDING).astype(np.float32)
                scores = qv[ask] @ coded.T
                scores += error
                hit = np.flatnonzero((scores >= wanted[:, None]).ravel())
                r, m = hit // len(mem), hit % len(mem)
                if len(r) > 8 * len(ask) and len(mem) > plan.k + 1:  # many: only the k + 1 best of this lot, one of which may be the query itself
                    exact = qv[ask].astype(np.float64) @ xv[mem].astype(np.float64).T
                    m = np.argpartition(-exact, plan.k, axis=1)[:, : plan.k + 1].ravel()
                    r = np.repeat(np.arange(len(ask)), plan.k + 1)
                q, x = ask[r], mem[m]
                other = own[q] != x
                q, x = q[other], x[other]
                for i in range(0, len(q), 65536):
                    qi, xi = q[i : i + 65536], x[i : i + 65536]
                    cosine = np.einsum("ij,ij->i", qv[qi].astype(np.float64), xv[xi].astype(np.float64))
                    keep = cosine >= floor[qi]
                    held.append((qi[keep], xi[keep], cosine[keep]))
                    size += int(keep.sum())
                if size > 500_000:
                    settle()

    # the nearest cell first: it gives each query a k-th best that spares most reranks
    asked = np.argsort(best, kind="stable")
    edges = np.searchsorted(best[asked], np.arange(len(cells) + 1))
    for c in range(len(cells)):
        if edges[c] < edges[c + 1]:
            visit(c, asked[edges[c] : edges[c + 1]])
    settle()
    for c in range(len(cells)):
        asks = pq[bounds[c] : bounds[c + 1]]
        asks = asks[best[asks] != c]
        if len(asks):
            visit(c, asks)
    settle()
    return held[0]


def _judged_probes(coded: DataFrame, index, queries: np.ndarray, own: np.ndarray, plan: Plan) -> int:  # noqa: ANN001
    """Probes that find the share plan.recall of the k nearest of a bounded set of queries, which meet every vector once."""
    k = plan.k

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = (-index.value.closeness(queries)).argsort(1).argsort(1)
        best, cells = np.full((len(queries), k), -2.0), np.zeros((len(queries), k), np.int64)
        for part in parts:
            for i in range(0, len(part), 2048):
                few = part.iloc[i : i + 2048]
                s = queries @ np.frombuffer(b"".join(few["u"]), np.float32).reshape(len(few), -1).T
                s[own[:, None] == few["row"].to_numpy()[None, :]] = -2
                top = np.argpartition(-s, min(k, len(few)) - 1, axis=1)[:, :k]
                s, c = np.concatenate([best, np.take_along_axis(s, top, 1)], axis=1), np.concatenate([cells, few["cell"].to_numpy(np.int64)[top]], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, cells = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        yield pd.DataFrame({"q": np.repeat(np.arange(len(queries)), k), "s": best.ravel(), "place": np.take_along_axis(place, cells, 1).ravel()})

    found = coded.select("row", "cell", "u").mapInPandas(meet, "q int, s double, place long").filter("s > -2")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).filter(F.col("r") <= k)
    places = np.sort([r["place"] for r in top.select("place").collect()])  # k rows a judged query
    return int(places[min(len(places) - 1, int(np.ceil(plan.recall * len(places))))]) + 1 if len(places) else 1


#: Rows of a block that were laid out together, as bytes, and the blocks that hold a cell which one of them probes, as bits.
_LAID = "block int, rows binary, cells binary, codes binary, reach binary, vectors binary, sees binary"
_NAMES = [f.split()[0] for f in _LAID.split(", ")]


def _read_block(folder: str, block: int, *columns: str) -> list[bytes]:
    """Columns of a block; empty where it has no rows."""
    files, root = FileSystem.from_uri(folder)
    path = f"{root}/block={block}"
    if files.get_file_info(path).type == FileType.NotFound:
        return [b""] * len(columns)
    found = ds.dataset(path, filesystem=files, format="parquet").to_table(columns=list(columns))
    return [b"".join(found[c].to_pylist()) for c in columns]


def search(reps: DataFrame, plan: Plan) -> DataFrame:
    """(row, neighbour, cosine): candidates among which are the k best probed ones of every vector of reps(row, mark, u), which are distinct."""
    spark = reps.sparkSession
    dim, out = plan.dim, "row long, neighbour long, cosine double"
    n = reps.count()
    if n < 2:
        return spark.createDataFrame([], out)
    # a bounded sample, the least marks (they are hashes): a threshold lets about twice as many through, so no task sends its own 20 000
    bound = int(min(1.0, 2.0 * (plan.sample + 500) / n) * (1 << 30))
    few = reps.filter(F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) < bound).orderBy(F.xxhash64("mark"), "mark").limit(plan.sample).select("row", "u").toPandas()
    x = np.frombuffer(b"".join(few["u"]), np.float32).reshape(-1, dim)
    index = Index.fit(x, min(int(max(1, plan.cells_per_root * np.sqrt(n))), len(x) * 64), plan)
    shared = spark.sparkContext.broadcast(index)  # first_cells x dim floats, a second level and the codebooks

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = np.frombuffer(b"".join(part["u"]), np.float32).reshape(len(part), dim)
            cell = shared.value.assign(v)
            yield pd.DataFrame({"row": part["row"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in shared.value.code(v, cell)], "u": part["u"]})

    coded = staged(reps.select("row", "u").mapInPandas(assign, "row long, cell int, code binary, u binary"), "coded")
    n_probe = _judged_probes(coded, shared, x[: plan.judged], few["row"].to_numpy(np.int64)[: plan.judged], plan)
    sizes = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # one row a cell: some square roots of n

    # blocks as large as memory allows, but enough of them, and of slices, to keep all cores busy
    side = int(np.ceil(np.sqrt(1.5 * spark.sparkContext.defaultParallelism)))
    limit = int(max(1, min(plan.block, -(-21 * n // (20 * side)))))
    # cells in the order of their projection, cut into blocks; a larger cell spans blocks of its own
    every = index.centroids(np.arange(index.cells))
    spread = np.linalg.svd(index.first - index.first.mean(0), full_matrices=False)[2][0]
    first, pieces, block, room = np.zeros(index.cells, np.int64), np.ones(index.cells, np.int64), 0, limit
    for c in (int(c) for c in np.argsort(every @ spread) if int(c) in sizes):
        if sizes[c] > room and room < limit:
            block, room = block + 1, limit
        first[c], pieces[c] = block, -(-sizes[c] // limit)
        block, room = (block, room - sizes[c]) if pieces[c] == 1 else (block + int(pieces[c]), limit)
    blocks = int((first + pieces).max())
    of_cell = spark.sparkContext.broadcast((first, pieces))  # two numbers a cell

    def _parts(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first, pieces = of_cell.value
        row, cell = part["row"].to_numpy(), part["cell"].to_numpy()
        u = np.frombuffer(b"".join(part["u"]), np.float32).reshape(len(part), dim)
        return row, cell, u, first[cell] + row % pieces[cell]

    at_home = np.zeros((blocks, index.cells), bool)
    for c in sizes:
        at_home[first[c] : first[c] + pieces[c], c] = True
    home = spark.sparkContext.broadcast([np.flatnonzero(h) for h in at_home])  # the cells of each block

    def _seen(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each row reaches, and (rows, blocks): which blocks hold a cell within that."""
        sees, reach = np.zeros((len(u), blocks), bool), np.empty(len(u), np.float32)
        for i in range(0, len(u), 1024):
            close = shared.value.closeness(u[i : i + 1024])
            n = min(n_probe, close.shape[1])
            reach[i : i + 1024] = np.partition(close, close.shape[1] - n, axis=1)[:, close.shape[1] - n] - np.float32(REACH)
            for b, c in enumerate(home.value):
                sees[i : i + 1024, b] = close[:, c].max(1) >= reach[i : i + 1024]
        return reach, sees

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            row, cell, u, own = _parts(part)
            code = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
            reach, sees = _seen(u)
            lines = [(int(b), row[m].tobytes(), cell[m].astype(np.int32).tobytes(), code[m].tobytes(), reach[m].tobytes(), u[m].tobytes(), np.packbits(sees[m].any(0)).tobytes()) for b in np.unique(own) for m in [own == b]]
            yield pd.DataFrame(lines, columns=_NAMES)

    # each vector is moved and written once
    folder = staged_by(coded.mapInPandas(lay, _LAID).repartition(blocks, "block"), "block", "blocks")

    def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = np.zeros((blocks, blocks), bool)
        for part in batches:
            for s, sees in zip(part["block"], part["sees"], strict=True):
                met[s] |= np.unpackbits(np.frombuffer(sees, np.uint8), count=blocks).astype(bool)
        s, b = np.nonzero(met)
        yield pd.DataFrame({"block": b, "slice": s})

    asked = spark.read.schema("sees binary, block int").parquet(folder).select("block", "sees").mapInPandas(meetings, "block int, slice int").distinct()
    asked = staged(asked, "meetings")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for b, s in zip(part["block"].tolist(), part["slice"].tolist(), strict=True):
                of_q, of_m = _read_block(folder, s, "rows", "reach", "vectors"), _read_block(folder, b, "rows", "cells", "codes", "vectors")
                qrow, xrow = np.frombuffer(of_q[0], np.int64), np.frombuffer(of_m[0], np.int64)
                if not len(qrow) or not len(xrow):
                    continue
                qv, xv = (np.frombuffer(v, np.float32).reshape(-1, dim) for v in (of_q[2], of_m[3]))
                cell, codes = np.frombuffer(of_m[1], np.int32), np.frombuffer(of_m[2], np.uint8).reshape(len(xrow), -1)
                by = np.argsort(xrow)
                xrow, xv, cell, codes = xrow[by], xv[by], cell[by], codes[by]
                at = np.searchsorted(xrow, qrow)
                same = np.where(xrow[np.minimum(at, len(xrow) - 1)] == qrow, at, -1)
                i, j, cosine = search_block(shared.value, plan, qv, xv, cell, codes, np.frombuffer(of_q[1], np.float32), same)
                yield pd.DataFrame({"row": qrow[i], "neighbour": xrow[j], "cosine": cosine})

    # long tasks: each meeting is to have a task of its own, dealt out one by one
    return asked.coalesce(1).repartition(max(1, asked.count())).mapInPandas(solve, out)


def nearest(rows: DataFrame, key: str = "id", vector: str = "embedding", plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """(id, neighbour, rank, cosine): for every usable vector the k most similar others by cosine.

    Vectors of another length, all zero, null or not finite don't count. Copies of a vector, also at another
    length, are searched once and are neighbours of each other; a repeated id counts as another row. Fewer than
    k come out only where the probed cells hold fewer others, or below plan.least. Equal cosines go by place in
    the stored table. Recall against brute force is a query (p4_recall) and a test.
    """
    k = plan.k
    base = usable_vectors(rows, key, vector, plan.dim).withColumn("row", F.monotonically_increasing_id())
    kind = dict(base.dtypes)["id"]

    def unit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            u = [r.tobytes() for r in _matrix(part["v"], plan.dim)]
            yield pd.DataFrame({"row": part["row"], "id": part["id"], "mark": [xxhash.xxh3_128_digest(r) for r in u], "u": u})

    units = staged(base.mapInPandas(unit, f"row long, id {kind}, mark binary, u binary"), "vectors")
    # the first k + 1 rows of each vector are all that anyone's neighbours can name
    same = Window.partitionBy("mark")
    few = units.select("row", "id", "mark").withColumn("copy", F.row_number().over(same.orderBy("row"))).filter(F.col("copy") <= k + 1)
    few = staged(few.withColumn("rep", F.min("row").over(same)), "copies")
    # copies are few as a rule: then the vectors needn't be shuffled to leave them out
    copies = units.select("row", "mark").join(few.filter("copy = 2").select("mark", "rep"), "mark").filter("row <> rep").select("row")
    copies = staged(copies, "spare")
    reps = units.select("row", "mark", "u").join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "row", "left_anti")
    found = search(reps, plan)
    best = Window.partitionBy("row").orderBy(F.desc("cosine"), "neighbour")
    found = found.withColumn("r", F.row_number().over(best)).filter((F.col("r") <= k) & (F.col("cosine") >= plan.least)).select(F.col("row").alias("rep"), F.col("neighbour").alias("of"), "cosine")
    names = few.select(F.col("rep").alias("of"), F.col("row").alias("nrow"), F.col("id").alias("neighbour"))
    lists = found.join(names, "of").unionByName(names.withColumn("rep", F.col("of")).withColumn("cosine", F.lit(1.0)))
    first = lambda *by: Window.partitionBy(*by).orderBy(F.desc("cosine"), "nrow")
    lists = lists.withColumn("r", F.row_number().over(first("rep"))).filter(F.col("r") <= k + 1).select("rep", "nrow", "neighbour", "cosine")
    # rows beyond the first k + 1 copies of a vector
    rest = units.select("row", "id", "mark").join(few.filter(F.col("copy") == k + 1).select("mark", "rep", F.col("row").alias("last")), "mark").filter("row > last")
    every = few.select("row", "id", "rep").unionByName(rest.select("row", "id", "rep"))
    out = every.join(lists, "rep").filter("row <> nrow").withColumn("rank", F.row_number().over(first("row")))
    return out.filter(F.col("rank") <= k).select("id", "neighbour", "rank", "cosine")


def recall(rows: DataFrame, neighbours: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, of: int = 1000) -> DataFrame:
    """One row (queries, wanted, found, recall): of rows with the smallest hashes of their id, of at most, the share of their k
    nearest by brute force over all rows that neighbours(id, cosine) reaches. Cosines decide, so ties count as found."""
    usable = usable_vectors(rows, key, vector, dim)
    asked = usable.orderBy(F.xxhash64("id"), "id").limit(of).toPandas()
    ids, q = asked["id"].tolist(), _matrix(asked["v"], dim)

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(q), k + 1), -2.0)
        for part in parts:
            if len(part):
                best = -np.sort(-np.concatenate([best, (q @ _matrix(part["v"], dim).T).astype(np.float64)], axis=1), axis=1)[:, : k + 1]
        yield pd.DataFrame({"id": np.repeat(np.array(ids, object), k + 1), "s": best.ravel()})

    true = usable.mapInPandas(meet, f"id {dict(usable.dtypes)['id']}, s double").filter("s > -2") if len(q) else usable.select("id", F.lit(0.0).alias("s")).limit(0)
    # the best of all is the query itself
    kth = true.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s")))).filter(F.col("r").between(2, k + 1))
    kth = kth.groupBy("id").agg(F.count(F.lit(1)).alias("wanted"), F.min("s").alias("kth"))
    got = neighbours.join(kth, "id").groupBy("id").agg(F.count_if(F.col("cosine") >= F.col("kth") - 1e-5).alias("found"))
    every = kth.join(got, "id", "left").agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    return every.withColumn("recall", F.round(F.coalesce(F.try_divide("found", "wanted"), F.lit(1.0)), 4))


def close_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b): each pair once, smaller id first, where one is a neighbour of the other with at least that cosine."""
    close = neighbours.filter((F.col("cosine") >= least) & (F.col("id") != F.col("neighbour")))
    return close.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
