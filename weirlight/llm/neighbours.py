"""Nearest neighbours in Euclidean distance: cells around centres, of which a query looks through the nearest.

Up to EXACT vectors, each query is held against all of them. Above that, k-means over a sample (SAMPLE rows a cell, chosen
by a hash of vec_id; at most CELLS * SAMPLE rows, in one task) gives the centres of at most CELLS cells; every row of the
table belongs to the cell of its nearest centre. A query looks through its PROBED nearest cells.

How many cells that are is not a parameter but measured: JUDGES queries, chosen by a hash, are held against all rows in one
pass, which tells in which cells their true neighbours lie. PROBED is the least number of cells that has RECALL of them;
for vectors without structure that may be most cells, but never fewer than the recall needs.

Rows go once to the parts that hold their cells (PART rows or so; near cells share a part, a cell of more rows has several
parts), queries once to each part that has a cell of theirs. A part holds its queries, and rows stream by in blocks of
CHUNK: products of matrices in single precision, moved to the block's mean, rule out all pairs that are beyond a query's
worst neighbour so far by more than a bound of their rounding error. The others' distances are computed from the original
vectors in double precision, so within what is looked through results are exact. Of equal vectors in a block only the MEMBERS
smallest vec_ids go on; more of them can't be in a result.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without vec_id or of another length than most; of rows that share a vec_id the least vector counts; ties go to the
smaller vec_id; a query with fewer candidates gets them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.llm.common import mixed, stored, table

TOP, QUERY_STEP = 10, 100
MEMBERS = TOP + 1
EXACT, CELLS, CELL_ROWS, SAMPLE, ROUNDS = 1 << 17, 4096, 2048, 32, 8
PART, LEAST_PART, PARTS, CHUNK = 1 << 17, 1 << 12, 12, 1 << 15
JUDGES, RECALL = 256, 0.95
RESULT = "query_id long, rank int, vec_id long, score double"


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as they are."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), values.dtype)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x.astype(np.float64) - y) ** 2).sum(1))


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that take part, but for their length and repeated vec_ids."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)


def same_length(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows that take part, one for each vec_id, their number and length."""
    rows = valid_rows(vectors)
    sizes = stored(rows.select("vec_id", F.size("vec").alias("size")))
    if not sizes.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = stored(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")))
        sizes = rows.select(F.size("vec").alias("size"))
    most = sizes.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    size, n = most or (0, 0)
    return rows.where(F.size("vec") == size), n, size


def _precision(*xs: np.ndarray) -> type:
    """Single, unless squares would leave its range."""
    top = max((float(np.abs(x).max()) for x in xs if x.size), default=0.0)
    return np.float32 if 1e-12 < top < 1e15 else np.float64


def order_of(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n centres nearest to each vector, nearest first."""
    out = np.empty((len(x), n), np.int64)
    kind = _precision(x, centres)
    c, x = centres.astype(kind), x.astype(kind, copy=False)
    half = (c * c).sum(1) / 2
    for b in range(0, len(x), 1024):
        near = half - x[b : b + 1024] @ c.T
        out[b : b + 1024] = near.argmin(1)[:, None] if n == 1 else np.argsort(near, axis=1, kind="stable")[:, :n]
    return out


def centres_of(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of k cells by k-means from k of the vectors; one that loses all its vectors stays where it is."""
    rng = np.random.default_rng(7)
    x = x.astype(_precision(x), copy=False)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        cell = order_of(x, centres, 1)[:, 0]
        order = np.argsort(cell, kind="stable")
        held, at = np.unique(cell[order], return_index=True)
        centres[held] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.r_[at, len(x)])[:, None]
    return centres


def _fitting(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [matrix(b.column(0)) for b in batches if len(b)]
        if rows:
            x = np.concatenate(rows)
            centres = centres_of(x, k)
            held = np.bincount(order_of(x, centres, 1)[:, 0], minlength=len(centres))
            yield pa.RecordBatch.from_arrays([pa.array(list(centres.astype(np.float64))), pa.array(held)], names=["centre", "held"])

    return run


def _along(centres: np.ndarray) -> np.ndarray:
    """Centres in an order in which near ones mostly come together: halves along two far ones, again and again."""
    out, todo, rng = [], [np.arange(len(centres))], np.random.default_rng(3)
    while todo:
        own = todo.pop()
        if len(own) <= 2:
            out.append(own)
            continue
        far = own[((centres[own] - centres[rng.choice(own)]) ** 2).sum(1).argmax()]
        side = centres[own] @ (centres[far] - centres[own[((centres[own] - centres[far]) ** 2).sum(1).argmax()]])
        order = own[np.argsort(side, kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return np.concatenate(out)


def parts_of(centres: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each cell, given the rows that each is expected to have."""
    first, number = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    part, held = 0, 0.0
    for c in _along(centres):
        if held and held + rows[c] > most:
            part, held = part + 1, 0.0
        first[c], number[c] = part, max(1, -(-int(rows[c]) // most))
        part += number[c] - 1
        held = held + rows[c] if number[c] == 1 else most
    return first, number


class Nearest:
    """The MEMBERS nearest of the rows seen so far to each query."""

    def __init__(self, q: np.ndarray) -> None:
        self.q = q
        self.d = np.full((len(q), MEMBERS), np.inf)
        self.ids = np.zeros((len(q), MEMBERS), np.int64)

    def see(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """own: the places of the queries that look at these rows."""
        for b in range(0, len(ids), 4096):
            y = x[b : b + 4096]
            mean = y.mean(0, dtype=np.float64)
            shifted = y - mean
            for k in range(0, len(own), 256):
                self._block(own[k : k + 256], ids[b : b + 4096], y, shifted, self.q[own[k : k + 256]] - mean)

    def _block(self, own: np.ndarray, ids: np.ndarray, y: np.ndarray, shifted: np.ndarray, p: np.ndarray) -> None:
        kind = _precision(shifted, p)
        s, p = shifted.astype(kind), p.astype(kind)
        near = (p * -2) @ s.T
        square, own_square = (s * s).sum(1), (p * p).sum(1).astype(np.float64)
        near += square
        # twice the bound of what rounding can do to a squared distance: either side of a comparison may be off
        doubt = 4 * (len(y[0]) + 8) * float(np.finfo(kind).eps) * (np.sqrt(own_square) + np.sqrt(float(square.max()))) ** 2
        worst = self.d[own, -1]
        fresh = np.flatnonzero(np.isinf(worst))
        bound = worst**2 - own_square
        if len(fresh):
            bound[fresh] = np.partition(near[fresh], MEMBERS - 1, axis=1)[:, MEMBERS - 1] if len(ids) >= MEMBERS else np.inf
        hit = np.flatnonzero(near <= (bound + doubt).astype(kind)[:, None])
        for b in range(0, len(hit), 1 << 16):
            r, c = np.divmod(hit[b : b + (1 << 16)], len(ids))
            self._put(own[r], ids[c], distances(y[c], self.q[own[r]]))

    def _put(self, r: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        closer = d <= self.d[r, -1]
        r, ids, d = r[closer], ids[closer], d[closer]
        touched = np.unique(r)
        r, ids, d = np.r_[np.repeat(touched, MEMBERS), r], np.r_[self.ids[touched].ravel(), ids], np.r_[self.d[touched].ravel(), d]
        r, ids, d = _first(r, ids, d, MEMBERS)
        self.ids[touched], self.d[touched] = ids.reshape(-1, MEMBERS), d.reshape(-1, MEMBERS)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and distance of all found."""
        r, k = np.nonzero(np.isfinite(self.d))
        return r, self.ids[r, k], self.d[r, k]


def _first(q: np.ndarray, u: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each q, sorted by q, distance and id."""
    order = np.lexsort((u, d, q))
    q, u, d = q[order], u[order], d[order]
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)])) < k
    return q[keep], u[keep], d[keep]


def few_of_equal(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows whose vector MEMBERS rows of smaller id have too."""
    bits = np.ascontiguousarray(x + x.dtype.type(0)).view(np.uint32 if x.dtype.itemsize == 4 else np.uint64)  # -0 is 0
    key = np.zeros(len(ids), np.uint64)
    for column in bits.T:
        key = mixed(key * np.uint64(31) + column)
    order = np.lexsort((ids, key))
    key = key[order]
    if len(ids) <= MEMBERS or not (key[MEMBERS:] == key[:-MEMBERS]).any():
        return ids, x
    own = bits[order]
    head = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(1)])
    keep = order[np.arange(len(ids)) - np.repeat(head, np.diff(np.r_[head, len(ids)])) < MEMBERS]
    return ids[keep], x[keep]


HOME = "part long, kind int, cell int, id long, vec {}, cells array<int>"


def _placing(centres: np.ndarray, first: np.ndarray, number: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, vec) with their cell and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cell = order_of(matrix(b.column(1)), centres, 1)[:, 0]
            some = mixed(b.column(0).to_numpy().view(np.uint64)) % number[cell].astype(np.uint64)
            part = first[cell] + some.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(b), np.int32)), pa.array(cell.astype(np.int32)), b.column(0), b.column(1), pa.nulls(len(b), pa.list_(pa.int32()))], names=["part", "kind", "cell", "id", "vec", "cells"])

    return run


def _asking(centres: np.ndarray, first: np.ndarray, number: np.ndarray, probed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of queries (vec_id, vec) a row for each part that has some of their nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 256) for k in range(0, len(whole), 256)):
                cells = order_of(matrix(b.column(1)), centres, probed)
                row, cell = np.repeat(np.arange(len(b)), probed), cells.ravel()
                times = number[cell]
                row, cell, nth = np.repeat(row, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                part = first[cell] + nth
                order = np.lexsort((cell, part, row))
                row, cell, part = row[order], cell[order], part[order]
                head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(row)].astype(np.int32)), pa.array(cell.astype(np.int32)))
                at, zeros = pa.array(row[head]), np.zeros(len(head), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part[head]), pa.array(zeros), pa.array(zeros), b.column(0).take(at), b.column(1).take(at), lists], names=["part", "kind", "cell", "id", "vec", "cells"])

    return run


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of HOME in the order of part, kind and cell: the queries of a part (kind 0), which are held, then its rows, CHUNK at a time."""
    part, asked, waiting, n = None, [], [], 0
    q, near, who, which = np.zeros(0, np.int64), None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look() -> None:
        nonlocal q, near, who, which, asked, waiting, n
        if asked:
            q = np.concatenate([b.column(3).to_numpy() for b in asked])
            near = Nearest(np.concatenate([matrix(b.column(4)) for b in asked]).astype(np.float64))
            who = np.repeat(np.arange(len(q)), np.concatenate([b.column(5).value_lengths().to_numpy() for b in asked]))
            which = np.concatenate([b.column(5).flatten().to_numpy() for b in asked])
            order = np.argsort(which, kind="stable")
            who, which, asked = who[order], which[order], []
        if waiting and near is not None:
            cell, ids = (np.concatenate([b.column(i).to_numpy() for b in waiting]) for i in (2, 3))
            x = np.concatenate([matrix(b.column(4)) for b in waiting])
            edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for b, e in zip(edge, np.r_[edge[1:], len(cell)]):
                own = who[np.searchsorted(which, cell[b]) : np.searchsorted(which, cell[b], "right")]
                if len(own):
                    near.see(own, *few_of_equal(ids[b:e], x[b:e]))
        waiting, n = [], 0

    def told() -> Iterator[pa.RecordBatch]:
        look()
        if near is not None:
            r, u, d = near.rows()
            yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(u), pa.array(d)], names=["q", "u", "d"])

    for whole in batches:
        home, kind = whole.column(0).to_numpy(), whole.column(1).to_numpy()
        edges = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (kind[1:] != kind[:-1])]) if len(whole) else []
        for b, e in zip(edges, [*edges[1:], len(whole)]):
            if home[b] != part:
                if part is not None:
                    yield from told()
                part, near = home[b], None
            (waiting if kind[b] else asked).append(whole.slice(int(b), int(e - b)))
            n += int(e - b) if kind[b] else 0
            if n >= CHUNK:
                look()
    if part is not None:
        yield from told()


def _judging(ids: np.ndarray, q: np.ndarray, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nearest of the rows (vec_id, vec) of a partition to each of a few queries, and the cells of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, cells = Nearest(q), {}
        for b in batches:
            if not len(b):
                continue
            own, x = few_of_equal(b.column(0).to_numpy(), matrix(b.column(1)))
            near.see(np.arange(len(q)), own, x)
            new = np.flatnonzero(np.isin(own, near.ids))
            cells |= zip(own[new].tolist(), order_of(x[new], centres, 1)[:, 0].tolist())
            kept = set(near.ids.ravel().tolist())
            cells = {k: v for k, v in cells.items() if k in kept}
        r, u, d = near.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(u), pa.array(d), pa.array([cells[k] for k in u.tolist()], pa.int64())], names=["q", "u", "d", "cell"])

    return run


def cells_needed(queries: DataFrame, rows: DataFrame, centres: np.ndarray) -> int:
    """How many of its nearest cells a query has to look through for RECALL of the TOP nearest of JUDGES queries by brute force over all rows."""
    judges = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(JUDGES).collect()
    if not judges:
        return 1
    ids, x = np.array([r[0] for r in judges]), np.array([r[1] for r in judges], np.float64)
    found = rows.mapInArrow(_judging(ids, x, centres), "q long, u long, d double, cell long").where("q != u")
    true = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "u", "cell"))), 1, TOP).alias("x")).select("q", "x.cell").collect()
    place = np.argsort(order_of(x, centres, len(centres)), axis=1)
    row = {int(v): i for i, v in enumerate(ids)}
    ranks = np.sort([int(place[row[r[0]], c]) for r in true for c in r[1]])
    return int(ranks[int(np.ceil(RECALL * len(ranks))) - 1]) + 1 if len(ranks) else 1


def _ranking(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nearest of each query of a partition, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if rows:
            q, u, d = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in range(3))
            other = q != u
            q, u, d = _first(q[other], u[other], d[other], top)
            head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)])) + 1
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(u), pa.array(d)], names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, step: int = QUERY_STEP, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by step."""
    rows, n, size = same_length(vectors)
    if not n:
        return vectors.sparkSession.createDataFrame([], RESULT)
    queries = stored(rows.where(F.pmod("vec_id", F.lit(step)) == 0))
    k, centres, held = 1 if n <= EXACT else max(1, min(CELLS, n // CELL_ROWS)), np.zeros((1, size)), np.ones(1)
    if k > 1:
        some = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < int(min(1, SAMPLE * k / n) * (1 << 30))
        got = rows.where(some).select("vec").coalesce(1).mapInArrow(_fitting(k), "centre array<double>, held long").collect()
        if got:
            centres, held = np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)
    first, number = parts_of(centres, held * (n / held.sum()), max(LEAST_PART, min(PART, -(-n // PARTS))))
    probed = cells_needed(queries, rows, centres) if len(centres) > 1 else 1
    home = HOME.format(rows.schema["vec"].dataType.simpleString())
    both = rows.mapInArrow(_placing(centres, first, number), home).unionByName(queries.mapInArrow(_asking(centres, first, number, probed), home))
    found = both.repartition("part").sortWithinPartitions("part", "kind", "cell").mapInArrow(_answering, "q long, u long, d double")
    return found.repartition("q").mapInArrow(_ranking(top), RESULT)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
