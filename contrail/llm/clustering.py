"""Centroid clustering with Drake's adaptive bounds: exact k-means over integer vectors that skips most distances.

A stored row holds a block of some vectors, a task holds some thousand vectors at a time, and a round is one pass over the
blocks. Beside its vectors a block carries their state: the assigned centroid, an upper bound on the distance
to it, for each vector lower bounds on the distances to its ``width`` nearest other centroids, in their order, and one
remainder bound below the distance to any other centroid. When centroids move, an upper bound grows by its centroid's
shift, a lower bound shrinks by its centroid's, the remainder by the largest shift of any. Then, for each vector:

1. the upper bound is below all lower bounds: the assignment is certain and no distance is computed;
2. else the upper bound is made exact, and the same test is repeated;
3. else, if it is below the remainder bound, only the near centroids whose bounds it does not pass are measured;
4. else the order of the near centroids cannot be certified: all centroids are measured, and all bounds are made anew.

The number of near bounds adapts: a round keeps as many as its predecessor needed. Distances are exact integers; bounds are
floating point and are widened by more than their rounding error, and equality is never certified, so ties go to the
smaller number as in a full scan. Each task hands on how its clusters' sums changed: the driver gets k x dims numbers a
round, and no vector. Each round's table is in the shared folder and its predecessor is deleted, so a lost
executor costs one round's tasks at most.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are not kept; a null or
repeated id is an id like any other (a null hashes as an empty one; vectors of equal hash are taken in their own order);
with fewer than k vectors there are as many centroids as vectors, with none the result is empty; an empty cluster keeps its
centroid; components of 2^27 or more after scaling raise an error, as squared distances could leave 63 bits. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import drop_stored, slices, stored

_SLACK = 1e-9  # far above the rounding of a bound over all rounds, far below any difference that matters
_LARGEST = 1 << 27
_STATE = "id array<long>, x binary, near binary, low binary, cluster binary, upper binary, sums array<long>, used int, scanned long"


def scaled(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """``id, x``: vectors with exactly ``dims`` finite components, as whole numbers ``floor(scale * component)``."""
    v = F.col(vec_col)
    sound = (F.size(v) == dims) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def whole(c: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * c.cast("double"))
        return F.when(F.abs(c.cast("double") * scale) < _LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))

    return vectors.where(v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("x"))


def seeds(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ``seed:id`` have the smallest SHA-256, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in kept.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()], np.int64)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


class Bounds:
    """A block's assignment and bounds; ``scanned`` counts the exact distances that were computed."""

    def __init__(self, x: np.ndarray, width: int, cluster=None, upper=None, near=None, low=None):
        self.x, self.width, self.scanned, self.used = x, width, 0, 1
        self.cluster, self.upper, self.near, self.low = cluster, upper, near, low  # low has the remainder in its last column

    def scan(self, rows: np.ndarray, c: np.ndarray) -> None:
        """Measure all centroids for some rows, and make their bounds anew."""
        d = _distances(self.x[rows], c)
        self.scanned += d.size
        order = np.argsort(d, axis=1, kind="stable")  # of equal distances the smaller number first
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        w = self.width
        self.cluster[rows], self.upper[rows] = order[:, 0], root[:, 0] * (1 + _SLACK)
        near, low = np.full((len(rows), w), -1, np.int32), np.full((len(rows), w + 1), np.inf)
        held = min(w, len(c) - 1)
        near[:, :held], low[:, :held] = order[:, 1 : held + 1], root[:, 1 : held + 1]
        if len(c) > w + 1:
            low[:, w] = root[:, w + 1]
        self.near[rows], self.low[rows] = near, low * (1 - _SLACK)

    def first(self, c: np.ndarray) -> None:
        n = len(self.x)
        self.cluster, self.upper = np.zeros(n, np.int32), np.zeros(n)
        self.near, self.low = np.full((n, self.width), -1, np.int32), np.full((n, self.width + 1), np.inf)
        self.scan(np.arange(n), c)

    def resize(self, width: int) -> None:
        """Keep fewer near bounds: the remainder covers those that go."""
        if width < self.width:
            rest = self.low[:, width:].min(1)
            self.near, self.low, self.width = self.near[:, :width], np.column_stack([self.low[:, :width], rest]), width

    def moved(self, shift: np.ndarray) -> None:
        """Bounds after the centroids moved by ``shift``."""
        self.upper = (self.upper + shift[self.cluster]) * (1 + _SLACK)
        by = np.where(self.near >= 0, shift[self.near], 0.0)
        self.low[:, :-1] = np.maximum(self.low[:, :-1] - by, 0) * (1 - _SLACK)
        self.low[:, -1] = np.maximum(self.low[:, -1] - shift.max(), 0) * (1 - _SLACK)

    def settle(self, c: np.ndarray) -> None:
        """The nearest centroid of every vector, measuring as little as the bounds allow."""
        open_ = np.nonzero(self.upper >= self.low.min(1))[0]
        if not len(open_):
            return
        own = ((self.x[open_] - c[self.cluster[open_]]) ** 2).sum(1)
        self.scanned += len(open_)
        self.upper[open_] = np.sqrt(own.astype(float)) * (1 + _SLACK)
        unsure = self.upper[open_] >= self.low[open_].min(1)
        open_, own = open_[unsure], own[unsure]
        if not len(open_):
            return
        all_ = self.upper[open_] >= self.low[open_, -1]
        partly, own = open_[~all_], own[~all_]
        if len(partly):
            asked = self.upper[partly, None] >= self.low[partly, :-1]
            self.used = max(self.used, int(np.nonzero(asked.any(0))[0].max(initial=0)) + 1)
            row, col = np.nonzero(asked)
            number = self.near[partly[row], col]
            d = ((self.x[partly[row]] - c[number]) ** 2).sum(1)
            self.scanned += len(d)
            # the nearest of what was measured and the assigned one: smallest distance, then smallest number
            best, which, at = own.copy(), self.cluster[partly].copy(), np.full(len(partly), -1)
            for j in range(asked.shape[1]):
                mine = np.nonzero(col == j)[0]
                r = row[mine]
                better = (d[mine] < best[r]) | ((d[mine] == best[r]) & (number[mine] < which[r]))
                best[r[better]], which[r[better]], at[r[better]] = d[mine][better], number[mine][better], j
            self.low[partly[row], col] = np.sqrt(d.astype(float)) * (1 - _SLACK)
            swap = np.nonzero(at >= 0)[0]  # the former centroid takes the place of the new one
            rows, j = partly[swap], at[swap]
            self.near[rows, j], self.low[rows, j] = self.cluster[rows], np.sqrt(own[swap].astype(float)) * (1 - _SLACK)
            self.cluster[rows], self.upper[rows] = which[swap], np.sqrt(best[swap].astype(float)) * (1 + _SLACK)
        if all_.any():
            self.used = self.width
            self.scan(open_[all_], c)


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Of each cluster the count and the sums of components: k x (1 + dims)."""
    out = np.zeros((k, 1 + x.shape[1]), np.int64)
    for j in range(k):
        mine = x[cluster == j]
        out[j, 0], out[j, 1:] = len(mine), mine.sum(0)
    return out


def _rows(ids: list, b: Bounds, block: int) -> Iterator[pa.RecordBatch]:
    """A stored row for each ``block`` vectors."""
    names = ["id", "x", "near", "low", "cluster", "upper", "sums", "used", "scanned"]
    parts = [b.x.astype(np.int32), b.near, b.low, b.cluster, b.upper]
    cuts = range(0, len(ids), block)
    packed = [pa.array([x[i : i + block].tobytes() for i in cuts], pa.binary()) for x in parts]
    told = [pa.nulls(len(cuts), pa.list_(pa.int64())), pa.array([b.used] * len(cuts), pa.int32()), pa.array([b.scanned] + [0] * (len(cuts) - 1), pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + block] for i in cuts], pa.list_(pa.int64())), *packed, *told], names)


def _sums_row(sums: np.ndarray) -> pa.RecordBatch:
    """A task's last row: the sums (or changes of sums) of its vectors, and no vector."""
    empty = [pa.array([b""], pa.binary())] * 5
    told = [pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([0], pa.int32()), pa.array([0], pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([[]], pa.list_(pa.int64())), *empty, *told], ["id", "x", "near", "low", "cluster", "upper", "sums", "used", "scanned"])


def _first_pass(kept: DataFrame, c: np.ndarray, width: int, block: int, held: int) -> DataFrame:
    """Blocks of vectors with their first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(c), 1 + c.shape[1]), np.int64)
        for part in slices(batches, held):
            if part.num_rows:
                b = Bounds(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1), width)
                b.first(c)
                sums += _sums(b.x, b.cluster, len(c))
                yield from _rows(part.column(0).to_pylist(), b, block)
        yield _sums_row(sums)

    return kept.mapInArrow(run, _STATE)


def _read(part: pa.RecordBatch, dims: int, width: int) -> tuple[list, Bounds]:
    """The vectors of some stored rows and their state."""
    rows = part.to_pylist()
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    x = joined("x", np.int32).reshape(-1, dims).astype(np.int64)
    ids = [i for r in rows for i in r["id"]]
    return ids, Bounds(x, width, joined("cluster", np.int32).copy(), joined("upper", float), joined("near", np.int32).reshape(-1, width).copy(), joined("low", float).reshape(-1, width + 1).copy())


def _next_pass(blocks: DataFrame, c: np.ndarray, shift: np.ndarray, width: int, keep: int, block: int, held: int) -> DataFrame:
    """Blocks after the centroids moved to ``c``; a task's sums are the changes since the pass before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((len(c), 1 + c.shape[1]), np.int64)
        for part in slices(batches, max(1, held // block)):
            ids, b = _read(part, c.shape[1], width)
            if ids:
                before = b.cluster.copy()
                b.resize(keep)
                b.moved(shift)
                b.settle(c)
                went = np.nonzero(before != b.cluster)[0]
                change += _sums(b.x[went], b.cluster[went], len(c)) - _sums(b.x[went], before[went], len(c))
                yield from _rows(ids, b, block)
        yield _sums_row(change)

    return blocks.mapInArrow(run, _STATE)


def _totals(blocks: DataFrame, k: int, dims: int) -> tuple[np.ndarray, int, int]:
    """Sums of the tasks' sums, the largest number of near bounds used, and how many distances were computed."""
    each = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(k * (1 + dims), np.int64)
    for r in each:
        out[r["i"]] = r["s"]
    most = blocks.agg(F.max("used").alias("used"), F.sum("scanned").alias("scanned")).first()
    return out.reshape(k, 1 + dims), most["used"] or 1, most["scanned"] or 0


def _members(blocks: DataFrame, c: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, cluster = np.frombuffer(row["x"], np.int32).reshape(-1, c.shape[1]).astype(np.int64), np.frombuffer(row["cluster"], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["id"], pa.int64()), pa.array(cluster), pa.array(((x - c[cluster]) ** 2).sum(1))], ["id", "cluster", "distance"])

    return blocks.select("id", "x", "cluster").mapInArrow(run, "id long, cluster int, distance long")


def kmeans(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: str = "3", width: int = 3, block: int = 128, held: int = 4096) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Members (``id, cluster, distance``, a stored table), final centroids, and the distances computed in each pass.

    ``width``: near bounds kept at first. ``block, held``: vectors in a stored row, and that a task works on at a time. Centroids begin as the k vectors of the smallest hashes of ``seed:id``; each of
    ``rounds`` rounds assigns all vectors and replaces each non-empty cluster's centroid by the floor of its mean.
    """
    kept = scaled(vectors, id_col, vec_col, dims, scale)
    c = seeds(kept, k, seed)
    k = len(c)
    if k == 0:
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.zeros((0, dims), np.int64), []
    width = max(1, min(width, k - 1))
    blocks = stored(_first_pass(kept, c, width, block, held))
    sums, used, scanned = _totals(blocks, k, dims)
    computed = [scanned]
    for i in range(rounds):
        new = np.where(sums[:, :1] > 0, sums[:, 1:] // np.maximum(sums[:, :1], 1), c)  # floors, also of negative sums
        shift = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + _SLACK)
        # the first passes may need more bounds than later ones: from the second on as many as were used
        keep = width if i < 2 else max(1, min(width, used))
        after = stored(_next_pass(blocks, new, shift, width, keep, block, held))
        drop_stored(blocks)
        blocks, c, width = after, new, keep
        change, used, scanned = _totals(blocks, k, dims)
        sums += change
        computed.append(scanned)
    members = stored(_members(blocks, c))
    drop_stored(blocks)
    return members, c, computed
