"""Exact top-k inner products by no-random-access aggregation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import block_of, dealt, matrix, usable

#: Rows of the smallest shard, components of the largest (32 MB of numbers), queries of a block.
SMALL, COMPONENTS, BLOCK, SCALE = 8192, 1 << 22, 256, 1024
#: Parts in which a list is read, and entries of a part at least.
STRETCHES, ENTRIES = 8, 2048
#: Queries that read the lists together.
TOGETHER = 32


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v): 64-bit where all fit well, else Python's integers."""
    x = np.floor(SCALE * v)
    if np.abs(x).max(initial=0) < 2**40:
        return x.astype(np.int64)
    return np.array([[int(SCALE * y) if abs(y) > 2**52 else int(np.floor(SCALE * y)) for y in row] for row in v.tolist()], object).reshape(v.shape)


class Lists:
    """A shard's sorted lists: for each dimension the components in ascending order, and whose they are."""

    def __init__(self, x: np.ndarray):
        self.rows = np.ascontiguousarray(np.argsort(x, 0, kind="stable").T)
        self.values = np.take_along_axis(x.T, self.rows, 1).astype(np.float64)
        self.n = len(x)

    def best(self, q: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(for each row of q, the rows among which its k largest inner products are, ties included; entries read).

        Lists are read once for all queries, from both ends: a query uses the end that gives it the larger
        products. A row's lower bound is the sum of what has been read of it and of the least that its
        other components can give; every entry read raises it. Its upper bound has the frontiers of the
        lists where it has not been read instead. The list read on next is the one whose frontiers are
        furthest from its ends. At looks ever closer to the ends, rows whose upper bound is below a query's
        k-th lower bound are out; a query stops when no more than 2 * k rows can qualify, or at the ends.
        """
        n, dims, m = self.n, len(self.rows), len(q)
        found: list = [np.arange(n)] * m
        read, depth = np.zeros(m, np.int64), np.zeros(dims, np.int64)
        if n <= k or not m:
            return found, read
        step = max(ENTRIES, -(-n // STRETCHES))
        up = q >= 0
        worst = np.where(up, q * self.values[:, 0], q * self.values[:, -1])
        open_ = np.where(up, q * self.values[:, -1], q * self.values[:, 0]) - worst
        seen = np.zeros((2, dims, n), bool)  # from below, from above
        low, live = np.repeat(worst.sum(1)[None], n, 0), np.arange(m)
        next_look = open_.sum() / 2
        while len(live):
            d = int(np.argmax(open_.sum(0)))
            ended = not open_[:, d].any()  # what is left of all lists gives each row the same
            if not ended:
                a, b = int(depth[d]), min(n, int(depth[d]) + step)
                depth[d] = b
                edges = []
                for side, part in enumerate((slice(a, b), slice(n - b, n - a))):
                    rows, values = self.rows[d, part], self.values[d, part]
                    own = up[:, d] == bool(side)
                    low[rows] += values[:, None] * np.where(own, q[:, d], 0) - np.where(own, worst[:, d], 0)
                    seen[side, d][rows] = True
                    edges.append(values[-1 - side * (b - a - 1)])
                read[live] += b - a
                open_[:, d] = np.where(up[:, d], q[:, d] * edges[1], q[:, d] * edges[0]) - worst[:, d] if b < n else 0
                if open_.sum() > next_look:
                    continue
            next_look = 0.7 * open_.sum()
            by_query = np.ascontiguousarray(low.T)
            kth = np.partition(by_query, n - k, axis=1)[:, n - k]
            can = by_query + open_.sum(1)[:, None] >= kth[:, None]
            stay = np.ones(len(live), bool)
            for i in np.flatnonzero((can.sum(1) <= n // 8) | ended):
                rows = np.flatnonzero(can[i])
                unseen = np.where(up[i][:, None], ~seen[1][:, rows], ~seen[0][:, rows])
                rows = rows[by_query[i, rows] + open_[i] @ unseen >= kth[i]]
                if ended or len(rows) <= 2 * k:
                    found[live[i]], stay[i] = rows, False
            if not stay.all():
                live, q, up, worst, open_ = live[stay], q[stay], up[stay], worst[stay], open_[stay]
                low, next_look = np.ascontiguousarray(low[:, stay]), next_look * stay.mean()
        return found, read


def top_products(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products of floor(1024 * component), exact.

    Queries are the rows whose vec_id `every` divides, candidates all rows but the query's own. Rows are
    dealt to shards; a task sorts its shard's lists once and reads them for each query as far as bounds
    ask, then resolves the final scores of the rows left; the shards' best are merged. Ties go to the
    smaller vec_id. Null or non-finite vectors and null ids take no part; rows of another length than the
    query's are no candidates; repeated rows are candidates each; of a repeated id the largest vector
    asks; sums beyond 64 bits become the nearest 64-bit number; an empty table gives an empty result;
    other columns are ignored.
    """
    rows, blocks = dealt(usable(vectors, zero=True), every, BLOCK, SMALL, COMPONENTS)

    def pack(group: pa.Table) -> pa.Table:
        v = matrix(group.column("v"), len(group.column("v")[0])).astype("<f8")
        return pa.table({"shard": group.column("shard")[:1], "own": pa.array([group.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "rows": pa.array([v.tobytes()], pa.binary())})

    packed = stored(rows.groupBy("shard").applyInArrow(pack, "shard struct<dim:int,part:int>, own binary, rows binary"))

    def find(batches):
        held = None, None  # the shard met last, with its lists
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column("shard")[r].as_py()
                if held[0] != shard:
                    own = np.frombuffer(batch.column("own")[r].as_py(), "<i8")
                    x = whole_numbers(np.frombuffer(batch.column("rows")[r].as_py(), "<f8").reshape(len(own), -1))
                    repeats = np.unique(own, return_counts=True)
                    held = shard, (own, x, Lists(x) if x.dtype != object else None, dict(zip(*(c[repeats[1] > 1] for c in repeats))))
                own, x, lists, many = held[1]
                names, q = block_of(batch, r)
                q = whole_numbers(q)
                plain = lists is not None and q.dtype != object and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**51
                out = []
                left_of = []
                for a in range(0, len(names), TOGETHER):
                    some = names[a : a + TOGETHER].tolist()
                    left_of += lists.best(q[a : a + TOGETHER].astype(np.float64), k + max(int(many.get(x, 1)) for x in some))[0] if plain else [np.arange(len(own))] * len(some)
                for name, y, left in zip(names.tolist(), q, left_of):
                    left = left[own[left] != name]
                    score = (x[left] * y).sum(1)
                    best = np.lexsort((own[left], -score))[:k] if plain else sorted(range(len(left)), key=lambda i: (-score[i], own[left[i]]))[:k]  # noqa: B023
                    out += [(name, int(own[left[i]]), max(-(2**63), min(2**63 - 1, int(score[i])))) for i in best]
                yield pa.record_batch({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    found = packed.join(blocks, "shard").mapInArrow(find, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
