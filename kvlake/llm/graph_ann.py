"""Approximate nearest neighbours over robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import block_of, dealt, matrix, usable

#: Rows of the smallest shard, components of the largest (16,384 rows of 64), queries of a block.
SMALL, COMPONENTS, BLOCK = 2048, 1 << 20, 512
#: Nodes of a graph for which a search's beam is once more as wide, so that large shards lose no recall.
WIDER = 8192


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of each query's beam, nearest first; -1 where it is not full. All queries step together: each expands its nearest node not yet expanded. graph: rows of neighbours, -1 for none."""
    m, n = len(q), len(x)
    nodes = np.full((m, beam), -1, np.int32)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    nodes[:, 0], dist[:, 0], done[:, 0], seen[:, entry] = entry, 1 - q @ x[entry], False, True
    live = np.arange(m)
    while len(live):
        pick = np.argmin(np.where(done[live], np.inf, dist[live]), 1)
        done[live, pick] = True
        near = graph[nodes[live, pick]]
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(new, near, nodes[live, pick][:, None])] = True
        d = np.where(new, 1 - np.einsum("qrd,qd->qr", x[near], q[live], optimize=True), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], 1)
        keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(new, near, -1)], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), keep, 1)
        live = live[~done[live].all(1)]
    return nodes, dist


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to `degree` out-neighbours of each node in own, from its row of cand (-1: none): the nearest candidate stays and drops those that are alpha times nearer to it than to the node, again and again."""
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == own[:, None]] = -1
    v = x[cand]
    d = np.where(cand >= 0, 1 - np.einsum("bcd,bd->bc", v, x[own], optimize=True), np.inf)
    out = np.full((len(own), degree), -1, np.int32)
    row = np.arange(len(own))
    for k in range(degree):
        best = np.argmin(d, 1)
        ok = np.isfinite(d[row, best])
        if not ok.any():
            break
        out[ok, k] = cand[row, best][ok]
        between = 1 - np.einsum("bcd,bd->bc", v, v[row, best], optimize=True)
        d = np.where(alpha * between <= d, np.inf, d)
        d[row, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, batch: int = 256) -> tuple[np.ndarray, int]:
    """(graph, entry) over distinct unit vectors x. Nodes are added in batches: greedy searches of the graph so far propose candidates, pruning keeps diverse ones, and reverse edges are added and pruned where too many."""
    n = len(x)
    x = x.astype(np.float32)
    entry = int(np.argmax(x @ x.mean(0)))
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate(([entry], order[order != entry])).astype(np.int32)
    for sweep in range(2):
        size, k = (2, 1) if sweep == 0 else (batch, 0)
        while k < n:
            own = order[k : k + size]
            found, _ = beam_search(x, graph, entry, x[own], beam)
            cand = np.concatenate([found, graph[own], np.broadcast_to(own, (len(own), len(own)))], 1) if sweep == 0 and k < batch else np.concatenate([found, graph[own]], 1)
            graph[own] = robust_prune(x, own, cand, degree, alpha if sweep else 1.0)
            source, target = np.repeat(own, degree), graph[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads, first, many = np.unique(target, return_index=True, return_counts=True)
            width = int(many.max(initial=0))
            for a in range(0, len(heads), batch):
                h, f, c = heads[a : a + batch], first[a : a + batch], many[a : a + batch]
                col = np.arange(width)
                added = np.where(col < c[:, None], source[np.minimum(f[:, None] + col, len(source) - 1)], -1)
                graph[h] = robust_prune(x, h, np.concatenate([graph[h], added], 1), degree, alpha if sweep else 1.0)
            k += len(own)
            size = min(size * 2, batch)
    return graph, entry


def search(vectors: DataFrame, k: int = 5, every: int = 50, beam: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found by largest cosine, in double precision.

    Queries are the rows whose vec_id `every` divides, candidates all rows but the query's own. Rows are
    dealt to shards by hash; a task links one shard's distinct directions to a graph and
    searches it with blocks of queries; the shards' best are merged. Equal directions are one node of the
    graph and share its score; ties go to the smaller vec_id. Null, zero or non-finite vectors and null
    ids take no part; rows of another length than the query's are no candidates; repeated rows count as
    rows with one id, of which a query leaves out all with its own, and of which the largest vector asks;
    an empty table gives an empty result; other columns are ignored.
    """
    rows, blocks = dealt(usable(vectors, zero=False), every, BLOCK, SMALL, COMPONENTS)

    def index(group: pa.Table) -> pa.Table:
        v = matrix(group.column("v"), len(group.column("v")[0]))
        ids = group.column("vec_id").to_numpy()
        unit = v / np.abs(v).max(1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        nodes, inverse = np.unique(unit, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse))
        graph, entry = build(nodes)
        columns = {"nodes": nodes.astype("<f8"), "graph": graph.astype("<i4"), "ids": ids[order].astype("<i8"), "first": np.searchsorted(inverse[order], np.arange(len(nodes) + 1)).astype("<i8")}
        return pa.table({"shard": group.column("shard")[:1], "entry": [entry]} | {f"g_{c}": pa.array([a.tobytes()], pa.binary()) for c, a in columns.items()})

    shard = "shard struct<dim:int,part:int>"
    graphs = stored(rows.groupBy("shard").applyInArrow(index, f"{shard}, entry long, g_nodes binary, g_graph binary, g_ids binary, g_first binary"))

    def find(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                take = lambda c, kind: np.frombuffer(batch.column(c)[r].as_py(), kind)  # noqa: B023, E731
                ids, first = take("g_ids", "<i8"), take("g_first", "<i8")
                n = len(first) - 1
                nodes, graph = take("g_nodes", "<f8").reshape(n, -1), take("g_graph", "<i4").reshape(n, -1)
                names, q = block_of(batch, r)
                unit = q / np.abs(q).max(1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                got, _ = beam_search(nodes.astype(np.float32), graph, batch.column("entry")[r].as_py(), unit.astype(np.float32), beam * (1 + n // WIDER))
                score = np.where(got >= 0, np.einsum("qkd,qd->qk", nodes[got], unit), -np.inf)
                out = []
                for name, g, s in zip(names.tolist(), got, score):
                    own: list[tuple[float, int]] = []
                    for at in np.argsort(-s, kind="stable"):
                        if s[at] == -np.inf or len(own) >= k and s[at] < own[-1][0]:
                            break
                        same = ids[first[g[at]] : first[g[at] + 1]]
                        own += [(float(s[at]), int(x)) for x in same[: np.searchsorted(same, name)][:k]]
                        own += [(float(s[at]), int(x)) for x in same[np.searchsorted(same, name, "right") :][:k]]
                    out += [(name, x, s) for s, x in sorted(own, key=lambda y: (-y[0], y[1]))[:k]]
                yield pa.record_batch({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    found = graphs.join(blocks, "shard").mapInArrow(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
