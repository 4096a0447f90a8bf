"""1. Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Up to SHARD_ROWS vectors of a length are one shard. More are dealt by the clusters of their directions (routing.py), and a query visits the shards of as many clusters as measured on a bounded number of exact
answers, so the work grows with the queries, not with queries times shards. A shard's vectors get one
more component that makes all norms equal, so the largest inner product with a query is the smallest distance to it. Nodes draw
levels as in the published method and are inserted in blocks: every node of a block searches the graph as it stands, from the top with a beam on each level, for the nearest nodes
there, to which the nearest nodes before it in its block are added. On each of its levels it is linked to up to LINKS of them that
the diversity rule keeps (no kept neighbour lies nearer to the candidate than the node does), the links are made mutual,
and a node whose links exceed its room keeps those that the same rule prefers. Equal vectors of a shard are one node, which carries all their ids, so copies take no
room among links or in a beam. A level is stored as flat arrays: its nodes, and LINKS places for each (twice as many on the lowest).

A search enters at the top, keeps a beam on every level and a wide one (EF) on the lowest, for a block of queries at once. Each shard that it visits gives its best k, scored in double precision on the original vectors, and a ranking by query merges them, after
a ranking inside each task.

Null, zero and non-finite vectors, and those with null components, take no part, as candidate or as query; neither do null ids. Floats are scored as they are, other numbers as doubles; graphs hold
vectors scaled to single precision, whatever their size. Vectors of different lengths never meet. Very long vectors make a shard's bytes grow with them. Columns of other names don't matter. Rows that share the query's id are its own; repeated rows of another id are candidates each. If a query id
repeats, its smallest vector asks. Ties go to the smaller id. Empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huespan.llm import routing
from huespan.llm.common import materialize

#: Rows of a shard, links of a node (twice as many on the lowest level), and widths of the beams: of a search, on the upper levels, and of an insertion.
SHARD_ROWS, LINKS, EF, EF_UPPER, EF_BUILD = 65536, 20, 320, 16, 80
#: Nodes that are inserted at once, at most.
INSERT_BLOCK = 512
#: Queries searched at once, and those that a task gets for one shard.
QUERY_BLOCK, QUERY_GROUP = 256, 4096


def _diverse(sims: np.ndarray, cand: np.ndarray, vectors: np.ndarray, room: int) -> np.ndarray:
    """Up to room of each row's candidates (sorted, nearest first, -1 for none), -1 padded: the diverse ones, then the nearest others."""
    b, c = cand.shape
    v = vectors[np.maximum(cand, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((b, c), dtype=bool)
    for k in range(c):
        shadowed = (kept[:, :k] & (between[:, k, :k] >= sims[:, k, None])).any(axis=1)
        kept[:, k] = ~shadowed & (cand[:, k] >= 0) & (kept[:, :k].sum(axis=1) < room)
    # Kept ones first, then the rest, both nearest first.
    order = np.argsort(np.where(cand < 0, 2 * c, np.where(kept, 0, c)) + np.arange(c), axis=1, kind="stable")[:, :room]
    out = np.take_along_axis(cand, order, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, room - out.shape[1]))), constant_values=-1)


def _nearest_first(sims: np.ndarray, cand: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` nearest of each row's candidates (-1: none), nearest first, and their similarities."""
    sims = np.where(cand >= 0, sims, -np.inf)
    if cand.shape[1] > most:
        part = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        sims, cand = np.take_along_axis(sims, part, axis=1), np.take_along_axis(cand, part, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, order, axis=1), np.take_along_axis(cand, order, axis=1)


def _insert(vectors: np.ndarray, links: np.ndarray, lo: int, hi: int, found: np.ndarray) -> None:
    """Links the nodes lo to hi of a level (its vectors) with those found on it (places, -1 for none) and with earlier ones of the block."""
    room, new = links.shape[1], vectors[lo:hi]
    b = hi - lo
    inside = np.where(np.arange(b)[None, :] < np.arange(b)[:, None], np.arange(lo, hi)[None, :], -1)
    cand = np.concatenate([found, inside], axis=1)
    sims = np.concatenate([_dots(vectors, np.maximum(found, 0), new), new @ new.T], axis=1)
    sims, cand = _nearest_first(sims, cand, EF_BUILD)
    own = _diverse(sims, cand, vectors, max(1, room // 2))
    links[lo:hi, : own.shape[1]] = own
    # The other way: what each linked node has, and its new neighbours.
    src, place = np.nonzero(own >= 0)
    if not len(src):
        return
    to, src = own[src, place], src + lo
    ys = np.unique(to)
    had = links[ys]
    owner, at = np.nonzero(had >= 0)
    owner = np.concatenate([owner, np.searchsorted(ys, to)])
    other = np.concatenate([had[had >= 0], src])
    known, owner = np.unique(owner.astype(np.int64) * len(vectors) + other), None
    owner, other = known // len(vectors), known % len(vectors)
    near = np.einsum("ed,ed->e", vectors[ys[owner]], vectors[other])
    order = np.lexsort((-near, owner))
    owner, other, near = owner[order], other[order], near[order]
    count = np.bincount(owner, minlength=len(ys))
    col = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    width = min(int(count.max()), 3 * room)
    fits = col < width
    cand, sims = np.full((len(ys), width), -1, dtype=np.int64), np.full((len(ys), width), -np.inf, dtype=np.float32)
    cand[owner[fits], col[fits]], sims[owner[fits], col[fits]] = other[fits], near[fits]
    few, many = np.flatnonzero(count <= room), np.flatnonzero(count > room)
    kept = np.full((len(ys), room), -1, dtype=np.int32)
    kept[few, : min(room, width)] = cand[few, :room]
    many = many[np.argsort(count[many], kind="stable")]  # most exceed their room by a few links only
    for k in range(0, len(many), 256):
        part = many[k : k + 256]
        wide = min(width, int(count[part].max()))
        kept[part] = _diverse(sims[part, :wide], cand[part, :wide], vectors, room)
    links[ys] = kept


def _dots(vectors: np.ndarray, places: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of each row of q with its vectors."""
    return np.matmul(vectors[places], q[:, :, None])[:, :, 0]


def _scaled(original: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors divided by their largest norm, in single precision, and that norm; norms beyond the range of doubles are taken in steps."""
    top = float(np.abs(original).max(initial=0.0)) or 1.0
    rows = original.astype(np.float64) / top
    norm = float(np.sqrt((rows**2).sum(axis=1).max(initial=0.0))) or 1.0
    return (rows / norm).astype(np.float32), norm


def _evened(original: np.ndarray) -> np.ndarray:
    """The scaled vectors with one more component, which gives all of them the norm 1."""
    rows = _scaled(original)[0]
    even = np.sqrt(np.maximum(1 - (rows.astype(np.float64) ** 2).sum(axis=1), 0))
    return np.hstack([rows, even[:, None].astype(np.float32)])


def _merged(ids: np.ndarray, original: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by distinct vector, where each vector's ids start, and the distinct vectors in order of their first row."""
    rows = np.ascontiguousarray(original + original.dtype.type(0))  # -0 becomes 0
    whole = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1])))[:, 0]
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    node = np.argsort(np.argsort(first))[which]
    return ids[np.lexsort((ids, node))], np.append(0, np.cumsum(np.bincount(node, minlength=len(first)))).astype(np.int64), rows[np.sort(first)]


@dataclass
class Graph:
    """A shard's graph as flat arrays."""

    ids: np.ndarray  # of all rows, node by node, ascending in each
    start: np.ndarray  # where a node's ids start, and the end
    original: np.ndarray  # as given, float32 or float64, one for each node
    vectors: np.ndarray  # scaled, with the component that evens the norms
    levels: list[tuple[np.ndarray, np.ndarray]]  # from the lowest: nodes (ascending), neighbours as places among them

    @classmethod
    def build(cls, ids: np.ndarray, original: np.ndarray, seed: int = 7) -> Graph:
        ids, start, original = _merged(ids, original)
        n, vectors = len(original), _evened(original)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int) if n else np.zeros(0, dtype=int)
        levels = []
        for k in range(int(level.max()) + 1 if n else 0):
            nodes = np.flatnonzero(level >= k)
            levels.append((nodes, np.full((len(nodes), LINKS * 2 if k == 0 else LINKS), -1, dtype=np.int32)))
        graph = cls(ids, start, original, vectors, levels)
        of_level = [vectors if k == 0 else vectors[nodes] for k, (nodes, _) in enumerate(levels)]
        lo = 0
        while lo < n:
            hi = min(n, lo + min(INSERT_BLOCK, max(32, lo // 4)))
            entry = np.full((hi - lo, 1), -1, dtype=np.int64)
            for k in range(len(levels) - 1, -1, -1):
                nodes, links = levels[k]
                begin, end = np.searchsorted(nodes, (lo, hi))
                entry = _down(nodes, begin, entry)
                found = np.full((hi - lo, 1), -1, dtype=np.int64)
                if begin:
                    found = _beam(vectors[lo:hi], of_level[k][:begin], links[:begin], entry, EF_BUILD if k == 0 else EF_UPPER)
                if end > begin:
                    _insert(of_level[k], links, int(begin), int(end), found[nodes[begin:end] - lo])
                entry = np.where(found >= 0, nodes[np.maximum(found, 0)], -1)
            lo = hi
        return graph

    @classmethod
    def read(cls, ids: bytes, original: bytes, dim: int, levels: list[dict], start: bytes | None = None, kind: type = np.float32) -> Graph:
        """From the columns of build_index(); without start, every node has one id."""
        at = np.frombuffer(ids, dtype=np.int64)
        given = np.frombuffer(original, dtype=kind).reshape(-1, dim)
        flat = [(nodes := np.frombuffer(x["nodes"], dtype=np.int64), np.frombuffer(x["links"], dtype=np.int32).reshape(len(nodes), -1)) for x in levels]
        return cls(at, np.arange(len(given) + 1) if start is None else np.frombuffer(start, dtype=np.int64), given, _evened(given), flat)

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Places (q, ef) of the nearest nodes found for each query, nearest first, -1 padded."""
        scaled = np.concatenate([_scaled(x[None, :])[0] for x in queries]) if len(queries) else np.zeros(queries.shape, dtype=np.float32)
        q = np.hstack([scaled, np.zeros((len(queries), 1), dtype=np.float32)])
        entry = np.full((len(q), 1), -1, dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            nodes, links = self.levels[k]
            found = _beam(q, self.vectors if k == 0 else self.vectors[nodes], links, _down(nodes, len(nodes), entry), ef if k == 0 else EF_UPPER)
            entry = np.where(found >= 0, nodes[np.maximum(found, 0)], -1)
        return entry


def _down(nodes: np.ndarray, size: int, entry: np.ndarray) -> np.ndarray:
    """Nodes of the shard as places among the first `size` nodes of a level; its first node, where there are none."""
    at = np.where(entry >= 0, np.searchsorted(nodes, np.maximum(entry, 0)), -1)
    if size:
        at[~(at >= 0).any(axis=1), 0] = 0
    return at


def _beam(q: np.ndarray, vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, ef: int) -> np.ndarray:
    """Best-first search with a beam of ef for all queries at once; entry: places, -1 for none."""
    n, rows = len(vectors), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), dtype=bool)  # the last column stands for no node
    ids = np.full((len(q), ef), n, dtype=np.int64)
    sims = np.full((len(q), ef), -np.inf, dtype=np.float32)
    done = np.ones((len(q), ef), dtype=bool)
    e = np.where(entry >= 0, entry, n)[:, :ef]
    s = _dots(vectors, np.minimum(e, n - 1), q)
    w = e.shape[1]
    ids[:, :w], sims[:, :w], done[:, :w] = e, np.where(e < n, s, -np.inf), e >= n
    seen[rows, e] = True
    links = np.where(links >= 0, links, n)
    active = np.arange(len(q))
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        best = open_sims.argmax(axis=1)
        going = ~done[active, best]
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        near = links[ids[active, best]]
        fresh = ~seen[active[:, None], near] & (near < n)
        seen[active[:, None], near] = True
        s = _dots(vectors, np.minimum(near, n - 1), q[active])
        s = np.where(fresh, s, -np.inf)
        all_s = np.concatenate([sims[active], s], axis=1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), top, axis=1)
        sims[active] = np.take_along_axis(all_s, top, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), top, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isneginf(sims), -1, ids)


def top_of_shard(graph: Graph, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec_id, score) of each query's best k found in a shard, without rows of its own id."""
    out_q, out_v, out_s = [], [], []
    by_id = np.sort(graph.ids)
    for lo in range(0, len(queries), QUERY_BLOCK):
        qs, qid = queries[lo : lo + QUERY_BLOCK], query_ids[lo : lo + QUERY_BLOCK]
        found = graph.search(qs, max(ef, k + 1))
        at = np.maximum(found, 0)
        exact = np.einsum("qed,qd->qe", graph.original[at].astype(np.float64), qs.astype(np.float64))
        r, c = np.nonzero(found >= 0)
        first, size = graph.start[found[r, c]], np.diff(graph.start)[found[r, c]]
        # A node's smallest ids, k besides the query's own.
        own = np.searchsorted(by_id, qid, "right") - np.searchsorted(by_id, qid, "left")
        take = np.minimum(size, k + own[r])
        place = np.repeat(first - (np.cumsum(take) - take), take) + np.arange(take.sum())
        row, ids, score = np.repeat(r, take), graph.ids[place], np.repeat(exact[r, c], take)
        other = ids != qid[row]
        row, ids, score = row[other], ids[other], score[other]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        out_q.append(qid[row[best]])
        out_v.append(ids[best])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<float> or array<double>), dim of the rows that take part."""
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding").cast("array<float>" if kind == T.ArrayType(T.FloatType(), kind.containsNull) else "array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where((F.size("v") > 0) & ~odd).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def dealt(rows: DataFrame, queries: DataFrame, shard_rows: int = SHARD_ROWS, k: int = 20) -> tuple[DataFrame, DataFrame, dict[int, routing.Routes]]:
    """Rows (dim, vec_id, v, times) and queries (vec_id, v, dim), both with shard, and the routes of the lengths that have several shards.

    Rows equal in id and vector are counted before they are dealt; more than k of them can't show in a result."""
    counted = rows.groupBy("dim", "vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    large = sorted(d for d, n in sizes.items() if n > shard_rows)
    one_shard = lambda df: df.where(~F.col("dim").isin(large)).withColumn("shard", F.lit(0).cast("long"))
    if not large:
        return one_shard(counted), one_shard(queries), {}
    counted, queries = materialize(counted, "counted"), materialize(queries, "queries")
    placed, asked, routes = one_shard(counted), one_shard(queries), {}
    for d in large:
        more, theirs, routes[d] = routing.deal(counted.where(F.col("dim") == d), queries.where(F.col("dim") == d), sizes[d], d, shard_rows, k)
        placed, asked = placed.unionByName(more), asked.unionByName(theirs)
    return placed, asked, routes


def build_index(placed: DataFrame) -> DataFrame:
    """Written graphs (dim, shard, ids, start, vectors, levels) of the rows of dealt()."""

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        times, v = table.column("times").to_numpy(), _rows(table.column("v"), dim)
        order = np.lexsort((table.column("vec_id").to_numpy(),))  # so that a shard that is built again is the same
        graph = Graph.build(np.repeat(table.column("vec_id").to_numpy()[order], times[order]), np.repeat(v[order], times[order], axis=0))
        levels = [{"nodes": nodes.astype(np.int64).tobytes(), "links": links.tobytes()} for nodes, links in graph.levels]
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                "ids": pa.array([graph.ids.tobytes()], pa.binary()),
                "start": pa.array([graph.start.tobytes()], pa.binary()),
                "vectors": pa.array([graph.original.tobytes()], pa.binary()),
                "levels": pa.array([levels], pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))),
            }
        )

    return materialize(placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, ids binary, start binary, vectors binary, levels array<struct<nodes:binary,links:binary>>"), "graphs")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest found among all other rows."""
    rows = valid_vectors(vectors)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    placed, visits, _ = dealt(rows, queries, shard_rows, k)
    graphs = build_index(placed)
    kind = np.float32 if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else np.float64
    # The fullest shard's queries make groups of about QUERY_GROUP, and a graph goes to as many groups as its shard has.
    visits = materialize(visits.withColumnRenamed("vec_id", "query_id"), "visits")
    groups = visits.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_GROUP).alias("groups"))
    asked = visits.join(F.broadcast(groups), ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("groups"))).drop("groups")
    built = graphs.join(F.broadcast(groups), ["dim", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")

    def search(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        q, v, s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if queries.num_rows and graphs.num_rows:
            dim = queries.column("dim")[0].as_py()
            graph = Graph.read(graphs.column("ids")[0].as_py(), graphs.column("vectors")[0].as_py(), dim, graphs.column("levels")[0].as_py(), graphs.column("start")[0].as_py(), kind)
            q, v, s = top_of_shard(graph, queries.column("query_id").to_numpy(), _rows(queries.column("v"), dim), k, ef)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["dim", "shard", "part"]
    found = asked.groupBy(*keys).cogroup(built.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
