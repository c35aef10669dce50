"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, searched by beams.

Method: rows are dealt to shards of about `SHARD_ROWS` by a hash of id and vector. In each shard the vectors of
distinct direction are the nodes. Nodes are added in growing batches: a greedy search from the entry (the node nearest
the mean) proposes neighbours, all nodes that it came by among them; robust pruning keeps the nearest candidate and
drops those that are nearer to it, by the factor `ALPHA`, than to the node, so that the edges kept are diverse; an edge's
far end gets the edge back, and is pruned if it has too many. Nodes that no path reaches become entries too, so every
row can be found. A query's beam search walks each shard's graph, its best are scored exactly, in double precision on
the original vectors, and the nearest of all shards are taken.

Scale: every row is indexed, nothing is sampled. A shard is one row of the index (vectors, edges, rows of each node), some
`SHARD_ROWS` times 4 bytes a component and `DEGREE` edges, and is built by one task from its rows alone, so a lost task
costs one shard. Queries come in blocks of `BLOCK` rows; at most `BLOCKS` blocks (a bound in bytes: 16 MB a 64 components)
are sent to the tasks at once, and the index, written once, is read again for the next ones. The work grows with queries
times shards, as each shard is asked; bigger shards make it less.

Vectors that are null or zero or hold a null, NaN or infinity take no part, as rows or as queries; neither do rows of a
null id. A row that is repeated counts once; of an id's different vectors the nearest counts, and the least is the
query's. Vectors of other lengths are no candidates of a query. Ties go to the smaller id. Fewer than k candidates give
fewer rows; empty tables none. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.llm.common import col, cut, shared_path

SHARD_ROWS, BLOCK, BLOCKS = 8192, 4096, 16
#: Edges of a node at most, nodes that a search keeps, edges followed at once, how much diversity of edges counts.
DEGREE, BEAM, WIDTH, ALPHA = 28, 56, 4, 1.2
INDEX = "shard int, dim int, vectors binary, edges binary, entries binary, node_of binary, ids binary, originals binary"


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with that of `b`, in double precision; the sums' order depends on the length alone."""
    a, b = np.ascontiguousarray(a, np.float64), np.ascontiguousarray(b, np.float64)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def beams(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, size: int, path: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches of all rows of `q` side by side: the `size` nearest nodes found, nearest first (-1: none), and those expanded.

    `edges`: node by place, -1 for none.
    """
    n, size = len(q), max(size, len(entries))
    ids = np.full((n, size), -1, np.int64)
    near = np.full((n, size), -np.inf, np.float32)
    done = np.ones((n, size), bool)
    k = len(entries)
    ids[:, :k], near[:, :k], done[:, :k] = entries, q @ x[entries].T, False
    seen, active = [], np.arange(n)
    while len(active):
        open_near = np.where(done[active], -np.inf, near[active])
        at = np.argpartition(-open_near, WIDTH - 1, axis=1)[:, :WIDTH] if size > WIDTH else np.tile(np.arange(size), (len(active), 1))
        some = np.take_along_axis(open_near, at, 1) > -np.inf
        go = some.any(axis=1)
        active, at, some = active[go], at[go], some[go]
        if not len(active):
            break
        rows = active[:, None]
        chosen = np.where(some, ids[rows, at], -1)
        done[rows, at] = True
        if path:
            full = np.full((n, WIDTH), -1, np.int64)
            full[active, : chosen.shape[1]] = chosen
            seen.append(full)
        new = np.where((chosen >= 0)[:, :, None], edges[chosen], -1).reshape(len(active), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        held = np.sort(ids[active], axis=1)
        # of each row: whether a new node is held; both sorted, told apart by row
        span = len(x) + 2
        flat = (held + 1 + np.arange(len(active))[:, None] * span).reshape(-1)
        want = (new + 1 + np.arange(len(active))[:, None] * span).reshape(-1)
        place = np.minimum(np.searchsorted(flat, want), len(flat) - 1)
        fresh = (new >= 0) & (flat[place] != want).reshape(new.shape)
        r, c = np.nonzero(fresh)
        score = np.full(new.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("ij,ij->i", x[new[r, c]], q[active[r]])
        all_near = np.concatenate([near[active], score], axis=1)
        top = np.argpartition(-all_near, size - 1, axis=1)[:, :size]
        near[active] = np.take_along_axis(all_near, top, 1)
        ids[active] = np.where(near[active] > -np.inf, np.take_along_axis(np.concatenate([ids[active], new], axis=1), top, 1), -1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(new.shape, bool)], axis=1), top, 1) | (ids[active] < 0)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.concatenate(seen, axis=1) if seen else np.empty((n, 0), np.int64)


def pruned(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: of each node's candidates (-1: none) the nearest, then the nearest that none taken is nearer to by `alpha`."""
    out = np.full((len(nodes), degree), -1, np.int64)
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    candidates = -np.sort(-candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    width = candidates.shape[1]
    step = max(1, 4_000_000 // (width * width + width * x.shape[1]))
    for a in range(0, len(nodes), step):
        c = candidates[a : a + step]
        v = x[np.maximum(c, 0)]
        away = np.where(c >= 0, 2 - 2 * np.einsum("bcd,bd->bc", v, x[nodes[a : a + step]]), np.inf)
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        row = np.arange(len(c))
        for k in range(degree):
            best = away.argmin(axis=1)
            ok = away[row, best] < np.inf
            if not ok.any():
                break
            out[a : a + step, k] = np.where(ok, c[row, best], -1)
            drop = alpha * alpha * between[row, best] <= away
            drop[row, best] = True
            away[drop & ok[:, None]] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node by place, -1 for none) and entries of the graph over the unit vectors `x`."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    entries = np.array([int((x @ x.mean(axis=0)).argmax())])
    order = np.random.default_rng(7).permutation(n)
    order = np.r_[entries, order[order != entries[0]]]
    start = 1
    while start < n:
        batch = order[start : min(n, start + min(max(1, start), 512))]
        found, path = beams(x, edges, entries, x[batch], beam, path=True)
        edges[batch] = pruned(x, batch, np.concatenate([found, path, edges[batch]], axis=1), degree, alpha)
        to, back = edges[batch].reshape(-1), np.repeat(batch, degree)
        to, back = to[to >= 0], back[to >= 0]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        ends, first, many = np.unique(to, return_index=True, return_counts=True)
        for low, high in ((0, degree), (degree, 4 * degree), (4 * degree, n + 1)):  # alike in width, so that rows can be of one
            some = np.flatnonzero((many > low) & (many <= high))
            if not len(some):
                continue
            place = np.arange(many[some].max())
            new = np.where(place < many[some][:, None], back[np.minimum(first[some][:, None] + place, len(back) - 1)], -1)
            old = edges[ends[some]]
            both = np.concatenate([old, new], axis=1)
            fits = (both >= 0).sum(axis=1) <= degree
            edges[ends[some[fits]]] = -np.sort(-both[fits], axis=1)[:, :degree]
            if (~fits).any():
                edges[ends[some[~fits]]] = pruned(x, ends[some[~fits]], both[~fits], degree, alpha)
        start += len(batch)
    return edges, _reaching(edges, entries)


def _reaching(edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """`entries` and, as long as there are nodes that no path from them reaches, the first of those."""
    reached, front, entries = np.zeros(len(edges), bool), entries, list(entries)
    while True:
        reached[front] = True
        while len(front):
            front = np.unique(edges[front])
            front = front[(front >= 0) & ~reached[np.maximum(front, 0)]]
            reached[front] = True
        if reached.all():
            return np.array(entries)
        front = np.flatnonzero(~reached)[:1]
        entries.append(int(front[0]))


def _usable(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda v: v != 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, each once."""
    v = F.transform(col(embedding), lambda x: x.cast("double"))
    return rows.select(col(vec_id).alias("vec_id"), v.alias("embedding")).filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).dropDuplicates()


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all `rows` (vec_id long, embedding), one row a shard and length of vectors, written to the shared folder."""
    rows = usable(rows).withColumn("dim", F.size("embedding"))
    shards = max(1, round(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")  # the same graph whenever the task is run
        originals = np.stack(pdf["embedding"].to_numpy())
        order = np.lexsort(originals.T)
        originals, ids = originals[order], pdf["vec_id"].to_numpy(np.int64)[order]
        x, node_of = np.unique(_unit(originals), axis=0, return_inverse=True)
        edges, entries = build(x)
        one = {"shard": pdf["shard"].iloc[0], "dim": x.shape[1], "vectors": x, "edges": edges.astype(np.int32), "entries": entries.astype(np.int32), "node_of": node_of.reshape(-1).astype(np.int32), "ids": ids, "originals": originals}
        return pd.DataFrame([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in one.items()}])

    return cut(dealt.groupBy("shard", "dim").applyInPandas(built, INDEX))


def _blocks(queries: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Rows of up to about `block` queries each: block, dim, ids and vectors; and how many blocks there are."""
    n = max(1, round(queries.count() / block))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["embedding"].to_numpy())
        return pd.DataFrame([{"block": pdf["block"].iloc[0], "q_dim": x.shape[1], "q_ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "q_vectors": x.tobytes()}])

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("dim", F.size("embedding"))
    return cut(dealt.groupBy("block", "dim").applyInPandas(packed, "block int, q_dim int, q_ids binary, q_vectors binary")), n


def _searched(k: int, beam: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                x = np.frombuffer(r.vectors, np.float32).reshape(-1, r.dim)
                edges = np.frombuffer(r.edges, np.int32).reshape(len(x), -1).astype(np.int64)
                entries, node_of, ids = (np.frombuffer(b, t).astype(np.int64) for b, t in ((r.entries, np.int32), (r.node_of, np.int32), (r.ids, np.int64)))
                originals = np.frombuffer(r.originals, np.float64).reshape(-1, r.dim)
                q_ids, q = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_vectors, np.float64).reshape(-1, r.dim)
                members = np.argsort(node_of, kind="stable")
                ends = np.cumsum(np.bincount(node_of, minlength=len(x)))
                begins = ends - np.bincount(node_of, minlength=len(x))
                found, _ = beams(x, edges, entries, _unit(q), beam)
                for a in range(0, len(q), 256):
                    nodes = found[a : a + 256]
                    who, place = np.nonzero(nodes >= 0)
                    node = nodes[who, place]
                    many = ends[node] - begins[node]
                    row = np.repeat(who, many) + a
                    at = members[np.repeat(begins[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    other = q_ids[row] != ids[at]
                    row, at = row[other], at[other]
                    score = np.concatenate([cosines(q[row[i : i + 65_536]], originals[at[i : i + 65_536]]) for i in range(0, len(row), 65_536)] or [np.empty(0)])
                    hits = pd.DataFrame({"query_id": q_ids[row], "vec_id": ids[at], "score": score}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                    yield hits.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = 2 * BEAM, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the k nearest found of each of `queries` (vec_id, embedding), without rows of its own id."""
    queries = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    packed, n = _blocks(queries, block)
    found = "query_id long, vec_id long, score double"

    def part(some: DataFrame) -> DataFrame:
        pairs = index.join(F.broadcast(some), F.col("dim") == F.col("q_dim")).drop("shard", "block", "q_dim")
        return pairs.mapInPandas(_searched(k, beam), found)

    spark = index.sparkSession
    if n <= blocks:
        hits = part(packed)
    else:
        path = shared_path(spark, f"nearest-{uuid.uuid4().hex}")
        for a in range(0, n, blocks):
            part(packed.filter((F.col("block") >= a) & (F.col("block") < a + blocks))).write.mode("append").parquet(path)
        hits = spark.read.parquet(path)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", **options) -> DataFrame:
    """`search` for `queries` (of the same columns) over an index of all `rows`."""
    named = lambda df: df.select(col(vec_id).alias("vec_id"), col(embedding).alias("embedding"))
    return search(index(named(rows), **options), named(queries), k)
