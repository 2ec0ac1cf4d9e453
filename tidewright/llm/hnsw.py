"""Operator 7, approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards by hash. Each shard builds its own graph over its distinct vectors, so that copies don't take each other's
links, and a vector found stands for all rows that have it. The graph is kept as flat neighbour arrays (level 0: 2m links a node, higher levels: m), written once to a table in
the shared folder, a row for each shard. Every query walks the graph of every shard, and the shards' results are merged by exact distance. All walks of a
block advance together, so numpy works on whole blocks rather than single nodes. Every row is indexed.

Cases: vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; vectors are only
compared with vectors of their own length; ids that repeat keep one row (the smallest by components); ties go to the smaller id;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.blocks import best_per_query, blocks_of, pair_blocks, shard_of
from tidewright.llm.common import cut

SHARD_ROWS = 4096
GROUP_ROWS = 8192
SCHEMA = "query_id long, vec_id long, score double"
GRAPHS = "shard_ int, length int, ids binary, exact binary, which binary, nodes binary, size double, entry int, links array<binary>"
LINKS = 16
BUILD_WIDTH = 32
SEARCH_WIDTH = 128
STEP = 256
#: Components that are compared exactly at once.
EXACT_BLOCK = 1 << 22


def usable_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): one row for each id with a finite vector that is not zero."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False)))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def apart(points: np.ndarray, norms: np.ndarray, near: np.ndarray, q: np.ndarray, q_norm: np.ndarray) -> np.ndarray:
    """Squared distances from each query to its own list of nodes."""
    return np.maximum(norms[near] + q_norm[:, None] - 2 * np.einsum("abd,ad->ab", points[near], q, optimize=False), 0)


def walk(points, norms, links, q, q_norm, start, start_d, width, n_now) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries at once: (nodes, distances) of `width` nodes each, nearest first, -1 where fewer."""
    rows = len(q)
    nodes, dist = np.full((rows, width), -1, np.int32), np.full((rows, width), np.inf, np.float32)
    done = np.ones((rows, width), bool)
    nodes[:, : start.shape[1]], dist[:, : start.shape[1]], done[:, : start.shape[1]] = start, start_d, start < 0
    seen = np.zeros((rows, n_now + 1), bool)  # the last column stands for "no node"
    seen[:, n_now] = True
    seen[np.arange(rows)[:, None], np.where(start < 0, n_now, start)] = True
    live = np.arange(rows)
    while len(live):
        open_d = np.where(done[live], np.inf, dist[live])
        pick = open_d.argmin(1)
        going = np.isfinite(open_d[np.arange(len(live)), pick])
        live, pick = live[going], pick[going]
        if not len(live):
            break
        done[live, pick] = True
        near = links[nodes[live, pick]]
        near = np.where(near < 0, n_now, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = np.where(fresh, apart(points, norms, np.where(fresh, near, 0), q[live], q_norm[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(all_d, order, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(fresh, near, -1).astype(np.int32)], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), order, 1)
    nodes[~np.isfinite(dist)] = -1
    return nodes, dist


def choose(points, norms, near, near_d, m) -> np.ndarray:
    """For each row keep up to m of its nearest-first candidates, each nearer to the row's node than to any node kept before it; then fill up by distance."""
    rows, width = near.shape
    safe = np.where(near < 0, 0, near)
    p = points[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * (p @ p.transpose(0, 2, 1))
    blocked, kept, count = near < 0, np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for i in range(width):
        take = ~blocked[:, i] & (count < m)
        kept[take, i] = True
        count += take
        blocked |= take[:, None] & (between[:, i, :] < near_d)
    rank = np.where(kept, 0, np.where(near < 0, 2, 1)) * width + np.arange(width)
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    out = np.full((rows, m), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def nearest_first(points, norms, q, q_norm, near, size):
    """Sort candidate lists by distance, dropping repeats and -1; at most `size` stay."""
    near = np.sort(near, 1)
    near = np.where(np.c_[np.zeros(len(near), bool), near[:, 1:] == near[:, :-1]], -1, near)
    d = np.where(near < 0, np.inf, apart(points, norms, np.where(near < 0, 0, near), q, q_norm)).astype(np.float32)
    order = np.argsort(d, 1, kind="stable")[:, :size]
    return np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)


def descend(points, norms, levels, top, entry, q, q_norm, down_to, n_now):
    """From the entry node greedily through the levels above down_to."""
    at = np.full((len(q), 1), entry, np.int32)
    d = apart(points, norms, at, q, q_norm).astype(np.float32)
    for level in range(top, down_to, -1):
        at, d = walk(points, norms, levels[level], q, q_norm, at, d, 1, n_now)
    return at, d


def build(points: np.ndarray, heights: np.ndarray, m: int = LINKS, width: int = BUILD_WIDTH) -> tuple[list[np.ndarray], int]:
    """The flat neighbour arrays of each level and the entry node. heights: the top level of each node. Nodes go in by growing blocks."""
    n, norms = len(points), (points * points).sum(1)
    levels = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(heights.max()) + 1)]
    order = np.argsort(-heights, kind="stable")  # tall nodes first, so that every block meets all levels above its own
    entry, top, at = int(order[0]), int(heights[order[0]]), 1
    placed = [int(order[0])]
    while at < n:
        block = order[at : at + min(STEP, at, n - at)]
        block = block[heights[block] == heights[block[0]]]
        height, q, q_norm = int(heights[block[0]]), points[block], norms[block]
        near, near_d = descend(points, norms, levels, top, entry, q, q_norm, height, n)
        for level in range(height, -1, -1):
            near, near_d = walk(points, norms, levels[level], q, q_norm, near, near_d, width, n)
            mates = np.broadcast_to(block, (len(block), len(block))).copy()
            np.fill_diagonal(mates, -1)
            all_near, all_d = nearest_first(points, norms, q, q_norm, np.concatenate([near, mates], 1), width)
            mine, room = choose(points, norms, all_near, all_d, m), levels[level].shape[1]
            levels[level][block, :m] = mine
            back_to, back_from = mine[mine >= 0], np.repeat(block, (mine >= 0).sum(1))
            by = np.argsort(back_to, kind="stable")
            back_to, back_from = back_to[by], back_from[by]
            nodes, first, counts = np.unique(back_to, return_index=True, return_counts=True)
            extra = np.full((len(nodes), counts.max() if len(counts) else 0), -1, np.int32)
            extra[np.repeat(np.arange(len(nodes)), counts), np.arange(len(back_to)) - np.repeat(first, counts)] = back_from
            joint, joint_d = nearest_first(points, norms, points[nodes], norms[nodes], np.concatenate([levels[level][nodes], extra], 1), room + extra.shape[1])
            full = (joint >= 0).sum(1) > room
            levels[level][nodes[~full]] = joint[~full, :room]
            if full.any():
                levels[level][nodes[full]] = choose(points, norms, joint[full], joint_d[full], room)
        placed.extend(block.tolist())
        at += len(block)
    return levels, entry


def heights_of(ids: np.ndarray, m: int = LINKS) -> np.ndarray:
    """Geometric levels drawn from a hash of the id, so that a retried task builds the same graph."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.minimum(-np.log((h >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18) / np.log(m), 8).astype(np.int64)


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct vector, in row order, and each row's place among them."""
    _, first, which = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True)  # -0.0 is 0.0
    order = np.argsort(first)
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    return first[order], place[which.reshape(-1)]


def fewest(x: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows, sorted by id, can be among the k results of a query: of one vector the first k and one for the query's own row."""
    which = numbered(x)[1]
    by = np.argsort(which, kind="stable")
    nth = np.empty(len(x), np.int64)
    nth[by] = np.arange(len(x)) - np.searchsorted(which[by], which[by])
    return nth <= k


def graphs_with(k: int, m: int, width: int):
    """One row for each vector length of a shard: its vectors and the flat arrays of its graph."""

    def graph(shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, rows in shard.groupby(shard["x"].map(len)):
            rows = rows.sort_values("id", ignore_index=True)
            exact = np.stack(rows["x"].to_numpy())
            stay = fewest(exact, k)
            exact, ids = exact[stay], rows["id"].to_numpy()[stay]
            size = float(np.abs(exact).max())  # distances are kept comparable in 32 bits by scaling the shard to unit size
            points = (exact / size).astype(np.float32)
            nodes, which = numbered(points)  # a node of the graph is a vector in 32 bits
            levels, entry = build(points[nodes], heights_of(ids[nodes], m), m, width)
            arrays = [ids.astype("<i8"), exact.astype("<f8"), which.astype("<i4"), nodes.astype("<i4")]
            out.append((shard["shard_"].iloc[0], length, *(x.tobytes() for x in arrays), size, entry, [x.astype("<i4").tobytes() for x in levels]))
        return pd.DataFrame(out, columns=["shard_", "length", "ids", "exact", "which", "nodes", "size", "entry", "links"])

    return graph


def search_with(k: int, m: int, search_width: int):
    def one_length(graph, asked: pd.DataFrame) -> pd.DataFrame:
        ids, exact = np.frombuffer(graph.ids, "<i8"), np.frombuffer(graph.exact, "<f8").reshape(-1, graph.length)
        which, nodes = np.frombuffer(graph.which, "<i4"), np.frombuffer(graph.nodes, "<i4")
        levels = [np.frombuffer(x, "<i4").reshape(len(nodes), -1) for x in graph.links]
        asked_exact, asked_ids = np.stack(asked["x"].to_numpy()), asked["id"].to_numpy()
        with np.errstate(over="ignore"):  # a query far beyond the shard's size is as far from all of it
            asked_points = np.clip(asked_exact / graph.size, -1e15, 1e15).astype(np.float32)
        points = (exact[nodes] / graph.size).astype(np.float32)
        norms, rows, counts = (points * points).sum(1), np.argsort(which, kind="stable"), np.bincount(which)
        starts = np.cumsum(counts) - counts
        out = []
        for lo in range(0, len(asked), STEP):
            q = asked_points[lo : lo + STEP]
            q_norm = (q * q).sum(1)
            at, d = descend(points, norms, levels, len(levels) - 1, graph.entry, q, q_norm, 0, len(nodes))
            near, _ = walk(points, norms, levels[0], q, q_norm, at, d, max(search_width, k + 1), len(nodes))
            row, col = np.nonzero(near >= 0)
            near, who = near[row, col], row + lo
            many = counts[near]
            near = rows[np.repeat(starts[near], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            who = np.repeat(who, many)
            other = ids[near] != asked_ids[who]
            near, who = near[other], who[other]
            step = max(1, EXACT_BLOCK // exact.shape[1])
            score = np.concatenate([np.empty(0), *(np.sqrt(((exact[near[i : i + step]] - asked_exact[who[i : i + step]]) ** 2).sum(1)) for i in range(0, len(near), step))])
            order = np.lexsort((ids[near], score, who))
            near, who, score = near[order], who[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            out.append(pd.DataFrame({"query_id": asked_ids[who], "vec_id": ids[near], "score": score})[place < k])
        return pd.concat(out)

    def search(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        by_length = dict(list(asked.groupby(asked["x"].map(len)))) if len(asked) else {}
        for graph in graphs.itertuples():
            if graph.length in by_length:
                out.append(one_length(graph, by_length[graph.length].reset_index(drop=True)))
        return pd.concat(out, ignore_index=True)

    return search


def graphs(candidates: DataFrame, k: int, m: int = LINKS, build_width: int = BUILD_WIDTH, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The graphs of all shards as a table in the shared folder, each built once, and the number of shards. k: neighbours that a query may ask for."""
    n_shards = blocks_of(candidates.count(), shard_rows)
    dealt = candidates.withColumn("shard_", shard_of("id", n_shards)).repartition(n_shards, "shard_")
    return cut(dealt.groupBy("shard_").applyInPandas(graphs_with(k, m, build_width), GRAPHS), "graphs"), n_shards


def nearest_neighbours(queries: DataFrame, candidates: DataFrame, k: int, m: int = LINKS, build_width: int = BUILD_WIDTH, search_width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): k near candidates of each query with their Euclidean distances, the row of the query's own id left out.

    queries and candidates hold id and x, each id once, vectors finite."""
    built, n_shards = graphs(candidates, k, m, build_width, shard_rows)
    n_groups = blocks_of(queries.count(), group_rows)
    found = pair_blocks(queries, built, "id", n_shards, n_groups, search_with(k, m, search_width), SCHEMA)
    return best_per_query(found, k, F.col("score").asc())
