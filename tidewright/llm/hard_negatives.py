"""Operator 12, hard-negative mining by vantage-point trees over norm-augmented vectors.

Rows are vectors of whole numbers with a label; a score is the inner product with the anchor. Within a shard each vector x gets one more
component, sqrt(M^2 - |x|^2) with M the shard's largest norm, and an anchor q gets 0 there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x: the higher the
score, the nearer the row, and a window of scores is an annulus of distances around the anchor.

Rows are dealt into shards by hash. Each shard's tree is built once and written to a table: at every node the rows are halved by their distance
from a vantage row, and each half keeps its least and largest distance. For a block of anchors the bounds of all nodes come from the distances
to the vantage rows, from the root down; each anchor then takes the leaves that meet its annulus nearest first, in steps of one, two, four and so on,
and stops when the next leaf is farther than the k-th row found. Leaves without a fitting label are passed over. Bounds only choose leaves:
scores are compared as whole numbers, so results are exact. The shards' results are merged.

Anchors first get their positives, the best rows of the same label, and then for each positive the best rows of other labels whose scores lie in
the positive's window.

Cases: rows with a null id, label or vector, or with components that are null or not finite, as they are or scaled, take no part; ids that
repeat keep one row (the smallest by label, then components); vectors of unlike lengths are compared as if zeros followed; a window of a negative positive
score holds nothing; scores beyond 2^62 count as that; ties go to the smaller id; an anchor without rows of its label, or a positive without
rows in its window, gives no rows; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.blocks import blocks_of, pair_blocks, shard_of
from tidewright.llm.common import cut

SHARD_ROWS = 8192
GROUP_ROWS = 32768
LEAF_ROWS = 64
#: Anchors whose bounds are held at once.
STEP = 256
MOST = 1 << 62
#: Part of the sizes compared that a distance can be wrong by.
SLACK = 1e-7
TREES = "shard_ int, width int, kind string, unit double, ids binary, labels binary, rows binary, cuts binary, vantage binary, least binary, largest binary"
FOUND = "anchor_id long, positive_id long, vec_id long, positive_score long, score long"


def labelled_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, w) with w = floor(scale * x) of each component, as doubles: one row for each id that takes part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double") * scale)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
    w = F.transform("x", lambda v: F.when(F.abs(v) < 2**53, F.floor(v).cast("double")).otherwise(v))  # from there on a double is whole
    return rows.select("id", "label", w.alias("w")).groupBy("id").agg(F.min(F.struct("label", "w")).alias("r")).select("id", "r.label", "r.w")


def matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def width_of(column: pd.Series) -> int:
    return max((len(x) for x in column), default=0)


class Tree:
    """A shard's rows in the order of its leaves. Node i has the children 2i + 1 and 2i + 2; the last level's nodes are the leaves."""

    def __init__(self, ids, labels, rows, cuts, vantage, least, largest, unit) -> None:
        self.ids, self.labels, self.rows, self.cuts, self.vantage, self.least, self.largest, self.unit = ids, labels, rows, cuts, vantage, least, largest, unit
        self.n_leaves, self.most = len(cuts) - 1, float(np.abs(rows).max(initial=0.0))
        self.scaled = rows / unit
        squares = (self.scaled**2).sum(1)
        self.norm = float(np.sqrt(squares.max(initial=0.0)))
        kinds, code = np.unique(labels, return_inverse=True)
        self.kinds = {int(x): i for i, x in enumerate(kinds)}
        self.has = np.zeros((self.n_leaves, len(kinds)), bool)
        self.has[np.repeat(np.arange(self.n_leaves), np.diff(cuts)), code] = True

    @staticmethod
    def built(frame: pd.DataFrame, leaf_rows: int = LEAF_ROWS) -> Tree:
        frame = frame.sort_values("id", ignore_index=True)
        rows = matrix(frame["w"], width_of(frame["w"]))
        unit = max(1.0, float(np.abs(rows).max(initial=0.0)))
        scaled = rows / unit
        squares = (scaled**2).sum(1)
        points = np.column_stack([scaled, np.sqrt(squares.max(initial=0.0) - squares)])
        depth = max(0, (-(-len(rows) // leaf_rows) - 1).bit_length())
        order, spans = np.arange(len(rows)), [(0, len(rows))]
        vantage, least, largest = np.zeros(2**depth - 1, np.int64), np.zeros(2 ** (depth + 1) - 1), np.full(2 ** (depth + 1) - 1, np.inf)
        for level in range(depth):
            below = []
            for i, (lo, hi) in enumerate(spans):
                node, own = 2**level - 1 + i, order[lo:hi]
                # a row far from another splits the rest better than one in their midst
                far = own[np.argmax(((points[own] - points[own[0]]) ** 2).sum(1))] if len(own) else 0
                d = np.sqrt(((points[own] - points[far]) ** 2).sum(1))
                by = np.argsort(d, kind="stable")
                order[lo:hi], mid = own[by], (lo + hi) // 2
                vantage[node] = far
                for child, part in ((2 * node + 1, d[by][: mid - lo]), (2 * node + 2, d[by][mid - lo :])):
                    least[child], largest[child] = (part[0], part[-1]) if len(part) else (np.inf, -np.inf)
                below += [(lo, mid), (mid, hi)]
            spans = below
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        cuts = np.array([lo for lo, _ in spans] + [len(rows)])
        return Tree(frame["id"].to_numpy(np.int64)[order], frame["label"].to_numpy(np.int64)[order], rows[order], cuts, place[vantage], least, largest, unit)

    def stored(self, shard: int) -> dict:
        kind = "<i2" if self.most < 2**15 else "<i4" if self.most < 2**31 else "<f8"
        arrays = {"ids": self.ids, "labels": self.labels, "rows": self.rows.astype(kind), "cuts": self.cuts, "vantage": self.vantage, "least": self.least, "largest": self.largest}
        return {"shard_": shard, "width": self.rows.shape[1], "kind": kind, "unit": self.unit} | {k: v.tobytes() for k, v in arrays.items()}

    @staticmethod
    def read(row) -> Tree:
        ids, labels, cuts, vantage = (np.frombuffer(x, np.int64) for x in (row.ids, row.labels, row.cuts, row.vantage))
        rows = np.frombuffer(row.rows, row.kind).reshape(len(ids), row.width).astype(np.float64)
        return Tree(ids, labels, rows, cuts, vantage, np.frombuffer(row.least), np.frombuffer(row.largest), row.unit)

    def bounds(self, asked: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor and leaf the least and the largest distance that a row can have; and each anchor's |q|^2 + M^2. All in the given unit."""
        grow = self.unit / unit
        q = asked / unit
        base = (q**2).sum(1) + (self.norm * grow) ** 2
        to = np.sqrt(np.maximum(0.0, base[:, None] - 2 * grow * (q @ self.scaled[self.vantage].T))) if len(self.vantage) else np.empty((len(q), 0))
        slack = SLACK * (np.sqrt(base) + 1e-300)[:, None]
        low, high = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        node = 0
        while node < len(self.vantage):
            n = low.shape[1]
            below = slice(2 * node + 1, 2 * node + 1 + 2 * n)
            d = np.repeat(to[:, node : node + n], 2, axis=1)
            least, largest = self.least[below] * grow, self.largest[below] * grow
            low = np.maximum(np.repeat(low, 2, axis=1), np.maximum(least - d, d - largest) - slack)
            high = np.minimum(np.repeat(high, 2, axis=1), d + largest + slack)
            node += n
        return low, high, base

    def scores(self, places: np.ndarray, asked: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.rows[places] @ asked).astype(np.int64)
        q = [int(x) for x in asked]
        return np.array([max(-MOST, min(MOST, sum(a * int(b) for a, b in zip(q, row, strict=True)))) for row in self.rows[places].tolist()], np.int64)


class Asker:
    """One anchor at one tree: its windows share the leaves' scores."""

    def __init__(self, tree: Tree, anchor: int, label: int, asked: np.ndarray, low: np.ndarray, high: np.ndarray, base: float, unit: float) -> None:
        self.tree, self.anchor, self.label, self.asked, self.low, self.high, self.base, self.unit = tree, anchor, label, asked, low, high, base, unit
        # whole numbers below 2^53 add up exactly in doubles
        self.exact = tree.most * float(np.abs(asked).max(initial=0.0)) * max(1, len(asked)) < 2**53
        self.slack, self.known, self.visited = SLACK * np.sqrt(base), {}, 0

    def distance(self, score: int) -> float:
        return float(np.sqrt(max(0.0, self.base - 2 * (score / self.unit / self.unit))))

    def leaf(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.known:
            places = np.arange(self.tree.cuts[i], self.tree.cuts[i + 1])
            self.known[i] = places, self.tree.scores(places, self.asked, self.exact)
            self.visited += len(places)
        return self.known[i]

    def best(self, k: int, same: bool, least: int = -MOST, most: int = MOST) -> list[tuple[int, int]]:
        """(id, score) of the k best rows with the anchor's label, or with any other, with least <= score <= most."""
        tree, code = self.tree, self.tree.kinds.get(self.label)
        of_label = tree.has[:, code] if code is not None else np.zeros(tree.n_leaves, bool)
        fit = of_label if same else tree.has.any(1) & ~(of_label & (tree.has.sum(1) == 1))
        if least > -MOST:
            fit = fit & (self.low <= self.distance(least) + self.slack)
        if most < MOST:
            fit = fit & (self.high >= self.distance(most) - self.slack)
        leaves = np.flatnonzero(fit)
        leaves = leaves[np.argsort(self.low[leaves], kind="stable")]
        ids, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 1
        while at < len(leaves) and not (len(ids) == k and self.low[leaves[at]] > self.distance(int(scores[-1])) + self.slack):
            places, found = (np.concatenate(x) for x in zip(*(self.leaf(i) for i in leaves[at : at + step]), strict=True))
            of = tree.labels[places] == self.label
            keep = (of if same else ~of) & (found >= least) & (found <= most) & (tree.ids[places] != self.anchor)
            ids, scores = np.concatenate([ids, tree.ids[places[keep]]]), np.concatenate([scores, found[keep]])
            order = np.lexsort((ids, -scores))[:k]
            ids, scores, at, step = ids[order], scores[order], at + step, 2 * step
        return list(zip(ids.tolist(), scores.tolist(), strict=True))


def askers(tree: Tree, asked: pd.DataFrame):
    """(row, asker) of each anchor."""
    width = max(tree.rows.shape[1], width_of(asked["w"]))
    if width > tree.rows.shape[1]:
        tree.rows, tree.scaled = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (tree.rows, tree.scaled))
    for lo in range(0, len(asked), STEP):
        part = asked.iloc[lo : lo + STEP]
        q = matrix(part["w"], width)
        unit = max(tree.unit, float(np.abs(q).max(initial=0.0)))
        low, high, base = tree.bounds(q, unit)
        for i, row in enumerate(part.itertuples(index=False)):
            yield row, Asker(tree, row.id, row.label, q[i], low[i], high[i], float(base[i]), unit)


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["anchor_id", "positive_id", "vec_id", "positive_score", "score"], dtype=np.int64)


def positives_with(k: int):
    def search(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(asked):
            return frame_of([])
        return frame_of([(row.id, x, x, s, s) for row, asker in askers(Tree.read(trees.iloc[0]), asked) for x, s in asker.best(k, True)])

    return search


def negatives_with(k: int, low: int, high: int):
    def search(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(asked):
            return frame_of([])
        out = []
        for row, asker in askers(Tree.read(trees.iloc[0]), asked):
            for positive, own in zip(row.positives.tolist(), row.scores.tolist(), strict=True):
                out += [(row.id, positive, x, own, s) for x, s in asker.best(k, False, -(-low * own // 100), high * own // 100)]
        return frame_of(out)

    return search


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and positive of all shards, with their rank. Spark ranks within each task before the shuffle."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())))
    return ranked.where(F.col("rank") <= k)


def trees_of(rows: DataFrame, n_shards: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([Tree.built(frame, leaf_rows).stored(int(key[0]))])

    return rows.withColumn("shard_", shard_of("id", n_shards)).repartition(n_shards, "shard_").groupBy("shard_").applyInPandas(build, TREES)


def mine(
    rows: DataFrame, anchors: DataFrame, n_positives: int, k: int, low: int, high: int,
    shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). rows and anchors: id, label, w, each id once. low and high: the window of
    negative scores in percent of the positive's."""
    n_shards, n_groups = blocks_of(rows.count(), shard_rows), blocks_of(anchors.count(), group_rows)
    trees = cut(trees_of(rows, n_shards, leaf_rows), "trees")
    found = pair_blocks(anchors, trees, "id", n_shards, n_groups, positives_with(n_positives), FOUND)
    # one list for each anchor, so ranks are of all its positives together
    positives = first(found.withColumn("positive_id", F.lit(None).cast("long")), n_positives).select("anchor_id", "vec_id", "score")
    lists = positives.groupBy("anchor_id").agg(F.collect_list("vec_id").alias("positives"), F.collect_list("score").alias("scores"))
    asked = cut(anchors.join(lists, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "asked")
    negatives = first(pair_blocks(asked, trees, "id", n_shards, n_groups, negatives_with(k, low, high), FOUND), k)
    return negatives.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
