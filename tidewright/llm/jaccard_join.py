"""Operator 9, n-gram Jaccard join with a count-vector R-tree.

Documents of one shingle set form a class, and classes are joined. Two sets of similarity 0.75 share a shingle among the rarest
quarter of each, so classes are first brought together by those; the order of rarity comes from a sketch of fixed size over all
documents. A pair of which the smaller brings such a shingle from its rarest seventh is enough, so a bucket loses the classes that have no partner
of fitting size in that way. Within a bucket, the classes are points: each shingle hashes to a group, and a point counts the shingles of each
group. An R-tree over the points bounds the overlap of a query with everything below a node by the summed minima of its counts and
the node's largest counts; what it finds is bounded once more with 256 times as many groups, in which a point is kept as the gaps
between its occupied groups, about a byte for each shingle. What survives is verified on the whole sets.

A bucket of thousands of near copies would give millions of links. So the first round verifies each bucket's least class against
the others only. What is then still in several components goes through rounds in which each class outside a bucket's largest
component brings its candidates in order of their bound, few at first and FACTOR times as many in each round, and leaves out those that are
connected by then: every pair is either verified, bounded away or connected, and a group of near copies gives rows in proportion to
its size. Rounds end when no bucket has a candidate left. Buckets beyond BLOCK classes are dealt into blocks and searched block by block.

Shingles are compared as 64-bit hashes. A class is named by 64 bits of its set's 128-bit digest; names that two sets share are looked
for among all classes, and those classes are named by the other half.

Cases: null and empty texts and texts without words have an empty set and stay alone; fewer than five words form one shingle; a null
id is a document like others, a component takes the smallest id that is not null; ids that repeat are documents of their own, but
share the least id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import cut, held, small_batches
from tidewright.llm.components import components
from tidewright.llm.shingles import WordHashes, set_digest, shingle_set

#: Similarity NUM / DEN.
NUM, DEN = 3, 4
#: Most classes of a bucket in one block, and points in a leaf of the R-tree.
BLOCK, LEAF = 4096, 16
#: Counters of the rarity sketch: four for each document within these bounds, so at most 64 MB in a task and 16 MB as broadcast.
SKETCH_LEAST, SKETCH_MOST, SKETCH_CHUNK = 1 << 16, 1 << 24, 1 << 14
#: Candidates that a class brings in the first round of a bucket, and how many times more in each later one.
CANDIDATES, FACTOR = 4, 32
#: Pairs a task holds before it hands them on, and counts it compares at once.
HELD, COMPARED = 50_000, 1 << 21
#: Groups of the tables of pairs that are bounded at once.
TABLES = 1 << 20
#: Class ids up to which a filter of them is broadcast (16 MB); beyond, it is a shuffled join.
BROADCAST_IDS = 2_000_000
FIRST = "doc_id long, pick long, n_shingles long, cls long, other long, points binary, part int, chunk int, counts binary"


# -- points ----------------------------------------------------------------------------------------------------------------------


def fine_bits(n: int) -> int:
    """Groups of a set of n shingles: 64 to 128 for each, a power of two."""
    return (64 * n - 1).bit_length()


def coarse_bits(n: int) -> int:
    """Groups of its point in the R-tree: more than n / 4, and 64 at least."""
    return max(6, (n // 4).bit_length())


def point(shingles: np.ndarray) -> bytes:
    """The groups of a sorted set as gaps, a byte each; 255 adds as much to the next gap."""
    groups = (shingles >> np.uint64(64 - fine_bits(len(shingles)))).astype(np.int64)
    gaps = groups.copy()
    gaps[1:] -= groups[:-1]
    far = gaps // 255
    before = np.cumsum(far)
    out = np.full(len(groups) + int(before[-1]), 255, np.uint8)
    out[np.arange(len(groups)) + before] = gaps - far * 255
    return out.tobytes()


def groups_of(points: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all points one after the other, and where each one's begin, with the end."""
    gaps = np.frombuffer(b"".join(points), np.uint8)
    ends = np.cumsum([0, *map(len, points)])
    upto, real = np.concatenate([[0], np.cumsum(gaps, dtype=np.int64)]), gaps != 255
    groups = (upto[1:] - np.repeat(upto[ends[:-1]], np.diff(ends)))[real]
    return groups, np.concatenate([[0], np.cumsum(real)])[ends]


def occupied(raw: bytes, n: int, bits: int) -> np.ndarray:
    """Which of 2 ** bits groups the point of n shingles has something in."""
    table = np.zeros(1 << bits, bool)
    table[groups_of([raw])[0] >> (fine_bits(n) - bits)] = True
    return table


def fine_bound(table: np.ndarray, points: list[bytes], bits: int) -> np.ndarray:
    """At most so many shingles of each point are in a set that occupies the groups of the table. bits: groups of the points, no fewer than of the table."""
    groups, at = groups_of(points)
    hits = np.concatenate([[0], np.cumsum(table[groups >> (bits + 1 - len(table).bit_length())])])
    return hits[at[1:]] - hits[at[:-1]]


def dense(points: list[bytes], sizes: np.ndarray, bits: int) -> np.ndarray:
    """The counts of points by 2 ** bits groups; all are made of as many fine groups."""
    out, step = np.empty((len(points), 1 << bits), np.uint16), max(1, COMPARED >> bits)
    for lo in range(0, len(points), step):
        groups, at = groups_of(points[lo : lo + step])
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        counts = np.bincount((rows << bits) + (groups >> (fine_bits(int(sizes[0])) - bits)), minlength=(len(at) - 1) << bits)
        out[lo : lo + step] = np.minimum(counts, 2**16 - 1).reshape(-1, 1 << bits)
    return out


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Counts by fewer groups: neighbouring groups are added up."""
    return points if groups == points.shape[-1] else points.reshape(*points.shape[:-1], groups, -1).sum(-1, dtype=np.int32)


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared shingles that sizes n and m need: the least o with o * DEN >= NUM * (n + m - o)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many shared shingles: the summed minima of the counts."""
    return np.minimum(a, b).sum(-1, dtype=np.int64)


class Tree:
    """An R-tree over points of as many groups each, packed in order of size; it finds a point's possible partners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # a node has LEAF children; of a node are known the largest count in each group and the range of sizes
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > LEAF:
            high, low, top = self.levels[-1]
            cuts = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)))

    def partners(self, query: np.ndarray, size: int) -> np.ndarray:
        """Positions whose overlap with the query is not bounded away."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = self.levels[depth]
            at = at[(DEN * top[at] >= NUM * size) & (NUM * low[at] <= DEN * size)]
            least = least_overlap(size, np.maximum(low[at], -(-NUM * size // DEN)))
            rows = max(1, COMPARED // len(query))
            bounds = [overlap_bound(high[at[lo : lo + rows]], query) for lo in range(0, len(at), rows)]
            at = at[np.concatenate(bounds) >= least] if bounds else at
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at


class Block:
    """One side of a block of a bucket: rows (cls, comp, comp0, n, points), and the R-trees over them. Points of as many groups share a tree; a query with other groups meets it at the fewer of both."""

    def __init__(self, rows: list[tuple]) -> None:
        self.parts: list[tuple] = []
        by_bits: dict[int, list[tuple]] = {}
        for row in rows:
            by_bits.setdefault(fine_bits(row[3]), []).append(row)
        for bits, part in by_bits.items():
            part.sort(key=lambda r: (r[3], r[0]))
            names, comps, sizes = (np.array([r[k] for r in part]) for k in (0, 1, 3))
            points = [r[4] for r in part]
            self.parts.append((bits, points, dense(points, sizes, coarse_bits(int(sizes[0]))), names, comps, sizes, {}))

    def partners(self, cls: int, n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(cls, comp) of all rows that are not bounded away, the highest bound for their size first."""
        found = []
        for bits, points, counts, names, comps, sizes, trees in self.parts:
            if NUM * n > DEN * sizes[-1] or NUM * sizes[0] > DEN * n:
                continue
            query = dense([raw], np.array([n]), coarse_bits(n))[0]
            common, fine = min(len(query), counts.shape[1]), min(bits, fine_bits(n))
            if common not in trees:
                trees[common] = Tree(fold(counts, common), sizes)
            at = trees[common].partners(fold(query, common), n)
            table, step = occupied(raw, n, fine), max(1, COMPARED // (int(sizes[-1]) + 1))
            bounds = [fine_bound(table, [points[i] for i in at[lo : lo + step].tolist()], bits) for lo in range(0, len(at), step)]
            bound = np.concatenate([np.empty(0, np.int64), *bounds])
            fits = bound >= least_overlap(n, sizes[at])
            at, bound = at[fits], bound[fits]
            found.append((names[at], comps[at], bound / (n + sizes[at])))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        names, comps, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((names, -bound))
        order = order[names[order] != cls]
        return names[order], comps[order]


def bucket_pairs(left: list[tuple], right: list[tuple] | None, lo: int, hi: int) -> Iterator[tuple[int, int] | None]:
    """(cls, cls) within left, or between left and right, of different components: of each class outside the component that was the
    largest at first, the candidates of places lo to hi. None says that there are more beyond. Rows are (cls, comp, comp0, n, points)."""
    at_first: dict[int, int] = {}
    for row in [*left, *(right or [])]:
        at_first[row[2]] = at_first.get(row[2], 0) + 1
    largest = min(at_first, key=lambda c: (-at_first[c], c))
    sides, more = [(left, Block(left))] if right is None else [(left, Block(right)), (right, Block(left))], False
    for rows, block in sides:
        for cls, comp, comp0, n, raw in rows:
            if comp0 != largest:
                names, comps = block.partners(cls, n, raw)
                more = more or bool((comps[hi:] != comp).any())
                for other in names[lo:hi][comps[lo:hi] != comp].tolist():
                    yield (cls, other) if cls < other else (other, cls)
    if more:
        yield None


# -- scans over the texts -----------------------------------------------------------------------------------------------------------


def _first_scan(bits: int):
    """Each document's class and point; and the task's counts for the rarity sketch."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known, sketch = held(WordHashes, WordHashes), np.zeros(1 << bits, np.uint32)
        for frame in frames:
            sizes, names, points = [], [], []
            for text in frame["text_"]:
                shingles = shingle_set(text, known)
                sizes.append(len(shingles))
                names.append(set_digest(shingles) if len(shingles) else (None, None))
                points.append(point(shingles) if len(shingles) else None)
                np.add.at(sketch, (shingles >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            yield pd.DataFrame({"doc_id": frame["id_"].astype("Int64"), "pick": frame["pick_"], "n_shingles": sizes, "cls": pd.array([x for x, _ in names], dtype="Int64"), "other": pd.array([x for _, x in names], dtype="Int64"), "points": points, "part": None, "chunk": None, "counts": None})
        part = TaskContext.get().partitionId()
        chunks = sketch.reshape(-1, SKETCH_CHUNK)
        counts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in chunks]
        del sketch
        for at in range(0, len(chunks), 64):
            part_of = counts[at : at + 64]
            yield pd.DataFrame({"doc_id": None, "pick": None, "n_shingles": None, "cls": None, "other": None, "points": None, "part": part, "chunk": np.arange(at, at + len(part_of)), "counts": part_of})

    return scan


def _sum_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH_CHUNK, np.uint64)
    for counts in rows["counts"]:
        total += np.frombuffer(zlib.decompress(counts), "<u4")
    return pd.DataFrame({"part": rows["part"].iloc[:1] // 64, "chunk": rows["chunk"].iloc[:1], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})


def rarity_levels(counts: DataFrame, bits: int) -> np.ndarray:
    """The bit length of each counter of the sketch, summed over all tasks 64 at a time."""
    schema = "part int, chunk int, counts binary"
    most = counts.agg(F.max("part")).first()[0] or 0
    while True:
        counts = counts.withColumn("to", F.floor(F.col("part") / 64)).groupBy("to", "chunk").applyInPandas(_sum_chunks, schema)
        if most < 64:
            break
        counts, most = cut(counts, "sketch"), most // 64
    levels = np.zeros(1 << bits, np.uint8)
    for row in counts.select("chunk", "counts").collect():  # the sketch, of fixed size
        one = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
        levels[row["chunk"] * SKETCH_CHUNK : (row["chunk"] + 1) * SKETCH_CHUNK] = np.ceil(np.log2(one.astype(np.float64) + 1))
    return levels


def name_of(shingles: np.ndarray, shared: frozenset) -> int:
    """The name of the set's class; shared: names of more than one set."""
    name, other = set_digest(shingles)
    return other if name in shared else name


def _prefix_scan(levels, bits: int, shared: frozenset):
    """(key, cls, size): the rarest shingles of each class, as many as a partner must share one of. size: 2 n, and 1 more beyond those that a larger partner needs."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, level, done = held(WordHashes, WordHashes), levels.value, set()
        for frame in frames:
            keys, names, sizes = [], [], []
            for text in frame["text_"]:
                shingles = shingle_set(text, known)
                if not len(shingles) or (name := name_of(shingles, shared)) in done:
                    continue
                done.add(name)
                keep = len(shingles) - -(-NUM * len(shingles) // DEN) + 1
                order = np.lexsort((shingles, level[(shingles >> np.uint64(64 - bits)).astype(np.int64)]))[:keep]
                keys.append(shingles[order].view(np.int64))
                names.append(np.full(keep, name))
                sizes.append(np.full(keep, 2 * len(shingles)) + (np.arange(keep) > len(shingles) - least_overlap(len(shingles), len(shingles))))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "cls": np.concatenate(names), "size": np.concatenate(sizes)})

    return scan


def _set_scan(shared: frozenset):
    """(cls, shingles) of rows (cls, text_): the whole set of each class, once a task."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, done = held(WordHashes, WordHashes), set()
        for frame in frames:
            names, sets = [], []
            for text, cls in zip(frame["text_"], frame["cls"], strict=True):
                if cls not in done and name_of(shingles := shingle_set(text, known), shared) == cls:
                    done.add(cls)
                    names.append(cls)
                    sets.append(shingles.tobytes())
            if names:
                yield pd.DataFrame({"cls": names, "shingles": sets})

    return scan


# -- rounds -------------------------------------------------------------------------------------------------------------------------


def _not_bounded_away(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pairs with both points, those whose sizes fit and whose points allow the overlap they need. Many pairs are counted at once, the smaller point of each in a table of its own."""
    for frame in frames:
        n, m = (frame[x].to_numpy(np.int64) for x in ("n", "m"))
        low, high = np.minimum(n, m), np.maximum(n, m)
        fits = np.flatnonzero(DEN * low >= NUM * high)
        points = [(p, q) if x <= y else (q, p) for p, q, x, y in zip(frame["p"], frame["q"], n, m, strict=True)]
        bits, finer = (np.array([fine_bits(x) for x in sizes.tolist()], np.int64) for sizes in (low, high))
        room, keep = 1 << bits, []
        for part in np.split(fits, np.flatnonzero(np.diff(np.cumsum(room[fits]) // TABLES)) + 1):
            begins = np.cumsum(room[part]) - room[part]
            table = np.zeros(int(room[part].sum()), bool)
            groups, at = groups_of([points[i][0] for i in part])
            table[groups + np.repeat(begins, np.diff(at))] = True
            groups, at = groups_of([points[i][1] for i in part])
            hits = np.concatenate([[0], np.cumsum(table[(groups >> np.repeat(finer[part] - bits[part], np.diff(at))) + np.repeat(begins, np.diff(at))])])
            keep += part[hits[at[1:]] - hits[at[:-1]] >= least_overlap(low[part], high[part])].tolist()
        yield frame.iloc[keep][["a", "b"]]


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keep = []
        for s, t in zip(frame["s"], frame["t"], strict=True):
            both = np.concatenate([np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(DEN * shared >= NUM * (len(both) - shared))
        yield frame.loc[keep, ["a", "b"]]


def _search_buckets(lo: int, hi: int):
    """Rows sorted by bucket and block pair, a bucket may run on into the next frame: (a, b) of the pairs to verify, and key of buckets that have more."""

    def search_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sides, found, more = None, ([], []), set(), set()

        def hand_on() -> pd.DataFrame:
            pairs = list(found)
            found.clear()
            return pd.DataFrame({"a": pd.array([a for a, _ in pairs], dtype="Int64"), "b": pd.array([b for _, b in pairs], dtype="Int64"), "key": pd.array([None] * len(pairs), dtype="Int64")})

        def search() -> Iterator[pd.DataFrame]:
            if at is not None:
                for pair in bucket_pairs(sides[0], None if at[1] == at[2] else sides[1], lo, hi):
                    if pair is None:
                        more.add(at[0])
                    else:
                        found.add(pair)
                    if len(found) >= HELD:
                        yield hand_on()
            sides[0].clear()
            sides[1].clear()

        for frame in frames:
            for key, i, j, side, *row in frame[["key", "i", "j", "side", "cls", "comp", "comp0", "n", "points"]].itertuples(index=False, name=None):
                if (key, i, j) != at:
                    yield from search()
                    at = (key, i, j)
                sides[side].append(tuple(row))
        yield from search()
        yield hand_on()
        yield pd.DataFrame({"a": pd.array([None] * len(more), dtype="Int64"), "b": pd.array([None] * len(more), dtype="Int64"), "key": pd.array(list(more), dtype="Int64")})

    return search_all


class JaccardJoin:
    """The join over (doc_id, text) rows. Classes, rarity and buckets are kept in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.texts = docs.selectExpr(f"cast({id_col} as long) as id_", f"{text_col} as text_", f"xxhash64({id_col}, {text_col}) as pick_")
        small_batches(docs.sparkSession, 2)
        counters = max(SKETCH_LEAST, min(SKETCH_MOST, 4 * docs.count()))
        self.bits = (counters - 1).bit_length()
        first = cut(self.texts.mapInPandas(_first_scan(self.bits), FIRST), "classes")
        self.counts = first.where("counts is not null").select("part", "chunk", "counts")
        named = first.where("cls is not null").groupBy("cls")
        # expected of 10 billion sets: three names
        self.shared = frozenset(r[0] for r in named.agg((F.min("other") != F.max("other")).alias("several")).where("several").select("cls").collect())
        cls = F.when(F.col("cls").isin(*self.shared), F.col("other")).otherwise(F.col("cls")) if self.shared else F.col("cls")
        rows = first.where("counts is null").withColumn("cls", cls)
        self.docs = rows.select("doc_id", "pick", "n_shingles", "cls")
        self.classes = rows.where("cls is not null").groupBy("cls").agg(F.min("pick").alias("pick"), F.first("n_shingles").alias("n"), F.first("points").alias("points"))

    def buckets(self) -> DataFrame:
        """(key, cls, root): the classes that share a rare shingle and can be partners by their sizes, and the least of them."""
        levels = self.texts.sparkSession.sparkContext.broadcast(rarity_levels(self.counts, self.bits))
        keys = self.texts.select("text_").mapInPandas(_prefix_scan(levels, self.bits, self.shared), "key long, cls long, size long")
        bucket = Window.partitionBy("key")
        by_size = bucket.orderBy("size", "cls")
        leads, n = F.col("size") % 2 == 0, F.floor(F.col("size") / 2)
        smaller = F.max(F.when(leads, n)).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
        larger = F.floor(F.lead("size").over(by_size) / 2)
        rows = keys.withColumns({"smaller": smaller, "larger": larger}).where((F.col("smaller") * DEN >= n * NUM) | (leads & (F.col("larger") * NUM <= n * DEN)))
        rows = rows.withColumns({"root": F.min("cls").over(bucket), "last": F.max("cls").over(bucket)})
        return cut(rows.where("root != last").select("key", "cls", "root").distinct(), "buckets")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """(a, b) without those that the points bound away."""
        points = self.classes.select("cls", "n", "points")
        both = pairs.join(points.toDF("a", "n", "p"), "a").join(points.toDF("b", "m", "q"), "b")
        both = both.where(DEN * F.least("n", "m") >= NUM * F.greatest("n", "m"))
        return both.mapInPandas(_not_bounded_away, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of those pairs of classes that are similar, by their whole sets."""
        pairs = cut(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(self.classes.select("cls", "pick"), "cls")
        needed = cut(needed.select("cls", F.col("pick").alias("pick_")), "needed")
        texts = self.texts.join(F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed, "pick_")
        sets = cut(texts.select("cls", "text_").mapInPandas(_set_scan(self.shared), "cls long, shingles binary").dropDuplicates(["cls"]), "sets")
        both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
        return cut(both.mapInPandas(_verified, "a long, b long"), "verified")

    def still_open(self, buckets: DataFrame, comps: DataFrame) -> DataFrame:
        """(key, cls, comp0, block, blocks): the buckets whose classes are in several components, dealt into blocks.

        A bucket of two classes has been settled by its root."""
        bucket = Window.partitionBy("key")
        rows = buckets.select("key", "cls").join(comps.toDF("cls", "comp0"), "cls", "left").withColumn("comp0", F.coalesce("comp0", "cls"))
        rows = rows.withColumns({"first": F.min("comp0").over(bucket), "last": F.max("comp0").over(bucket), "many": F.count("*").over(bucket)}).where("first != last and many > 2")
        rows = rows.withColumn("block", F.floor((F.row_number().over(bucket.orderBy("cls")) - 1) / BLOCK).cast("int")).withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
        return cut(rows.select("key", "cls", "comp0", "block", "blocks"), "open")

    def candidates(self, rows: DataFrame, comps: DataFrame, lo: int, hi: int) -> DataFrame:
        """(a, b, key): candidates of places lo to hi of classes that are in different components by now; key alone: that bucket has more."""
        now = rows.join(comps.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).join(self.classes.select("cls", "n", "points"), "cls")
        now = now.withColumn("opposite", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = [F.least("block", "opposite").alias("i"), F.greatest("block", "opposite").alias("j"), (F.col("block") > F.col("opposite")).cast("int").alias("side")]
        dealt = now.select("key", *pair, "cls", "comp", "comp0", "n", "points").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return cut(dealt.mapInPandas(_search_buckets(lo, hi), "a long, b long, key long"), "found")

    def components(self) -> DataFrame:
        """(cls, comp) of every class that is linked to another; comp is the least class that links reach."""
        buckets = self.buckets()
        stars = buckets.where("cls != root").select(F.col("root").alias("a"), F.col("cls").alias("b")).distinct()
        comps = components(self.verified(self.bounded(stars)).toDF("u", "v"))
        rows, lo, hi = self.still_open(buckets, comps), 0, CANDIDATES
        while True:
            found = self.candidates(rows, comps, lo, hi)
            links = self.verified(found.where("key is null").select("a", "b").distinct())
            ends = links.join(comps.toDF("a", "p"), "a", "left").join(comps.toDF("b", "q"), "b", "left")
            merged = components(ends.select(F.coalesce("p", "a").alias("u"), F.coalesce("q", "b").alias("v")))
            moved = comps.join(merged.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            comps = cut(moved.unionByName(merged.join(comps, "node", "left_anti")), "components")
            more = found.where("key is not null").select("key").distinct()
            if more.isEmpty():
                return comps.toDF("cls", "comp")
            rows, lo, hi = rows.join(more, "key", "left_semi"), hi, FACTOR * hi

    def groups(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        return self.rows().select("doc_id", "n_shingles", "component_id")

    def rows(self) -> DataFrame:
        """(doc_id, pick, n_shingles, component_id, comp) of every row; pick tells its text, comp the group, as groups may share an id."""
        linked = self.components()
        named = self.docs.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
        named = named.join(linked, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        named = cut(named, "named")
        smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        by_class = named.join(smallest, "comp").select("cls", "comp", "component_id")
        found = self.docs.join(by_class, "cls", "left")
        return found.select("doc_id", "pick", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "comp")
