"""Operator 11, alignment of two tokenizers' tokens by a sweep over their end events.

Each text, led by a space, is encoded by both tokenizers. A token's event is the byte offset where it ends; as every id has a fixed length in
bytes, a block of one side's events is where it begins and its ids. Blocks of both sides are shuffled by document and sorted by offset within
the partition, and stream through a machine that holds one window of events and the tokens past the last offset where both sides end. Such an
offset closes a group; each stretch between two neighbouring events links the one token of A and the one token of B that cover it. Of a
document the machine keeps its counters, a running digest and its distinct linked pairs.

Documents that hold a pair are counted over the corpus, once each. The counts join the documents' distinct pairs, broadcast only if they are few.

Pre-tokens of A and words of B are encoded once a worker; a piece of B never runs from a word into the space after it, or the model is refused.

Cases: null and empty texts, and texts whose tokens don't give back their bytes (those with U+2581), have no tokens and zeros; special strings
inside texts are plain text; rows that repeat an id and text are documents of their own, in counts too; rows that share an id only are kept
apart; null ids are kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, small_batches
from tidewright.llm.pretokens import loaded

MARK = "▁"
EVENTS = "doc_id long, h long, at long, side int, ids binary"
#: Characters of a text that are encoded at once, tokens of a block of events, and tokens of a window.
STRETCH, BLOCK, WINDOW = 1 << 16, 1 << 16, 1 << 19
#: Characters of texts whose words are looked up together.
TEXTS = 1 << 21
#: Words of one side that a worker remembers, and those that stay when it forgets the rest.
REMEMBERED, KEPT = 300_000, 100_000
#: Pairs whose counts are broadcast at most, some 40 bytes each.
BROADCAST_PAIRS = 1_000_000
#: A place where both tokenizers begin anew: before a single space between two letters.
SAFE = re.compile("[A-Za-z] (?=[A-Za-z])")


def byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable bytes as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level .json file of the tokenizers library, special strings as plain text."""

    def __init__(self, path: str) -> None:
        self.pre, byte = loaded(path), byte_of_character()
        tokenizer, self.size = self.pre.tokenizer, self.pre.size
        self.bytes = [bytes(byte[c] for c in tokenizer.id_to_token(i)) if i not in set(self.pre.special.values()) else b"" for i in range(self.size)]

    def split(self, text: str) -> list[str]:
        return self.pre.split(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        ids, starts = self.pre.ids_of(words)
        ids, starts = ids.tolist(), starts.tolist()
        return [ids[a:b] for a, b in zip(starts, starts[1:], strict=False)]


class Pieces:
    """Side B: a SentencePiece .model file, which leads every text by a space of its own."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.space = model.get_piece_size(), model.piece_to_id(MARK)
        self.bytes = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.size)]
        if any(b" " in x.lstrip(b" ") for x in self.bytes):
            raise ValueError("a piece of the model runs from a word into a space")
        self.split = re.compile(" *[^ ]+| +").findall

    def encode(self, words: list[str]) -> list[list[int]]:
        """Each word begins with a space, which the model adds itself."""
        return [[self.space] if w == " " else ids for w, ids in zip(words, self.model.encode([w[1:] for w in words], num_threads=1), strict=True)]


class Side:
    """One tokenizer with the ids of the words a worker has met, in bytes."""

    def __init__(self, path: str) -> None:
        self.of = Pieces(path) if path.endswith(".model") else ByteLevel(path)
        self.size, self.code = self.of.size, "H" if self.of.size <= 1 << 16 else "I"
        self.lengths = np.array([len(x) for x in self.of.bytes], np.int64)
        self.known: dict[str, bytes] = {}
        self.unlike: set[str] = set()

    def ids(self, parts: list[str]) -> list[np.ndarray | None]:
        """The ids of each part; None where their bytes aren't the part's."""
        words = [self.of.split(x) for x in parts]
        self.learn(list({x for part in words for x in part if x not in self.known}))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, part)), self.code) for part in words]
        if self.unlike:
            out = [ids if self.unlike.isdisjoint(part) else None for ids, part in zip(out, words, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), KEPT))
            self.unlike &= self.known.keys()
        return out

    def learn(self, new: list[str]) -> None:
        of, known, code = self.of.bytes, self.known, self.code
        for word, ids in zip(new, self.of.encode(new), strict=True):
            known[word] = array(code, ids).tobytes()
            if b"".join([of[i] for i in ids]) != word.encode():
                self.unlike.add(word)


_SIDES: dict[str, Side] = {}


def side_of(path: str) -> Side:
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def stretches(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (hit := SAFE.search(text, at + size)):
        yield text[at : hit.start() + 1]
        at = hit.start() + 1
    yield text[at:]


def blocks(texts: list[str | None], sides: tuple[Side, Side], size: int, block: int) -> list[tuple[int, int, int, bytes]]:
    """(place of the text, byte offset, side, compressed ids) of both sides' events, or one without ids where a text has no tokens."""
    parts = [(i, x) for i, text in enumerate(texts) if text for x in stretches(" " + text, size)]
    ids = [side.ids([x for _, x in parts]) for side in sides]
    without = {i for i, text in enumerate(texts) if not text} | {i for (i, _), *both in zip(parts, *ids, strict=True) if any(x is None for x in both)}
    out, last, base = [(i, 0, 0, b"") for i in without], None, 0
    for (i, text), *both in zip(parts, *ids, strict=True):
        base, last = base if i == last else 0, i
        if i in without:
            continue
        for number, (side, found) in enumerate(zip(sides, both, strict=True)):
            ends = np.cumsum(side.lengths[found]) if len(found) > block else ()
            for lo in range(0, len(found), block):
                out.append((i, base + (int(ends[lo - 1]) if lo else 0), number, pa.compress(found[lo : lo + block].tobytes(), "zstd", asbytes=True)))
        base += len(text.encode())
    return out


def groups_of(texts: list[str | None], most: int) -> Iterator[range]:
    """Neighbouring texts, together of so many characters unless one alone has more."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield range(at, i)
            at, size = i, 0
        size += len(text or "")
    yield range(at, len(texts))


def events(docs: DataFrame, a: str, b: str, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """The end events of both sides of rows doc_id, text, in blocks."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = side_of(a), side_of(b)
        names = ["doc_id", "h", "at", "side", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            found = [(ids[g[i]], hashes[g[i]], *x) for g in groups_of(texts, TEXTS) for i, *x in blocks(texts[g.start : g.stop], sides, stretch, block)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 5, kinds, strict=True)], names=names)

    return docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("h"), "text").mapInArrow(of_batches, EVENTS)


class Machine:
    """Takes blocks by document and offset and gives each document's row when it has passed."""

    def __init__(self, sides: tuple[Side, Side], window: int) -> None:
        self.sides, self.window = sides, window
        width = max(len(str(s.size - 1)) for s in sides) + 1
        # decimal ids with what follows them: one of the group's own side, or the end of the side, which is | for A and ; for B
        self.texts = [np.array([f"{i},".encode() for i in range(s.size)] + [f"{i}{last}".encode() for i in range(s.size)], f"S{width}") for s, last in zip(sides, "|;", strict=True)]
        self.closed: list[Open] = []
        self.open: Open | None = None
        self.held = 0

    def take(self, key: tuple, at: int, side: int, data: bytes) -> list[tuple]:
        """Rows of documents that are done."""
        out = []
        if self.open is None or self.open.key != key:
            if self.open is not None:
                self.closed.append(self.open)
            if self.held >= self.window:
                out = self.sweep(self.closed, None)
                self.closed = []
            self.open = Open(key)
        now = self.open
        if (side, at) == (0, 0):
            now.copies += 1
        if now.last[side] == at:  # a row that repeats
            return out
        now.last[side] = at
        if data:
            ids = np.frombuffer(pa.decompress(data, pa_size(data), "zstd"), self.sides[side].code)
            now.ids[side].append(ids)
            self.held += len(ids)
            if self.held >= 2 * self.window:
                out += self.sweep([*self.closed], now)
                self.closed = []
        return out

    def end(self) -> list[tuple]:
        return self.sweep(self.closed + ([self.open] if self.open else []), None)

    def sweep(self, whole: list[Open], part: Open | None) -> list[tuple]:
        """Sweeps the held tokens of whole documents and of one that goes on, as if they were one text: documents end where both sides do."""
        docs = whole + ([part] if part else [])
        (ids_a, count_a), (ids_b, count_b) = (self.held_ids(docs, s) for s in (0, 1))
        ends_a, ends_b = np.cumsum(self.sides[0].lengths[ids_a]), np.cumsum(self.sides[1].lengths[ids_b])
        size = max(ends_a[-1] if len(ends_a) else 0, ends_b[-1] if len(ends_b) else 0)
        mark = np.zeros(size + 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] += 2
        if part:  # up to the last offset where both sides end; the tokens after it wait
            both = np.flatnonzero(mark == 3)
            limit = int(both[-1]) if len(both) else 0
            n_a, n_b = int(np.searchsorted(ends_a, limit, "right")), int(np.searchsorted(ends_b, limit, "right"))
            part.ids = [[ids_a[n_a:]], [ids_b[n_b:]]]
            count_a[-1] -= len(ids_a) - n_a
            count_b[-1] -= len(ids_b) - n_b
            ids_a, ids_b, ends_a, ends_b, mark = ids_a[:n_a], ids_b[:n_b], ends_a[:n_a], ends_b[:n_b], mark[: limit + 1]
        self.held = sum(len(x) for side in part.ids for x in side) if part else 0
        events = np.flatnonzero(mark)
        kind = mark[events]
        is_a, is_b, both = kind & 1, kind >> 1, kind == 3
        seen_a, seen_b, seen = np.cumsum(is_a, dtype=np.int64), np.cumsum(is_b, dtype=np.int64), np.cumsum(both)
        links = ids_a[seen_a - is_a].astype(np.int64) * self.sides[1].size + ids_b[seen_b - is_b]
        upto_a, upto_b = np.cumsum(count_a), np.cumsum(count_b)
        at_end = np.concatenate([[0], ends_a])[upto_a]
        upto_event = np.searchsorted(events, at_end, "right")
        # each group's tokens of A, then those of B
        group_a, group_b = (seen - both)[is_a > 0], (seen - both)[is_b > 0]
        text = np.empty(len(ids_a) + len(ids_b), self.texts[0].dtype)
        text[np.arange(len(ids_a)) + np.concatenate([[0], seen_b[both]])[group_a]] = self.texts[0][ids_a + self.sides[0].size * both[is_a > 0]]
        text[np.arange(len(ids_b)) + seen_a[both][group_b]] = self.texts[1][ids_b + self.sides[1].size * both[is_b > 0]]
        owner = np.repeat(np.arange(len(docs)), np.diff(upto_event, prepend=0))
        span = self.sides[0].size * self.sides[1].size
        pairs, times = np.unique(owner * span + links, return_counts=True)
        upto_pair = np.searchsorted(pairs, np.arange(1, len(docs) + 1) * span)
        groups = np.concatenate([[0], seen])[upto_event]
        at = event = pair = group = 0
        for i, doc in enumerate(docs):
            doc.n_a += int(count_a[i])
            doc.n_b += int(count_b[i])
            doc.n_links += int(upto_event[i] - event)
            doc.n_groups += int(groups[i] - group)
            upto = int(upto_a[i] + upto_b[i])
            doc.digest(text[at:upto].tobytes().translate(None, b"\0"))
            doc.pairs.append((pairs[pair : upto_pair[i]] - i * span, times[pair : upto_pair[i]]))
            at, event, pair, group = upto, upto_event[i], upto_pair[i], groups[i]
        return [doc.row() for doc in whole]

    def held_ids(self, docs: list[Open], side: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [x for d in docs for x in d.ids[side]]
        return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64), np.array([sum(map(len, d.ids[side])) for d in docs], np.int64)


class Open:
    """What is known of a document that isn't done."""

    def __init__(self, key: tuple) -> None:
        self.key, self.copies, self.last = key, 0, [-1, -1]
        self.ids: list[list[np.ndarray]] = [[], []]
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha, self.begun, self.pairs = hashlib.sha256(), False, []

    def digest(self, text: bytes) -> None:
        if text:
            self.sha.update((b";" if self.begun else b"") + text[:-1])
            self.begun = True

    def row(self) -> tuple:
        pairs, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        if len(self.pairs) > 1:
            pairs, of = np.unique(pairs, return_inverse=True)
            times = np.bincount(of, times).astype(np.int64)
        return *self.key, self.copies, self.n_a, self.n_b, self.n_groups, self.n_links, self.sha.hexdigest() if self.begun else "", pairs, times


def pa_size(data: bytes) -> int:
    """The size of what a zstd frame holds, which its header tells."""
    import zstandard

    return zstandard.frame_content_size(data)


def swept(dealt: DataFrame, a: str, b: str, window: int = WINDOW) -> DataFrame:
    """A row for each document (repeats of one in copies), of blocks that are dealt by document and sorted by offset."""
    names = ["doc_id", "h", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        *plain, pairs, times = zip(*rows, strict=True)
        starts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x), k)) for x, k in ((pairs, pa.int64()), (times, pa.int32()))]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds, strict=True)), *lists], names=names)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine((side_of(a), side_of(b)), window)
        for batch in batches:
            ids, hashes, at, side, data = (c.to_pylist() for c in batch.columns)
            for i in range(len(ids)):
                if rows := machine.take((ids[i], hashes[i]), at[i], side[i], data[i]):
                    yield frame(rows)
        if rows := machine.end():
            yield frame(rows)

    return dealt.mapInArrow(of_batches, "doc_id long, h long, copies int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def aligned(docs: DataFrame, a: str, b: str, n_parts: int, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The swept documents (see swept) with the distinct linked pairs of each, a * size of B + b, and how often each occurs."""
    small_batches(docs.sparkSession, 4)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = events(rows, a, b, **{k: v for k, v in sizes.items() if k != "window"})
    dealt = found.repartition(n_parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "at", "side")
    return swept(dealt, a, b, sizes.get("window", WINDOW))


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): in how many documents a pair is linked, and whether no pair of the same A id is in more."""
    counts = cut(links.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("count")), "pairs")
    of_a = F.floor(F.col("pair") / size_b)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), of_a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))  # a row for each id of A at most


def align(docs: DataFrame, a: str, b: str, n_parts: int, id_col: str = "doc_id", text_col: str = "text", few: int = BROADCAST_PAIRS, **sizes: int) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    links = cut(aligned(docs, a, b, n_parts, id_col, text_col, **sizes), "links")
    counts = cut(pair_counts(links, side_of(b).size), "counts")
    of_docs = links.select("doc_id", "h", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("doc_id", "h", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = of_docs.join(F.broadcast(counts) if counts.count() <= few else counts, "pair")
    sums = met.groupBy("doc_id", "h").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    sums = sums.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), "n_best", "count_sum")
    rows = links.drop("pairs", "times").join(sums, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")
