"""The segmentation lattice of a SentencePiece vocabulary, and chunks of a text as max-plus transfer matrices over it.

A path through the lattice is a segmentation; a piece's weight is its score. At a chunk's boundary the state of a path is its last
piece and how far that reaches over the boundary. A chunk's matrix holds, for each state that may come in and each that may go out,
the best weight of a path between them; matrices of neighbouring chunks combine by (max, +).

Byte-pair models fit in as a lattice with weights of 0 in which two pieces may follow each other only if the merges of their joint
characters give just these two: a segmentation is the model's own if and only if every neighbouring pair passes. So the one path that lives to the end of
the text is the model's result, whatever the chunks. No piece runs from a word into the mark of the next, so all paths meet
where a new mark begins; whole words between such places are looked up once and remembered.
"""

from __future__ import annotations

import math
import re

import numpy as np

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words and pairs remembered by a worker; results do not depend on it.
REMEMBERED = 30_000
State = tuple[str, int]
START: State = ("", 0)

_LOADED: dict[str, Lattice] = {}


class Lattice:
    """scores: piece -> (id, score). byte_ids: the ids of the bytes, for characters that no piece holds. merges: whether it is a byte-pair model."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], merges: bool, encode_word=None) -> None:
        self.scores, self.byte_ids, self.merges, self.encode_word = scores, byte_ids, merges, encode_word
        self.longest = max(map(len, scores))
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cuts = all(MARK not in p.lstrip(MARK) for p in scores)

    # -- pieces ------------------------------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The byte-pair merges of a short text: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b][1], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, a: str, b: str) -> bool:
        """May piece b come after piece a? An empty a asks whether b is a piece the merges can make."""
        if not self.merges:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def from_(self, text: str, at: int, end: int):
        """(piece, score) of the pieces that begin at a place; a character in none of them stands for itself."""
        hit = False
        for to in range(at + 1, min(end, at + self.longest) + 1):
            if (piece := text[at:to]) in self.scores:
                hit |= to == at + 1
                if self.follows("", piece):
                    yield piece, 0.0 if self.merges else self.scores[piece][1]
        if not hit:
            yield text[at], 0.0 if self.merges else min(s for _, s in self.scores.values()) - 10

    def ids(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in ([self.scores[p][0]] if p in self.scores else [self.byte_ids[b] for b in p.encode()])]

    def text(self, ids: list[int], names: list[str | None]) -> str:
        """The text of ids; names: each id's piece, None for bytes."""
        byte = {x: i for i, x in enumerate(self.byte_ids)}
        return b"".join(bytes([byte[i]]) if names[i] is None else names[i].encode() for i in ids).decode("utf-8", "replace").replace(MARK, " ")

    # -- paths -------------------------------------------------------------------------------------------------------------------

    def walk(self, text: str, ends: dict[int, dict[str, np.ndarray]], stop: int, limit: int):
        """Carry weights from the given ends of paths to all states at `stop`; pieces that begin before it may reach to `limit`.

        ends: place -> last piece -> weights, one for each path that came in. Returns the states and, to trace back, what each came from."""
        back: dict[tuple[int, str], tuple[int, str]] = {}
        at = {p: dict(x) for p, x in ends.items()}
        for place in range(min(at, default=stop), stop):
            for last, weights in at.pop(place, {}).items():
                for piece, score in self.from_(text, place, limit):
                    if last and not self.follows(last, piece):
                        continue
                    to, name = place + len(piece), piece if self.merges else ""
                    there, new = at.setdefault(to, {}), weights + score
                    old = there.get(name)
                    if old is None or new.max() > old.max():
                        back[to, name] = (place, last)
                    there[name] = new if old is None else np.maximum(old, new)
        return {(name, place): w for place, x in at.items() for name, w in x.items()}, back

    def trace(self, text: str, back: dict, place: int, name: str) -> list[str]:
        pieces = []
        while (place, name) in back:
            before, last = back[place, name]
            pieces.append(text[before:place])
            place, name = before, last
        return pieces[::-1]

    def word(self, segment: str) -> list[int]:
        """The ids of a whole segment from one meeting place to the next."""
        known = self.words.get(segment)
        if known is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            if self.encode_word and segment[0] == MARK and segment != MARK:  # the model gives nothing for an empty text
                known = self.encode_word(segment)
            else:
                states, back = self.walk(segment, {0: {"": np.zeros(1)}}, len(segment), len(segment))
                best = max(states, key=lambda s: states[s][0])
                known = self.ids(self.trace(segment, back, best[1], best[0]))
            self.words[segment] = known
        return known


class Chunk:
    """A stretch of a text with the characters before and after that pieces over its boundaries may hold."""

    def __init__(self, lattice: Lattice, before: str, own: str, after: str, first: bool, last: bool) -> None:
        self.lattice, self.text, self.first, self.last = lattice, before + own + after, first, last
        self.a, self.b = len(before), len(before) + len(own)
        self.meets = [p for p in range(self.a, self.b + 1) if self.meeting(p)]

    def meeting(self, p: int) -> bool:
        """Do all paths have a cut here?"""
        if (p == self.a and self.first) or (p == self.b and self.last):
            return True
        return self.lattice.cuts and 0 < p < len(self.text) and self.text[p] == MARK and self.text[p - 1] != MARK

    def incoming(self) -> list[State]:
        if self.meeting(self.a):
            return [START]
        out = set()
        for start in range(max(0, self.a - self.lattice.longest), self.a):
            for end in range(self.a, min(len(self.text), start + self.lattice.longest) + 1):
                piece = self.text[start:end]
                if (piece in self.lattice.scores and self.lattice.follows("", piece)) or (end == start + 1 and piece not in self.lattice.scores):
                    out.add((piece if self.lattice.merges else "", end - self.a))
        return sorted(out)

    def _limit(self, p: int) -> int:
        """The next meeting place after p, beyond which no piece reaches."""
        return next((q for q in range(p + 1, len(self.text)) if self.meeting(q)), len(self.text))

    def _head(self, ins: list[State]) -> dict[int, dict[str, np.ndarray]]:
        ends: dict[int, dict[str, np.ndarray]] = {}
        for k, (piece, over) in enumerate(ins):
            weights = np.full(len(ins), -np.inf)
            weights[k] = 0.0
            here = ends.setdefault(self.a + over, {})
            here[piece] = np.maximum(here[piece], weights) if piece in here else weights
        return ends

    def transfer(self) -> tuple[list[State], list[State], np.ndarray]:
        """States that may come in, states that may go out, and the best weight between each two. Words between two
        meeting places add the same to every path and are left out."""
        ins = self.incoming()
        if not self.meets:
            states, _ = self.lattice.walk(self.text, self._head(ins), self.b, self._limit(self.b))
            outs = sorted(states)
            matrix = np.array([states[s] for s in outs]).T if outs else np.zeros((len(ins), 0))
            return ins, [(name, place - self.b) for name, place in outs], matrix
        head = np.zeros(len(ins))
        if self.meets[0] > self.a:
            states, _ = self.lattice.walk(self.text, self._head(ins), self.meets[0], self.meets[0])
            # paths whose last piece came in may end at the meeting place themselves
            head = np.max([w for (_, place), w in states.items() if place == self.meets[0]], axis=0, initial=-np.inf)
        if self.meets[-1] == self.b:
            return ins, [START], head[:, None]
        states, _ = self.lattice.walk(self.text, {self.meets[-1]: {"": np.zeros(1)}}, self.b, self._limit(self.b))
        outs = sorted(states)
        return ins, [(name, place - self.b) for name, place in outs], head[:, None] + np.array([states[s][0] for s in outs])[None, :]

    def backtrace(self, come: State, go: State) -> list[int]:
        """The ids of the pieces that begin in this chunk on the best path between two states."""
        lattice, text = self.lattice, self.text
        start = {self.a + come[1]: {come[0]: np.zeros(1)}}
        if not self.meets:
            _, back = lattice.walk(text, start, self.b, self._limit(self.b))
            return lattice.ids(lattice.trace(text, back, self.b + go[1], go[0]))
        ids: list[int] = []
        if self.meets[0] > self.a:
            states, back = lattice.walk(text, start, self.meets[0], self.meets[0])
            best = max((s for s in states if s[1] == self.meets[0]), key=lambda s: states[s][0])
            ids += lattice.ids(lattice.trace(text, back, best[1], best[0]))
        for segment in SEGMENT.findall(text[self.meets[0] : self.meets[-1]]) if lattice.cuts else [text[p:q] for p, q in zip(self.meets, self.meets[1:], strict=False)]:
            ids += lattice.word(segment)
        if self.meets[-1] < self.b:
            _, back = lattice.walk(text, {self.meets[-1]: {"": np.zeros(1)}}, self.b, self._limit(self.b))
            ids += lattice.ids(lattice.trace(text, back, self.b + go[1], go[0]))
        return ids


Transfer = tuple[list[State], list[State], np.ndarray]


def compose(left: Transfer, right: Transfer) -> Transfer:
    """The transfer of two neighbouring stretches: the (max, +) product over the states that both know."""
    place = {s: i for i, s in enumerate(right[0])}
    shared = [(i, place[s]) for i, s in enumerate(left[1]) if s in place]
    out = np.full((len(left[0]), len(right[1])), -np.inf)
    for i, j in shared:
        out = np.maximum(out, left[2][:, i][:, None] + right[2][j][None, :])
    return left[0], right[1], out


def boundary_states(transfers: list[Transfer], come: State = START, go: State = START) -> list[State]:
    """The states of the best path at every boundary, both ends included."""
    reach: list[dict[State, float]] = [{come: 0.0}]
    for ins, outs, matrix in transfers:
        weights = np.array([reach[-1].get(s, -np.inf) for s in ins])
        best = np.max(weights[:, None] + matrix, axis=0, initial=-np.inf)
        reach.append({s: float(w) for s, w in zip(outs, best, strict=True) if w > -math.inf})
    states = [go]
    for (ins, outs, matrix), before in zip(transfers[::-1], reach[-2::-1], strict=True):
        column = matrix[:, outs.index(states[-1])] + np.array([before.get(s, -np.inf) for s in ins])
        states.append(ins[int(column.argmax())])
    return states[::-1]


def loaded(path: str) -> Lattice:
    """The lattice of a byte-pair .model file, once a worker."""
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("ﬁ  x ", out_type=str) != model.encode("ﬁ", out_type=str) + model.encode(" x ", out_type=str):
            raise ValueError("the model normalises its texts")
        names = [model.id_to_piece(i) for i in range(len(model))]
        byte_ids = [0] * 256
        scores = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                byte_ids[int(name[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[name] = (i, model.get_score(i))
        # the model puts a mark before what it encodes; a segment brings its own
        lattice = Lattice(scores, byte_ids, True, lambda segment: model.encode(segment[1:].replace(MARK, " "), num_threads=1))
        lattice.model, lattice.names = model, [None if model.is_byte(i) else name for i, name in enumerate(names)]
        _LOADED[path] = lattice
    return _LOADED[path]
