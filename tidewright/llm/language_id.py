"""Operator 10, language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of labelled text. A text is parsed against each automaton into
phrases, each the longest match with the language's text from where the one before ended; phrases times the logarithm of the
language's text length, over the letters parsed, estimate the cross entropy. The language of the fewest normalised phrases wins.

Texts are compared as letters: lower case, everything between two letters one space. They are parsed in stretches of STRETCH symbols
that count from the text's beginning, so a result depends on the text alone; all stretches of a batch, in all languages, advance
together through the automata's transition tables.

Symbols are the samples' letters. If they are more than ALPHABET, the SINGLE most frequent are symbols and each other letter is written as two or
three digits, as many as all of them need, so that letters of any script stay apart; a letter that no sample has matches nothing.

The sample is the only thing that is bounded, and every label is learned: of each language SAMPLE_DOCS documents, those of smallest hash, of each of
these the first DOC_CHARS characters, and of these together up to SAMPLE_CHARS symbols. With many languages, these bounds shrink to
an equal part of ALL_DOCS and ALL_CHARS each, but not under LEAST_DOCS and LEAST_CHARS.

Cases: a null text or one without letters is "und" with score 0; without learned languages every text is; languages that tie go by name; null ids
and repeated rows are rows like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewright.llm.common import cut, held, small_batches, unused

SAMPLE_DOCS = 200
SAMPLE_CHARS = 24_000
DOC_CHARS = 480
#: Symbols and documents of all languages' samples together, and the least for each.
ALL_CHARS, LEAST_CHARS = 240_000, 200
ALL_DOCS, LEAST_DOCS = 10_000, 4
STRETCH = 256
#: Letters that are symbols of their own; if there are more, those that stay so, and the digits that write the others.
ALPHABET, SINGLE, DIGITS = 126, 62, 64
LANES = 1 << 16

SPACE, OTHER = 0, 1
ADDED = ("lang_pred_", "score_", "bits_")


def sample_texts(labelled: DataFrame) -> dict[str, str]:
    """language -> sample text, of labelled rows (id, lang, text): bounded in documents and characters."""
    keys = labelled.where("lang is not null and text is not null").select("id", "lang", "text", F.xxhash64("id", "text").alias("h"))
    ranked = keys.select("h", "lang").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= SAMPLE_DOCS)
    ranked = cut(ranked, "sample")
    docs = min(SAMPLE_DOCS, max(LEAST_DOCS, ALL_DOCS // max(1, ranked.where("r = 1").count())))
    picked = keys.join(F.broadcast(ranked.where(F.col("r") <= docs).select("h", "lang")), ["h", "lang"])  # ALL_DOCS rows, or LEAST_DOCS for each label
    rows = picked.select("lang", "h", F.substring("text", 1, DOC_CHARS).alias("text")).distinct().orderBy("lang", "h").collect()
    out: dict[str, str] = {}
    for row in rows:
        out[row["lang"]] = out.get(row["lang"], "") + " " + row["text"]
    return out


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The suffix automaton of the symbols as a table (state, symbol) -> state; 0 is no state, 1 the start."""
    table, link, length = array("i", bytes(8 * width * (len(symbols) + 2))), [0, 0], [0, 0]  # two states a symbol at most
    last = 1
    for c in symbols:
        now = len(link)
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and not table[p * width + c]:
            table[p * width + c] = now
            p = link[p]
        if p:
            q = table[p * width + c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(link)
                table[twin * width : (twin + 1) * width] = table[q * width : (q + 1) * width]
                link.append(link[q])
                length.append(length[p] + 1)
                while p and table[p * width + c] == q:
                    table[p * width + c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return np.frombuffer(table, np.int32)[: len(link) * width].reshape(-1, width).copy()


class Parser:
    """The automata of all languages in one table, and the parsing of many texts at once."""

    def __init__(self, samples: dict[str, str], chars: int = SAMPLE_CHARS) -> None:
        self.names = sorted(samples)
        letters = [c for c, _ in sorted(Counter(c for name in self.names for c in samples[name].lower() if c.isalpha()).items(), key=lambda x: (-x[1], x[0]))]
        single = letters if len(letters) <= ALPHABET else letters[:SINGLE]
        symbol = {c: (i + 2,) for i, c in enumerate(sorted(single))}
        rare = letters[len(single) :]
        digits = 2 if len(rare) <= DIGITS**2 else 3
        symbol |= {c: tuple(len(single) + 2 + i // DIGITS**d % DIGITS for d in range(digits)[::-1]) for i, c in enumerate(rare)}
        self.width = len(single) + 2 + (DIGITS if rare else 0)
        self.of, self.more = np.zeros(0x110000, np.uint8), np.zeros((0x110000, digits - 1), np.uint8) if rare else None
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                written = symbol.get(low[0] if low else c, (OTHER,))
                self.of[code] = written[0]
                if len(written) > 1:
                    self.more[code] = written[1:]
        chars = min(chars, max(LEAST_CHARS, ALL_CHARS // max(1, len(self.names))))
        tables, self.log_size, at = [], [], 0
        self.start = []
        for name in self.names:
            text = self.symbols(samples[name])[:chars]
            table = automaton(text.tolist(), self.width)
            self.start.append(at + 1)
            self.log_size.append(np.log2(max(2, len(text))))
            tables.append(np.where(table > 0, table + at, 0))
            at += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(self.width, np.int32)
        del tables

    def symbols(self, text: str) -> np.ndarray:
        """Letters with single spaces between and at the ends, so that whole words match as such; nothing of a text without letters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.of[codes]
        if self.more is not None:
            written = np.concatenate([found[:, None], self.more[codes]], axis=1)
            written_at = written > 0
            written_at[:, 0] = True
            found = written[written_at]
        found = np.pad(found, 1)
        return spaced(found, found > 0)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language): phrases of each text's stretches."""
        total = np.zeros((len(texts), len(self.names)), np.int64)
        pieces = [(i, at, min(STRETCH, len(t) - at)) for i, t in enumerate(texts) for at in range(0, len(t), STRETCH)]
        for lo in range(0, len(pieces), max(1, LANES // max(1, len(self.names)))):
            part = sorted(pieces[lo : lo + max(1, LANES // max(1, len(self.names)))], key=lambda p: -p[2])
            sizes = np.array([p[2] for p in part])
            grid = np.zeros((len(part), sizes[0]), np.uint8)
            for row, (i, at, n) in enumerate(part):
                grid[row, :n] = texts[i][at : at + n]
            owner = np.array([p[0] for p in part])
            grid = np.ascontiguousarray(grid.T)
            live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # rows longer than each step
            for k, start in enumerate(self.start):
                root = self.table[start * self.width : (start + 1) * self.width]
                fresh = np.where(root > 0, root, start).astype(np.int32)
                state, count = np.full(len(part), start, np.int32), np.ones(len(part), np.int64)
                for step in range(sizes[0]):
                    n = live[step]
                    symbols = grid[step, :n]
                    after = self.table[state[:n] * np.int64(self.width) + symbols]
                    miss = after == 0
                    if step:  # a symbol that the language doesn't have is a phrase by itself
                        count[:n] += miss | (state[:n] == start)
                    state[:n] = np.where(miss, fresh[symbols], after)
                np.add.at(total[:, k], owner, count)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and the winning cross entropies in bits a symbol."""
        symbols = [self.symbols(t) if t else np.empty(0, np.uint8) for t in texts]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        bits = self.phrases(symbols) * np.array(self.log_size) / np.maximum(1, [len(s) for s in symbols])[:, None]
        best = bits.argmin(1)
        first = bits[np.arange(len(texts)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if len(self.names) > 1 else 2 * first
        known = np.array([len(s) > 0 for s in symbols], bool)
        score = np.where(known, second / np.maximum(first + second, 1e-12), 0.0)
        return [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)], score.tolist(), np.where(known, first, 0.0).tolist()


def spaced(symbols: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Each run between letters as its last place; symbols begin and end with a space."""
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    out = symbols[keep]
    return np.append(out, np.uint8(SPACE)) if len(out) else out


def parser_of(samples: dict[str, str]) -> Parser:
    """Built once a worker from the samples, which are small enough to go with each task."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    return held(key, lambda: Parser(samples))


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of the id as text leaves 2 over 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """The samples of the labelled rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return sample_texts(rows.where(~held_out(F.col("id"))))


def annotate(rows: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """The rows as they are, followed by the predicted language, its score and the bits a symbol of their texts, under the names lang_pred_, score_ and bits_ or, where rows have such columns, with more underscores."""
    small_batches(rows.sparkSession, 2)
    names_of = unused(rows, *ADDED)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = [parser.predict(texts[lo : lo + 512]) for lo in range(0, len(texts), 512)]
            names, scores, bits = ([x for part in found for x in part[i]] for i in range(3))
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names_of])

    schema = StructType([*rows.schema.fields, *(StructField(name, kind) for name, kind in zip(names_of, (StringType(), DoubleType(), DoubleType()), strict=True))])
    return rows.mapInArrow(predicted, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) of every row, learned from those that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = annotate(rows, fitted(docs, id_col, text_col, lang_col))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lang_pred_").alias("lang_pred"), F.col("score_").alias("score"), F.col("bits_").alias("bits"))
