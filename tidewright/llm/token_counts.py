"""Operator 3, token counts from distinct pre-tokens.

Each task splits its documents into pre-tokens, has the library count the pieces of each distinct pre-token once, joins those counts
to the documents' pre-token frequencies and sums. No token ids of a document are ever held. A join over the whole corpus would send
every (document, pre-token) pair through a shuffle, more bytes than the texts themselves, so the join stays within the task.

Cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as the one token the library makes of
them; long texts are never cut; null ids and repeated rows are rows like others; an empty table
gives no rows; other columns are not looked at. SentencePiece models take their words, as led by a space, for pre-tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame

from tidewright.llm.common import small_batches
from tidewright.llm.pretokens import REMEMBERED, Remembered, counted

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class WordCounts:
    """Pieces of each distinct run of spaces and word of a SentencePiece model whose pieces never run from a word into a space."""

    def __init__(self, path: str) -> None:
        import regex
        import sentencepiece

        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=path), {}
        self.split = regex.compile(" *[^ ]+| +").findall

    def count(self, text: str) -> int:
        if not text:
            return 0
        frequencies = Counter(self.split(" " + text))
        new = [x for x in frequencies if x not in self.known]
        # the model puts a space before what it encodes; the word brings its own, so one is taken off
        self.known.update(zip(new, map(len, self.model.encode([x[1:] for x in new], num_threads=1)), strict=True))
        self.known[" "] = 1  # a single space at the end is a piece, and there is no text whose own it would be
        total = sum(n * self.known[x] for x, n in frequencies.items())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return total


class PieceCounts:
    def __init__(self, path: str) -> None:
        self.remembered = Remembered(path, counted)

    def count(self, text: str) -> int:
        frequencies = Counter(self.remembered.pre.pretokens(text))
        return sum(map(mul, self.remembered.of(list(frequencies)), frequencies.values()))


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text. tokenizer: the path of a .json or .model file, the same on every machine."""

    small_batches(docs.sparkSession)

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = WordCounts(tokenizer) if tokenizer.endswith(".model") else PieceCounts(tokenizer)
        for frame in frames:
            texts = frame["text_"].fillna("")
            tokens = [counts.count(x) for x in texts]
            yield pd.DataFrame({"doc_id": frame["id_"], "n_bytes": [len(x.encode()) for x in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]})

    return docs.selectExpr(f"cast({id_col} as long) as id_", f"{text_col} as text_").mapInPandas(of_frames, SCHEMA)
