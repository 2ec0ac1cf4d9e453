"""Operator 11 against the libraries and a sweep by hand."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewright.llm import token_alignment
from tidewright.llm.token_alignment import MARK, align, byte_of_character

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, h string, n_a string"
TEXTS = ["", None, " ", "  lead  and   gaps \n\n\t x", "it's we'll  I'd", "a<|endoftext|>b  </s> <s> <0x41>", "日本語テキスト🎉🎉   é²½", "x" * 3000, "The and 123 of 4,567... !!! ## " * 300, "a\u0085b\x1cc   d", "▁▁a▁b", "a▁", "same words", "same words", "the the the", "\x00 nul", "ﬁ ½ Å é"]
ROWS = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "", ""), (None, "no id", "", ""), (3, "again the", "", ""), (4, "it's we'll  I'd", "", "")]


def brute(rows):
    """The contract word by word, token occurrences as byte ranges."""
    a, b, byte = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL), byte_of_character()
    a.encode_special_tokens = True
    found = []
    for i, text, *_ in rows:
        sides = [[], []]
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            data = [[bytes(byte[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([int(b.id_to_piece(x)[3:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace(MARK, " ").encode() for x in ids[1]]]
            if all(b"".join(d) == (" " + text).encode() for d in data):
                for side, these, d in zip(sides, ids, data, strict=True):
                    at = 0
                    for x, piece in zip(these, d, strict=True):
                        side.append((x, at, at + len(piece)))
                        at += len(piece)
        shared = sorted({x[2] for x in sides[0]} & {x[2] for x in sides[1]})
        groups = [[[x[0] for x in side if lo < x[2] <= hi] for side in sides] for lo, hi in zip([0, *shared], shared, strict=False)]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        links = [(x[0], y[0]) for x in sides[0] for y in sides[1] if x[1] < y[2] and y[1] < x[2]]
        found.append((i, len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    counts = Counter(pair for *_, links, _ in found for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(((*f[:4], len(f[4]), sum(counts[p] == best[p[0]] for p in f[4]), sum(counts[p] for p in f[4]), f[5]) for f in found), key=str)


@pytest.mark.parametrize("sizes", [{}, {"stretch": 40, "block": 7, "window": 16}, {"block": 3, "window": 1, "few": 0}])
def test_alignment_is_the_brute_force_one(spark, sizes):
    rows = [r for r in ROWS if len(r[1] or "") < 1000 or not sizes or sizes["block"] == 7]
    found = align(spark.createDataFrame(rows, SCHEMA).repartition(3), JSON, MODEL, 3, **sizes)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], SCHEMA), JSON, MODEL, 2).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 4000").collect()]
    found = align(spark.createDataFrame(rows, "doc_id long, text string"), JSON, MODEL, 4, stretch=500, block=100, window=3000)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_what_is_forgotten_is_learned_again(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 5)
    monkeypatch.setattr(token_alignment, "KEPT", 2)
    side = token_alignment.Side(MODEL)
    texts = [" one two three", " four five six", " a▁b", " one two three", " a▁b"]
    found = [side.ids([t])[0] for t in texts]
    assert [None if x is None else x.tolist() for x in found] == [None if MARK in t else side.of.model.encode(t[1:]) for t in texts]
