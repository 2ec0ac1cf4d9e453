"""Operators 3, 4 and 8 against the libraries."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewright.llm import token_files
from tidewright.llm.piece_lattice import MARK, Chunk, Lattice, boundary_states, compose, loaded
from tidewright.llm.pretokens import Pretokens
from tidewright.llm.sentencepiece_scan import decode, encode
from tidewright.llm.token_counts import token_counts

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, ids string"
TEXTS = ["", None, " ", "  lead  and   gaps \n\n\t x", "it's we'll  I'd", "a<|endoftext|>b  <|endoftext|>  c", "日本語テキスト🎉🎉   é²½", "x" * 3000, "The and 123 of 4,567... !!! ## " * 300, "a\u0085b\x1cc   d", "▁▁a▁b", "same", "same"]
ROWS = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "", ""), (3, "again", "", "")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def ids_by_library(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pretokens_over_all_kinds_of_characters(library):
    pre = Pretokens(JSON)
    for code in [*range(0x3100), *range(0x3100, 0x110000, 193)]:
        if not 0xD800 <= code < 0xE000:
            text = f"a {chr(code)}b {chr(code)}{chr(code)} 1{chr(code)}"
            assert pre.ids_of(pre.pretokens(text))[0].tolist() == ids_by_library(library, text)


def test_counts(spark, library):
    found = token_counts(spark.createDataFrame(ROWS, SCHEMA), JSON, 100).collect()
    expect = [(i, len((t or "").encode()), n := len(ids_by_library(library, t)), n > 100) for i, t, *_ in ROWS]
    assert sorted(map(tuple, found), key=str) == sorted(expect, key=str)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = {tuple(r)[::2] for r in token_counts(spark.createDataFrame(ROWS, SCHEMA), MODEL, 100).collect()}
    assert pieces == {(i, len(model.encode(t or ""))) for i, t, *_ in ROWS}
    assert token_counts(spark.createDataFrame([], SCHEMA), JSON, 100).count() == 0


@pytest.mark.parametrize("width", [1, 7, 11, 16, 17, 32])
def test_packing_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    sizes = [0, 5, 1, 300, 0, 77]
    ids = rng.integers(0, 2**width, sum(sizes), dtype=np.uint64).astype(np.uint32)
    data = b"".join(token_files.file_bytes([None, 4, 5, 6, 7, 9], sizes, ids, width, per_block=50))
    assert len(data) <= 57 + 24 * 6 + 8 * 9 + 8 + (len(ids) * width) // 8 + 8
    file = token_files.TokenFile(io.BytesIO(data))
    starts = np.r_[0, np.cumsum(sizes)]
    for place in (3, 0, 5, 1, 2, 4):
        assert file.document(place).tolist() == ids[starts[place] : starts[place + 1]].tolist()
    assert file.doc_is_null.tolist() == [True] + [False] * 5 and file.ids(0, len(ids)).tolist() == ids.tolist()


def test_files(spark, library, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    manifest = token_files.write_files(docs, str(tmp_path / "out"), JSON, 2, 4, per_block=64)
    found = token_files.read_files(manifest, str(tmp_path / "out")).collect()
    rows = {}
    for r in found:
        rows.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    expect = {}
    for i, t, *_ in ROWS:
        ids = ids_by_library(library, t) + [2]
        expect.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted(v) for k, v in expect.items()}
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    empty = token_files.write_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), JSON, 2, 2)
    assert token_files.read_files(empty, str(tmp_path / "none")).count() == 0


def chunked(lattice, whole, size, combine):
    n, reach = max(1, -(-len(whole) // size)), lattice.longest
    chunks = [Chunk(lattice, whole[max(0, i * size - reach) : i * size], whole[i * size : (i + 1) * size], whole[(i + 1) * size : (i + 1) * size + reach], i == 0, i == n - 1) for i in range(n)]
    transfers = [c.transfer() for c in chunks]
    if combine:  # by halves, then down again: as a tree
        half = max(1, n // 2)
        ends = [transfers[:half], transfers[half:]] if n > 1 else [transfers]
        tops = []
        for part in ends:
            total = part[0]
            for t in part[1:]:
                total = compose(total, t)
            tops.append(total)
        middle = boundary_states(tops)
        states = [middle[0]]
        for part, come, go in zip(ends, middle, middle[1:], strict=False):
            states += boundary_states(part, come, go)[1:]
    else:
        states = boundary_states(transfers)
    return [x for c, a, b in zip(chunks, states, states[1:], strict=False) for x in c.backtrace(a, b)]


def test_chunks_of_any_size_give_the_models_ids():
    lattice, rng = loaded(MODEL), random.Random(1)
    texts = [t for t in TEXTS if t] + ["abcdefghijklmnopqrstuvwxyz" * 9, "".join(rng.choice("abcde ▁é🎉") for _ in range(300)), "".join(rng.choice("thequickbrownfox") for _ in range(300))]
    for text in texts:
        text = text[:400]
        for size in (1, 5, 23, 200):
            assert chunked(lattice, MARK + text.replace(" ", MARK), size, size == 23) == lattice.model.encode(text), (text[:20], size)


def test_weighted_lattice_gives_the_best_segmentation():
    rng = random.Random(2)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "bca", "▁", "▁a", "▁ab", "aab"]
    lattice = Lattice({p: (i, -rng.uniform(1, 6)) for i, p in enumerate(pieces)}, list(range(100, 356)), False)

    def best(text):
        table = [(0.0, [])]
        for end in range(1, len(text) + 1):
            table.append(max((table[at][0] + lattice.scores[text[at:end]][1], table[at][1] + [lattice.scores[text[at:end]][0]]) for at in range(end) if text[at:end] in lattice.scores))
        return table[-1][0]

    for _ in range(60):
        text = "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 40)))
        for size in (4, 9):
            ids = chunked(lattice, text, size, False)
            assert "".join(pieces[i] for i in ids) == text
            assert sum(lattice.scores[pieces[i]][1] for i in ids) == pytest.approx(best(text))


def test_encoding_and_decoding(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*ROWS, (2**60 + 1, "The long one " * 90, "", ""), (2**60 + 1, "The long one " * 90, "", ""), (None, "y" * 700, "", "")]
    ids = encode(spark.createDataFrame(rows, SCHEMA), MODEL, ["doc_id", "n_tokens"], giant=200, chunk=32, fan=3)
    expect = sorted((str(i), model.encode(t or "")) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in ids.collect()) == expect
    for decoded in (ids, decode(ids.drop("decoded_"), MODEL)):  # chunk by chunk, and by the library
        texts = decoded.select("doc_id", "decoded_").collect()
        assert sorted((str(r.doc_id), r.decoded_) for r in texts) == sorted((str(i), (t or "").replace(MARK, " ")) for i, t, *_ in rows)
    assert encode(spark.createDataFrame([], SCHEMA), MODEL, ["doc_id"]).count() == 0
