"""The pipeline stage by stage, against what each operator says of its own input."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_texts import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    texts = {"en": "the house of the water and this is with that from", "de": "das haus und das wasser ist nicht von der mit"}
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        words = texts[lang].split()
        rows.append((i, " ".join(words[(i * k + k) % len(words)] for k in range(30)) + f" n{i}", lang, f"src{i % 3}", 0))
    rows += [(100, rows[0][1], "en", "src0", 0), (101, rows[1][1] + " more", "de", "src1", 0), (102, "!!! 12", "en", "src0", 0), (103, None, None, None, None), (5, rows[5][1], "de", "src2", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "")
        kept = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            assert {r.doc_id for r in before.collect()} - kept == {102, 103}
        elif name == "jaccard_join":
            groups = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted({d for d, _, c in groups if d == c})
            assert {100, 101} & kept == set()
        elif name == "source_mixing":
            assert kept < {r.doc_id for r in before.collect()} and len(kept) == docs.count()
        if name != "sentencepiece":
            assert docs.columns == before.columns
    texts, model = {r.doc_id: r.text for r in before.collect()}, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.ids == model.encode(texts[r.doc_id]) and r.round_trip for r in docs.collect())


def test_columns_of_the_same_names(spark, docs):
    names = ["lang_pred_", "score_", "bits_", "pick_", "domain_", "Language_", "source_", "times_", "whole_", "last_", "comp", "key", "said_"]
    odd = docs.selectExpr("*", *[f"doc_id * 0.5 as {x}" for x in names])
    for name, stage in corpus_pipeline.STAGES:
        plain, odd = stage(spark, docs, ""), stage(spark, odd, "")
        assert sorted(plain.select("doc_id").collect(), key=str) == sorted(odd.select("doc_id").collect(), key=str)
        if name != "sentencepiece":
            assert odd.columns == [*plain.columns, *names]
            assert odd.where("domain_ is distinct from doc_id * 0.5 or bits_ is distinct from doc_id * 0.5 or pick_ is distinct from doc_id * 0.5").count() == 0
        docs = plain


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_texts_that_share_an_id(spark):
    """One document of each group stays, whatever ids its texts have."""
    first, second, third, fourth = (" ".join(f"{word}{i}" for i in range(30)) for word in ("a", "b", "c", "d"))
    rows = [(1, first), (7, first), (7, second), (8, second + " more"), (9, third), (9, fourth), (9, fourth + " x y"), (10, third.upper()), (10, third.upper()), (11, ""), (11, ""), (None, first)]
    rows += [(12, "e " + first[::-1]), (12, "e " + first[::-1].upper())]
    docs = spark.createDataFrame([(d, t, "en", "s", i) for i, (d, t) in enumerate(rows)], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.join_near_copies(spark, docs, "").collect()), key=str)
    ids = [d for d, _ in kept]
    assert {(1, first), (7, second), (9, third), (None, first)} <= set(kept) and (7, first) not in kept
    assert sorted(ids, key=str) == sorted([1, 7, 9, 9, 11, 12, None], key=str)
