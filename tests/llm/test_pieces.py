"""SentencePiece coding against the library, which it has to equal."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tracewright.llm import pieces

PARTS = ["  ", " ", "a", "e", "t", "the", "\n", "\t", "é", "▁", "0", "_", "-", "==", "Ā", "梦", "😀", "\0", "�", "​", "ing", "    ", "'", "<s>", "<0x0A>", "</s>", "//", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(public_tokenizers.path(pieces.MODEL))


def test_random_texts(library, coder):
    rng = random.Random(11)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(4000)]
    texts += [unit * n for unit in (" ", "a", "=", "ab", "-\n", "▁a") for n in (1, 2, 3, 7, 16, 17, 33, 500)]
    for text in texts:
        ids = coder.encode(text)
        assert ids.tolist() == library.encode(text)
        assert coder.decode(ids) == library.decode(ids.tolist())


def test_decode_any_ids(library, coder):
    """Also such that no text encodes to: lone and broken bytes, control pieces, unknown ones."""
    rng = random.Random(12)
    for _ in range(4000):
        ids = [rng.choice((rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3))) for _ in range(rng.randrange(12))]
        assert coder.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_small_caches(library, monkeypatch):
    """What is remembered changes no result."""
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 5)
    small = pieces.Coder(public_tokenizers.path(pieces.MODEL))
    text = "the quick brown fox, jumped over the lazy dogs;  again and again\n" * 5
    assert small.encode(text).tolist() == library.encode(text)


def test_backtracking_frees_failed_positions(library, coder):
    """Words on which the longest match leads astray."""
    long = "xunnecessarilyunbelievablereconsiderationsteststs" * 400
    assert coder.encode(long).tolist() == library.encode(long)


def test_rows(spark, documents, corpus, library):
    got = {r.doc_id: r for r in pieces.packed(documents).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert (got[i].n_tokens, got[i].decoded) == (len(ids), library.decode(ids))
    assert pieces.packed(documents.limit(0)).count() == 0


def test_encode_then_decode(spark, library):
    rows = [(None, "one  two\nthree"), (1, None), (1, ""), (2, "né 梦 \U0001f600")]
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, ids string, decoded int")
    got = {(r.doc_id, r.decoded): r.ids for r in pieces.decode(pieces.encode(docs)).collect()}
    assert got == {(i, t or ""): library.encode(t or "", add_bos=True, add_eos=True) for i, t in rows}


def test_other_models_are_refused(tmp_path):
    (tmp_path / "empty.model").write_bytes(b"")
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Model(str(tmp_path / "empty.model"))
