import hashlib

import numpy as np
import pytest

from tidemark.llm.sentence_pieces import PieceCodec, decode_documents, encode_documents, piece_digests

TEXTS = [
    "", None, " ", "   three spaces", "trailing   ", "\n\t", "The cat sat on the mat.", "naïve façade, œuvre; ça va?", "日本語のテキスト", "текст", "😀👩‍👩‍👧", "a\x00b",
    "▁ ▁▁", "<s> </s> <unk> <0x41>", "x².y _².a", "can't won't l'été", "http://a.b/c?d=e&f=g", "{}[]()<>!=;:,.'\"", "0123456789 3.14e-10", "tab\tand\r\nline", "AbCdEfGhIjKlMnOp",
]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec()


def library(codec, text):
    return np.array(codec.library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


def test_pieces_equal_the_library(codec):
    rng = np.random.default_rng(3)
    signs = list("abcdefghinorst  ▁\n\t.,é語²_'0") + ["ing", " the", "tion", "😀", "<s>"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(signs, rng.integers(0, 120))) for _ in range(1500)]
    codes = np.concatenate([np.arange(1, 0xD800), np.arange(0xE000, 0x110000)])
    texts += ["".join(map(chr, rng.choice(codes, 60))) for _ in range(200)]
    for t in texts:
        assert codec.encode(t) == library(codec, t), repr(t)


def test_very_long_runs(codec):
    for t in ("a" * 200_000, " " * 5_000, "ab" * 50_000, "é" * 20_000, "thewhingand" * 10_000):
        assert codec.encode(t) == library(codec, t)


def test_backtracking_fails_places_and_agrees_with_merging(codec):
    for t in ("▁abababab", "▁ereereth", "▁ndereationsst", "▁stststing", "▁wherereason"):
        assert [codec.text_of[i] for i in codec.pieces(t)] == codec.merged(t)
    forgetful = PieceCodec(memory=3)
    for t in TEXTS:
        assert forgetful.encode(t or "") == library(codec, t or "")


def test_digests_and_round_trip(spark, codec):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = piece_digests(docs).collect()
    assert len(out) == len(rows)
    want = []
    for i, t, _ in rows:
        ids = library(codec, t or "")
        decoded = codec.library.decode(np.frombuffer(ids, "<u4").tolist())
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    back = {(r.doc_id, r.text) for r in decode_documents(encode_documents(docs)).collect()}
    assert back == {(i, codec.library.decode(np.frombuffer(library(codec, t or ""), "<u4").tolist())) for i, t, _ in rows}


def test_empty_table(spark):
    assert piece_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
