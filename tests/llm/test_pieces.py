"""SentencePiece ids and texts against the library itself."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from orrery.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(library, text):
    return np.array(library.encode(text or "", add_bos=True, add_eos=True), "<u4").tobytes()


def test_every_document_is_encoded_and_decoded_as_by_the_library(spark, data, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, data).collect()}
    want = {}
    for r in pd.read_parquet(f"{data}/documents.parquet").itertuples():
        x = ids(library, r.text)
        back = library.decode(np.frombuffer(x, "<u4").tolist())
        want[r.doc_id] = (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert got == want


def test_odd_documents(spark, odd, empty, library):
    rows = pieces.encode(odd, PATH).collect()
    want = sorted(((r.doc_id, ids(library, r.text)) for r in odd.collect()), key=str)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in rows), key=str) == want
    assert pieces.report(pieces.encode(empty, PATH), PATH).count() == 0
    clash = odd.selectExpr("*", "text as ids", "doc_id as decoded", "1 as n_tokens")
    assert pieces.report(pieces.encode(clash, PATH), PATH).count() == odd.count()


def test_decode_keeps_other_columns_and_takes_null(spark):
    df = spark.createDataFrame([(7, None, "x"), (7, bytearray(np.array([1, 263, 2], "<u4").tobytes()), None)], "doc_id long, ids binary, own string")
    got = pieces.decode(df, PATH)
    assert got.columns == ["doc_id", "own", "decoded"]
    assert [tuple(r) for r in got.collect()] == [(7, "x", ""), (7, None, library_text([1, 263, 2]))]


def library_text(x):
    return sentencepiece.SentencePieceProcessor(model_file=PATH).decode(x)


def test_random_texts_and_ids(library):
    """Ties of blanks, bytes, names of special pieces in the text, and ids that no text has."""
    encoder, draw = pieces._encoder(PATH), random.Random(1)
    letters = [*"ab \n\t▁éñ日本😀\x00́ſ", " the", "in", "  ", "    ", " " * 17, "▁▁", "=", "==", "\xa0", "</s>", "<0x41>"]
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        x = encoder.ids(text)
        assert x == ids(library, text)
        assert encoder.model.decode(np.frombuffer(x, "<u4").tolist()) == library.decode(np.frombuffer(x, "<u4").tolist())
        odd = [draw.randrange(32_000) if draw.random() < 0.5 else draw.randrange(262) for _ in range(draw.randint(0, 12))]
        assert encoder.model.decode(odd) == library.decode(odd)


def test_long_texts_take_linear_steps(library):
    for text in ("a" * 200_000, " " * 100_000, "ab" * 100_000, "x" + "=" * 100_001, "日本" * 50_000):
        assert pieces._encoder(PATH).ids(text) == ids(library, text)


def test_backtracking_against_the_merges_themselves():
    """On a chunk, tokens are what merging the whole chunk gives; the longest piece alone is wrong for some."""
    model, draw, greedy = pieces.Model(PATH), random.Random(5), 0
    for _ in range(400):
        chunk = "▁" + "".join(draw.choice("etaoinshr") for _ in range(draw.randint(1, 14)))
        want = model.merged(chunk)
        got = np.frombuffer(model.encode(chunk), "<u4").tolist()
        assert b"".join(model.written[model.text.index(t)] for t in want) == np.array(got, "<u4").tobytes()
        longest = max((t for t in model.score if chunk.startswith(t)), key=len)
        greedy += longest != want[0]
    assert greedy


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = schema.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="merge type"):
        pieces.Model(str(tmp_path / "m"))
