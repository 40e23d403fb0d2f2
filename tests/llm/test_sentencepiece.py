"""The agenda against the sentencepiece library."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import sentencepiece_bpe as pieces
from lexspan.llm.queries import op13_sentencepiece, piece_model_path

ODD = [None, "", " ", "a", "  a ", "▁", "naïve 漢字 ☂\x1c\x85\xa0 <s></s><unk><0x41> 12³²½", "x" * 5000, "ab" * 3000, " " * 3000, "漢字" * 900, "\r\n\t  \n", "a\x00b", "﻿", "²." * 400]
LETTERS = [*"abc  dehimrst'lv.,!?019\n\t_", "é", "ü", "\x1c", "\x85", "\xa0", "漢", "😀", "́", "²", "½", "<s>", "▁", "    ", "न", "ा", "�", "the ", "ing", "İ"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "src", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, ids string, decoded double")


def test_rows_are_the_library(spark, library, tmp_path):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(600)), "same", "same"]
    coded = pieces.encode_decode(frame(spark, texts), piece_model_path())
    for r in coded.collect():
        want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want)
    assert pieces.agreement(coded, piece_model_path()).first().asDict() == {"checked": len(texts), "differing": 0}
    wrong = coded.withColumn("decoded", F.concat("decoded", F.lit("!")))
    assert pieces.agreement(wrong, piece_model_path()).first().differing == len(texts)
    back = pieces.decode(coded.select("doc_id", "ids"), piece_model_path())
    assert {r.doc_id: r.decoded for r in back.collect()} == {r.doc_id: r.decoded for r in coded.collect()}
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_sentencepiece(spark, str(tmp_path)).collect():
        want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        raw = np.array(want, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest())


def test_no_rows(spark):
    none = pieces.encode_decode(frame(spark, ["x"]).limit(0), piece_model_path())
    assert none.collect() == [] and pieces.agreement(none, piece_model_path()).first().asDict() == {"checked": 0, "differing": 0}


def test_any_ids_decode_alike(library):
    model = pieces.model(piece_model_path())
    rng = random.Random(2)
    some = [0, 1, 2, 259, 260, 261, 262, 35, 68, 229, 153, 132]
    for _ in range(5000):
        ids = [rng.choice([*some, rng.randint(3, 258), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 7))]
        assert model.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        model.decode([32_000])


def test_cuts_and_ends(library):
    model = pieces.model(piece_model_path())
    for text in ["x = (foo).bar(\"a\\nb\")  # why?\n\n\t" * 20, "Straße, naïve; e.g. 3.14²."]:
        assert model.encode(text, False, False) == library.encode(text)
    whole = pieces.word_pattern({"a▁", "ab"})
    assert whole.findall("a b\nc") == ["a b\nc"], "a vocabulary with marks inside its pieces is not cut"
    assert re.fullmatch(pieces.word_pattern({"²."}).pattern, "a") and pieces.word_pattern({"²."}).findall("a².") == ["a", "²."]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(piece_model_path(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    path = tmp_path / "other.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="merge type"):
        pieces.PieceModel(str(path))
