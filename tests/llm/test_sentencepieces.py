import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from foliant.llm.sentencepieces import Pieces, decode, digest, encode, op6_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
OURS = Pieces(PATH)
THEIRS = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(text):
    assert OURS.encode(text) == THEIRS.encode(text)
    assert OURS.decode(OURS.encode(text)) == text.replace("▁", " ")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abtheinr  \n\t▁1.é😀\x00"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_librarys(text):
    check(text)


def test_letters_that_merge_a_lot():
    r = random.Random(1)
    pieces = [p for p in OURS.normal if len(p) > 2]
    for _ in range(3000):
        check("".join(r.choice(pieces).replace("▁", " ") for _ in range(r.randint(1, 5)))[: r.randint(1, 40)])
        check("".join(r.choice("aehnt") for _ in range(r.randint(1, 30))))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in op6_sentencepiece(spark, sf).collect()}
    assert len(got) == len(rows)
    for d in rows:
        ids = THEIRS.encode(d.text)
        assert tuple(got[d.doc_id])[1:] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_every_case(docs, none):
    for r in decode(encode(docs, PATH, name="tokens"), PATH, "tokens").collect():
        assert r.tokens == THEIRS.encode(r.text or "") and r.decoded == (r.text or "")
    assert digest(docs, PATH).where("round_trip").count() == docs.count()
    mine = encode(docs.withColumn("n_ids", docs.score), PATH)
    assert {r.ids for r in mine.collect()} == {"i"} and all(r.ids_ == THEIRS.encode(r.text or "") for r in mine.collect())
    assert {(r.n_ids, r.round_trip) for r in digest(docs.withColumn("n_ids", docs.score), PATH).collect()} == {(1, True)}
    assert encode(none, PATH).count() == digest(none, PATH).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_a_unigram_model(tmp_path, fallback):
    """The same pieces as a unigram model, against the library's own Viterbi."""
    r = random.Random(3)
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = fallback
    for p in model.pieces:
        if p.type == 1:
            p.score = -4.0 - r.random() * 2 - (3 if len(p.piece) == 1 else 0)
        elif p.type == 6 and not fallback:
            p.type = 5
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    ours, theirs = Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for _ in range(300):
        text = "".join(r.choice(["th", "e", "ing ", " ", "é", "😀", "中", "\n", "on", "er"]) for _ in range(r.randint(0, 25)))
        assert ours.encode(text) == theirs.encode(text)
