import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import packing
from foliant.llm.packing import WordEncoder, best_fit, op4_best_fit_packing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


_encoder = WordEncoder(PATH)
_whole = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sTΣ́ͅ \n\t\x0b\x1c\x85\xa0 <|endoftext|>9é"), st.characters(codec="utf-8")), max_size=40))
def test_word_by_word_is_whole_text(text):
    want = _whole.encode(text, add_special_tokens=False).ids
    for e in (_encoder, WordEncoder(PATH)) if len(text) > 30 else (_encoder,):  # with and without words seen before
        assert np.frombuffer(e([text.encode(), b"x", text.encode()])[0], "<u4").tolist() == want


def test_best_fit_is_best_fit():
    r = random.Random(2)
    items = [r.randint(1, 50) for _ in range(300)]
    bins, fill = best_fit(items, 50)
    rooms = []
    for n, b in zip(items, bins):
        fits = [x for x in rooms if x >= n]
        if fits:
            assert rooms[b] == min(fits)
            rooms[b] -= n
        else:
            assert b == len(rooms)
            rooms.append(50 - n)
    assert fill == [50 - x for x in rooms]


@pytest.mark.parametrize("parts,capacity", [(1, 4096), (3, 64), (20, 64)])
def test_pieces_and_sequences(docs, texts, tokenizer, parts, capacity):
    rows = pack(docs.repartition(parts), PATH, capacity=capacity).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    copies = {3: 3}
    for d, t in [*enumerate(texts), (None, "one two")]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want = []
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want += [(k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] * copies.get(d, 1)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == sorted(want)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(by_seq) <= least * 1.05 + 2


def test_no_documents(none):
    assert pack(none, PATH).count() == 0


def test_open_bins_never_meet_in_one_task(spark, tmp_path, monkeypatch):
    """Pieces of over half a sequence: no two go together, so the tree ends where partitions can't get fewer."""
    docs = spark.createDataFrame([(k, "a " * 40) for k in range(256)], "doc_id long, text string").repartition(16)
    most = []
    plain = packing.written
    monkeypatch.setattr(packing, "written", lambda df: (most.append(max(r["n"] for r in df.groupBy(packing.F.spark_partition_id()).agg(packing.F.count("*").alias("n")).collect())), plain(df))[1])
    rows = pack(docs, PATH, capacity=64, task_bins=32).collect()
    assert len({r.sequence_id for r in rows}) == 256 and max(most) < 96


def test_query_against_one_best_fit(spark):
    """The query's pieces, and about as few sequences as one best fit over all pieces takes."""
    sf = "/root/testdata/sf0.01"
    rows = op4_best_fit_packing(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = Tokenizer.from_file(PATH)
    want = []
    for d, t in docs.items():
        ids = whole.encode(t, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    _, fill = best_fit(sorted((w[3] for w in want), reverse=True), 4096)
    assert len({r.sequence_id for r in rows}) <= len(fill) * 1.02 + 1
