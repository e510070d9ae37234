import hashlib
import random

import numpy as np
import pytest

from foliant.llm.dedup import op5_suffix_array_dedup, remove_repeats
from foliant.llm.suffixes import common_prefixes, merge_shards, repeats, suffix_array


def plain(rows, length):
    """{(id, text): removed spans}; rows of equal id and text are one document."""
    import zlib

    order = lambda r: (-(2**63) if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()))
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=order):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
        out[d, t] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out


def compare(df, length=100, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want, got = plain(rows, length), remove_repeats(df, length=length, **options).select("doc_id", "text", "dedup.*").collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s.start, s.end) for s in r.spans]
        assert spans == want[r.doc_id, r.text], (r.doc_id, length)
        raw = (r.text or "").encode()
        assert r.raw == raw and r.kept == b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))


def test_every_case(docs, none):
    compare(docs)
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("length,shard,part", [(100, 1 << 20, 4096), (40, 1 << 20, 3), (100, 700, 4096), (64, 200, 2), (100, 900, 5)])
def test_random_passages(spark, length, shard, part):
    r = random.Random(length + shard)
    chars = "ab é"
    bits = ["".join(r.choice(chars) for _ in range(r.randint(20, 250))) for _ in range(12)] + ["ab" * 80, "a" * 150]
    texts = []
    for _ in range(80):
        t = "".join(r.choice(bits) if r.random() < 0.7 else "".join(r.choice("xyz ") for _ in range(r.randint(1, 90))) for _ in range(r.randint(0, 6)))
        texts.append(t)
    ids = list(range(80))
    r.shuffle(ids)
    rows = list(zip(ids, texts)) + [(5, texts[3]), (5, texts[3]), (None, texts[9]), (None, bits[0] * 2)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, shard_bytes=shard, part_contexts=part)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain(rows, 100)
    got = {r.doc_id: r for r in op5_suffix_array_dedup(spark, sf).collect()}
    assert len(got) == len(rows) and any(want.values())
    for d, t in rows:
        raw, spans = t.encode(), want[d, t]
        kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))
        assert tuple(got[d])[1:] == (len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_suffix_arrays_prefixes_and_merging():
    r = random.Random(1)
    for _ in range(200):
        n, a, length = r.randint(0, 200), r.choice([1, 2, 4, 256]), r.choice([3, 10, 20])
        d = np.array([r.randrange(a) for _ in range(n)], np.uint8)
        if r.random() < 0.5 and n > 20:
            d = np.concatenate([d, d[3 : n // 2], d])
        n, b = len(d), d.tobytes()
        order = suffix_array(d, length)
        keys = [b[i : i + length] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        shared = common_prefixes(d, order, length)
        for x, y, s in zip(keys, keys[1:], shared[1:]):
            assert s == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        rank = np.array(r.sample(range(1000), n), np.int64)
        whole, _ = repeats(d, np.arange(n, 0, -1), rank, length)
        # The same in shards of whole strings, merged.
        edges = sorted({0, n, *(r.randint(0, n) for _ in range(3))})
        shards, gone = [], set()
        for lo, hi in zip(edges, edges[1:]):
            hi_ = min(n, hi + length - 1)
            part, room, rk = d[lo:hi_], np.arange(hi_ - lo, 0, -1), rank[lo:hi_]
            again, first = repeats(part, room, rk, length)
            gone |= set(rk[again].tolist())
            shards.append((part, first, rk[first]))
        for (_, _, rk), lost in zip(shards, merge_shards(shards, length)):
            gone |= set(rk[lost].tolist())
        assert gone == set(rank[whole].tolist())
