import zlib
from collections import defaultdict

import numpy as np

from foliant.llm.sharding import jump_hash, shard


def plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert jump_hash(keys, n).tolist() == [plain(int(k), n) for k in keys]


def test_shards(docs, texts):
    rows = shard(docs).collect()
    assert len(rows) == docs.count()
    per, by_id = defaultdict(list), defaultdict(set)
    for r in rows:
        per[r.shard].append(r.slot)
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        raw = (texts[r.doc_id] if r.doc_id is not None else "one two") or ""
        assert (r["size"], r.text_crc32, r.law) == (len(raw.encode()) + 1, zlib.crc32(raw.encode()), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert all(len(s) == 1 for s in by_id.values())


def test_even_and_empty(spark, none):
    ids = spark.range(20000).selectExpr("id as doc_id", "cast(null as string) as text")
    counts = [r["count"] for r in shard(ids).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) < 1.2 * 20000 / 16
    assert shard(none).count() == 0
