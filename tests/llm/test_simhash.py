import random
import re

import pytest
import xxhash

from foliant.llm.components import components
from foliant.llm.simhash import links, near_duplicates, op3_simhash_near_dedup

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius=2):
    """fps: list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def test_every_case_against_brute_force(docs, none):
    src = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [(d, plain_fingerprint(t)) for d, t in src]
    want = sorted(zip(((d, f"{f:016x}") for d, f in fps), plain_components(fps)), key=str)
    got = near_duplicates(docs).collect()
    have = sorted((((r.doc_id, f"{r.fp % 2**64:016x}"), r.component_id) for r in got), key=str)
    assert have == want
    assert near_duplicates(none).count() == 0


def test_query_against_brute_force(spark):
    src = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in src]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps))}
    assert {tuple(r) for r in op3_simhash_near_dedup(spark, SMALL).collect()} == want


@pytest.mark.parametrize("radius,bucket", [(1, 64), (2, 64), (1, 2), (2, 2), (2, 0)])
def test_links_connect_what_brute_force_connects(spark, radius, bucket):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(30)]
    for f in fps[:25]:
        for _ in range(6):
            for _ in range(r.randint(0, 3)):
                f ^= 1 << r.randrange(64)
            fps.append(f)
    fps = sorted(set(fps))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    roots = {r.node: r.root for r in components(links(nodes, radius, bucket)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == plain_components(list(enumerate(fps)), radius)


def test_segments_find_and_distances_reject(spark):
    """Fingerprints that agree in a whole segment meet in its table, and only the complete distance tells them apart."""
    r = random.Random(8)
    low = [r.getrandbits(32) for _ in range(40)]
    fps = sorted({(h << 32) | x for x in low for h in (r.getrandbits(32), r.getrandbits(32))} | {(5 << 32) | low[0], (5 << 32) | low[0] ^ 3, (4 << 32) | low[0] ^ 1})
    nodes = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "node long, fp long")
    got = {frozenset(x) for x in links(nodes).select("u", "v").collect()}
    assert got == {frozenset((i, j)) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2} and got


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (1000, 999)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1000: 999}
