import random

import numpy as np
import pytest

from foliant.llm import simhash


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def jaccard(a, b, n=5):
    s = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def plain_roots(texts, least=0.8):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= least:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    return root


def kept(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(x.doc_id for x in simhash.keep_one(df, **options).collect())


def edited(r, w, n):
    w = list(w)
    for at in r.sample(range(len(w)), n):
        w[at] = words(r, 1)[0]
    return w


def test_single_pairs_are_near_exactly_from_0_8(spark):
    r, texts, want, near = random.Random(1), [], [], []
    for _ in range(600):
        w = words(r, 200)
        a, b = " ".join(w), " ".join(edited(r, w, r.randint(2, 7)))
        near.append(jaccard(a, b))
        want += [len(texts)] if near[-1] >= 0.8 else [len(texts), len(texts) + 1]
        texts += [a, b]
    assert sum(0.8 <= j < 0.85 for j in near) > 80 and sum(0.7 <= j < 0.8 for j in near) > 80
    assert kept(spark, texts) == want


def test_bands_meet_at_0_8():
    r = np.random.default_rng(2)
    for _ in range(2000):  # 400 hashes each, 0.8 of all shared
        h = r.integers(0, 1 << 63, 444, np.uint64)
        assert (simhash.band_keys(h[:400]) == simhash.band_keys(h[44:])).any()


def test_a_family_of_one_template_stays(spark):
    r = random.Random(3)
    shared = words(r, 330)
    texts = [" ".join(shared + words(r, 70)) for _ in range(100)]
    assert all(0.68 < jaccard(texts[0], t) < 0.72 for t in texts[1:])
    assert kept(spark, texts) == list(range(100))


def test_groups_against_brute_force(spark):
    """Copies of copies: chains, hubs that aren't central, members that only a few others are near to."""
    r, texts = random.Random(4), []
    for _ in range(4):
        w = words(r, 150)
        group = [w]
        for _ in range(60):
            group.append(edited(r, r.choice(group), r.randint(1, 5)))
        texts += [" ".join(x) for x in group]
    texts += ["", " ", "one two", "One  two", "one two three"]
    r.shuffle(texts)
    root = [k if not t.strip() else x for k, (t, x) in enumerate(zip(texts, plain_roots([t.lower() for t in texts])))]
    blank = [k for k, t in enumerate(texts) if not t.strip()]
    want = sorted({x for k, x in enumerate(root) if k not in blank} | {blank[0]})
    assert kept(spark, texts) == want
    assert kept(spark, texts, tile=8) == want  # large points in pairs of tiles


def test_links_of_sets_in_small_blocks():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 100, np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(100) < 0.93], r.integers(0, 1 << 63, r.integers(1, 12), np.uint64)])) for _ in range(90)]
    far = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    for roots in (np.arange(90), np.arange(90) // 7):
        pairs = simhash.set_links(sets, roots, 0.8, cells=1)
        assert all(far(sets[a], sets[b]) >= 0.8 for a, b in pairs)

        def groups(links):
            root = list(range(90))
            for a, b in [*links, *((a, b) for a in range(90) for b in range(a) if roots[a] == roots[b])]:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
            return root

        assert groups(pairs) == groups([(a, b) for a in range(90) for b in range(a) if far(sets[a], sets[b]) >= 0.8])


def test_fingerprints_of_near_sets_meet_in_a_segment():
    r = np.random.default_rng(6)
    for home in (0, 6):
        most, segments = simhash.tables(0.8, home)
        for size in (9, 45, 450):  # a tenth on each side is its own, so 0.8 of all is shared
            own = size // 9
            sets = [r.integers(0, 1 << 63, size + own, np.uint64) for _ in range(500)]
            a = np.array([simhash.wide_fingerprint(s[:size]) for s in sets])
            b = np.array([simhash.wide_fingerprint(s[own:]) for s in sets])
            assert (np.bitwise_count(a ^ b).sum(axis=1) <= most).all()
            balls = np.stack([np.bitwise_count(simhash.near_values(a, s) ^ simhash.near_values(b, s)) <= simhash.NEAR_RADIUS for s in segments], axis=1)
            assert ((simhash.cells(a, segments) == simhash.cells(b, segments)) & balls).any(axis=1).all()
            assert (np.bitwise_count(a[1:] ^ b[:-1]).sum(axis=1) > most).all()


@pytest.mark.parametrize("home,tile", [(0, 1000), (3, 1000), (2, 16)])
def test_close_links_connect_what_brute_force_connects(spark, home, tile):
    """Fingerprints that share a cell and a ball are linked by their complete distance alone; large cells go in pairs of tiles."""
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 63, (30, simhash.WIDE), np.uint64)
    w = np.concatenate([base] + [base ^ np.packbits(r.random((30, simhash.WIDE_BITS)) < p, axis=1, bitorder="little").view("<u8") for p in (0.1, 0.2, 0.3, 0.3, 0.3)])
    most, segments = simhash.tables(0.8, home)
    balls = sum(
        (np.bitwise_count(n[:, None] ^ n[None, :]) <= simhash.NEAR_RADIUS) & (c[:, None] == c[None, :])
        for n, c in zip((simhash.near_values(w, s) for s in segments), simhash.cells(w, segments).T)
    )
    far = np.bitwise_count(w[:, None] ^ w[None, :]).sum(axis=2)
    want = {(i, j) for i, j in np.argwhere((balls > 0) & (far <= most)).tolist() if j < i}
    assert ((balls > 0) & (far > most)).any() and len(want) > 60
    rows = [(i, *x) for i, x in enumerate(w.view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"w{k} long" for k in range(simhash.WIDE)))
    got = {(max(x), min(x)) for x in simhash.close_links(nodes, 0.8, home, tile).collect()}
    assert got <= want and roots_of(got, len(w)) == roots_of(want, len(w))


def roots_of(links, n):
    root = list(range(n))
    for a, b in links:
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    return root


def test_the_stage_finds_its_pairs_by_fingerprints(spark, monkeypatch):
    r = random.Random(8)
    w = words(r, 200)
    texts = [" ".join(w), " ".join(edited(r, w, 1)), " ".join(words(r, 200))]
    assert kept(spark, texts) == [0, 2]
    monkeypatch.setattr(simhash, "close_links", lambda nodes, similarity: spark.createDataFrame([], "u long, v long"))
    assert kept(spark, texts) == [0, 1, 2]
