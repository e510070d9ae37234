import math

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import topk


def plain(rows, query, k):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for qi, q in dict(((i, tuple(v)), (i, v)) for i, v in rows if query(i)).values():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qi)[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_every_case(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS_ROWS", 7)
    monkeypatch.setattr(topk, "GROUP_ANNULI", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=6).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, [0.5] * 6) for k in range(70)]  # ties
    rows += [(400, None), (405, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (410, [float("nan")] + [0.0] * 5), (415, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (420, [0.0] * 6), (7, [9.0] * 6), (7, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, score int").repartition(3)
    for k in (5, 400):
        got = topk.top_k(df, df.where(F.col("vec_id") % 5 == 0), k=k).collect()
        assert sorted(map(tuple, got)) == plain(rows, lambda i: i % 5 == 0, k)
    none = df.limit(0)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(df, none).count() == 0
    one = df.where("vec_id = 3")
    assert topk.top_k(one, one).count() == 0


def clusters(r, n=20, size=200, dim=8):
    centres = r.normal(size=(n, dim)) * 3000
    return np.round(np.concatenate([c + r.normal(size=(size, dim)) * 20 for c in centres])).astype(np.int64)


def test_bounds_skip_annuli():
    """Each query expands annuli in the order of its own bounds and stops."""
    x = clusters(np.random.default_rng(1))
    pivots = topk.choose_pivots(x[::17].astype(float), 20)
    d = topk._distances(x, pivots)
    which, dist = d.argmin(axis=1), d.min(axis=1)
    order = np.lexsort((dist, which))
    annuli = []
    for p in range(len(pivots)):
        own = order[which[order] == p]
        for at in range(0, len(own), 50):
            s = own[at : at + 50]
            annuli.append((p, dist[s].min(), dist[s].max(), float((x[s] ** 2).sum(axis=1).max()), s.astype("<i8").tobytes(), x[s].tobytes()))
    counts = {}
    q_ids = np.arange(0, len(x), 97)
    q, i, s = topk.search_group(q_ids, x[q_ids], np.full(len(q_ids), topk._LEAST), annuli, pivots, 5, float(abs(x).max()), counts)
    for qi in q_ids:
        want = sorted((-int(x[qi] @ x[j]), j) for j in range(len(x)) if j != qi)[:5]
        assert sorted(zip((-s[q == qi]).tolist(), i[q == qi].tolist())) == want
    assert counts["skipped"] > 2 * counts["searched"] and counts["skipped"] + counts["searched"] == len(q_ids) * len(annuli)


def test_blocks_that_no_bound_asks_for_are_not_sent(spark, monkeypatch):
    for name, value in (("ANNULUS_ROWS", 20), ("GROUP_ANNULI", 5)):
        monkeypatch.setattr(topk, name, value)
    sent = []
    plain_written = topk.written
    monkeypatch.setattr(topk, "written", lambda df: (out := plain_written(df), "grp" in df.columns and "floor" in df.columns and sent.append(out.count()))[0])
    x = clusters(np.random.default_rng(2))
    df = spark.createDataFrame([(k, (v / 256).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 40 = 0")).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {
        (q, j, int(x[q] @ x[j])) for q in range(0, len(x), 40) for _, j in sorted((-int(x[q] @ x[j]), j) for j in range(len(x)) if j != q)[:5]
    }
    home, rest = sent
    assert home == 100 and rest < 0.5 * 100 * 40  # of about 40 groups a query


def test_large_components_and_vectors_of_any_length(spark):
    rows = [(0, [1e7]), (50, [1e7, 0.5]), (1, [-1e7]), (2, [1.0, 2.0, 3.0]), (3, []), (4, [0.0, 1e30]), (5, [1e30, 1e30]), (100, [1e30]), (6, [9e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), k=3).collect()))
    hold = lambda n: max(-(2**63), min(2**63 - 1, n))
    ints = {i: [hold(math.floor(256 * c)) for c in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        scored = sorted((-hold(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in ints.items() if i != q)[:3]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert (0, 1, 5, 2**63 - 1) in got  # held at a long's end
    few = df.where("vec_id in (0, 50, 1)")
    assert (0, 1, 50, 6553600000000000000) in set(map(tuple, topk.top_k(few, few.where("vec_id = 0")).collect()))
