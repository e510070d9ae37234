import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import packing, simhash, toxicity
from foliant.llm.common import table
from test_dedup import plain as plain_spans
from test_secrets import plain as plain_secrets

SF = "/root/testdata/sf0.001"


def jaccard(a, b, n=5):
    s = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "secret_scans", "best_fit_packing"]

    clean = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.3").collect()}

    single = stages["simhash_near_dedup"](spark, clean, SF).cache()
    src = sorted((r.doc_id, r.text) for r in clean.collect())
    wide = [simhash.fingerprints([t.encode() for _, t in src], 5, s) for s in (42, 43)]
    w = np.stack(wide, axis=1)
    far = sum(np.bitwise_count(w[:, None, k] ^ w[None, :, k]).astype(int) for k in range(2))
    shared = np.zeros(far.shape, bool)
    for k in range(4):
        seg = (w[:, k // 2] >> np.uint64(32 * (k % 2))) & np.uint64(0xFFFFFFFF)
        shared |= np.bitwise_count(seg[:, None] ^ seg[None, :]) <= 2
    link = (far <= 19) & shared
    group = np.arange(len(src))
    for _ in range(len(src)):
        low = np.where(link, group[None, :], len(src)).min(axis=1)
        if (low == group).all():
            break
        group = low
    assert sorted(tuple(r) for r in single.select("doc_id", "text").collect()) == [x for k, x in enumerate(src) if group[k] == k]
    assert single.columns == docs.columns

    short = stages["suffix_array_dedup"](spark, single, SF).cache()
    src = [(r.doc_id, r.text) for r in single.collect()]
    want = {}
    for (d, t), spans in plain_spans(src, 100).items():
        b = t.encode()
        want[d] = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)])).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in short.collect()} == want and short.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in short.collect())

    safe = stages["secret_scans"](spark, short, SF).cache()
    for r in safe.collect():
        t, at, out = want[r.doc_id], 0, ""
        for a, _, b in plain_secrets(t)[1]:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + t[at:] and r.source == rows[r.doc_id].source
    assert safe.columns == docs.columns

    import public_tokenizers

    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(encode([r.text.encode()])[0]) // 4 + 1 for r in safe.collect()}
    packed = stages["best_fit_packing"](spark, safe, SF)
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("which", range(5))
def test_every_case(spark, docs, none, which):
    name, stage = corpus_pipeline.STAGES[which]
    out = stage(spark, docs, SF)
    assert which == 4 or out.columns == docs.columns
    assert out.count() <= (99_999 if which == 4 else docs.count())
    assert stage(spark, none, SF).count() == 0
    if name == "simhash_near_dedup":
        texts = [r.text or "" for r in out.collect()]
        assert len(texts) == len(set(texts)) and sum(not t.split() for t in texts) == 1


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "on", "que", "ing", "la"]) for _ in range(r.randint(1, 4)))
    rows, groups = [], []
    for k in range(60):
        base = [word() for _ in range(r.randint(120, 400))]
        rows.append((1000 * k, " ".join(base)))
        for j in range(1, 6):
            copy = list(base)
            copy[r.randrange(len(copy))] = "changed"
            rows.append((1000 * k + j, " ".join(copy)))
            groups.append((1000 * k, 1000 * k + j, jaccard(rows[-1][1], " ".join(base))))
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(1000 * k in kept for k in range(60))
    near = [b for _, b, j in groups if j >= 0.9]
    assert len(near) > 200 and sum(b not in kept for b in near) / len(near) > 0.97


def test_spanning_links_connect_all():
    r = np.random.default_rng(2)
    w = r.integers(-(2**62), 2**62, (40, 2))
    w = np.concatenate([w ^ (np.int64(1) << r.integers(0, 62, (40, 2))) for _ in range(60)])
    bits = w.view(np.uint64)
    near = lambda i, j: sum(np.bitwise_count(bits[i : i + 128, None, k] ^ bits[None, j : j + 128, k]).astype(int) for k in range(2)) <= 3
    pairs = simhash.spanning(np.arange(len(w)), near, 128)
    far = sum(np.bitwise_count((w[:, None, k] ^ w[None, :, k]).view(np.uint64)).astype(int) for k in range(2))

    def groups(pairs):
        g = list(range(len(w)))

        def find(i):
            while g[i] != i:
                i = g[i]
            return i

        for a, b in pairs:
            g[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(w))]

    assert groups(pairs) == groups(np.argwhere(far <= 3)) and len(pairs) < len(w)
    assert all(far[a, b] <= 3 for a, b in pairs)
