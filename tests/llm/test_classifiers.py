import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query,label,folds,fold,limit,least", [(quality.op1_quality_classifier, "quality", 3, 1, 0.5, 0.98), (toxicity.op10_toxicity, "toxic", 4, 2, 0.3, 0.95)])
def test_held_out_accuracy(spark, query, label, folds, fold, limit, least):
    rows = query(spark, SF).collect()
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
        if r.held_out and r.doc_id in marks:
            right.append(r.predicted == marks[r.doc_id])
    assert len(right) > 500 and np.mean(right) >= least


@pytest.mark.parametrize("m,label", [(quality, "quality"), (toxicity, "toxic")])
def test_every_case(spark, docs, none, m, label):
    marks = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (21, None), (2, 1), (2, 1)], f"doc_id long, {label} int")
    model = m.fit(docs, marks)
    scored = m.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score_ between 0 and 1").count() == docs.count()
    assert scored.columns == [*docs.columns, "score_"] and {r.score for r in scored.collect()} == {1}  # the caller's own column stays
    by_text = {}
    for r in scored.collect():
        assert by_text.setdefault(r.text or "", r.score_) == r.score_
    assert m.score(none, model).count() == 0
    blank = m.fit(none, marks.limit(0))
    assert m.score(docs, blank).where("score_ between 0 and 1").count() == docs.count()


def plain_statistics(text):
    """The statistics of a text, each said again the long way."""
    raw, n = (text or "").encode(), len((text or "").encode())
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?", b"!", b"|", b"#*$%&<>", bytes(range(128, 192)), bytes(range(192, 256))]
    shares = [sum(c in k for c in raw) / max(n, 1) for k in kinds]
    w = raw.split()
    k = len(w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    fives = [tuple(w[i : i + 5]) for i in range(k - 4)]
    over = lambda x: x / k if k else 0.0
    return [
        (n - sum(round(s * max(n, 1)) for s in shares)) / max(n, 1), *shares, math.log1p(n), math.log1p(k), over(sum(map(len, w))), float(max(map(len, w), default=0)), over(sum(len(x) <= 3 for x in w)),
        over(len(set(w))), over(max((w.count(x) for x in set(w)), default=0)), over(sum(a == b for a, b in zip(w, w[1:]))), 1 - len(set(fives)) / len(fives) if fives else 0.0,
        math.log1p(len(lines)), k / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), len(zlib.compress(raw, 1)) / (n + 20),
    ]


def test_statistics_against_plain_python(texts):
    for t in [*texts, "a\n \n a\na", "x" * 50, "!?! | #"]:
        assert np.allclose(quality.statistics((t or "").encode()), plain_statistics(t)), t


def test_quality_query_against_plain_python(spark):
    """op1's rows: plain statistics, the fitted trees walked one by one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    t = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in quality.op1_quality_classifier(spark, sf).collect()}
    for r in docs.collect():
        x, z = plain_statistics(r.text), t.base
        for f, c, v in zip(t.feature, t.limit, t.value):
            k = 0
            while k < len(f):
                k = 2 * k + (1 if x[f[k]] <= c[k] else 2)
            z += v[k - len(f)]
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-3


def test_toxicity_query_against_plain_python(spark):
    """op10's rows: the whole text's different words, hashed and summed one by one under the fitted weights."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    for r in docs.collect():
        low = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in re.sub("[A-Z]", lambda a: a[0].lower(), r.text or ""))
        buckets = {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in low.split(" ") if w}
        z = m.bias + sum(m.weights[b] for b in buckets)
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-6


def test_a_repeated_id_teaches_once(spark):
    """Rows of one id, equal or not, count as one in a fit."""
    docs = spark.createDataFrame([(k % 30, f"word{k % 30} text of row {k // 30 if k % 30 == 7 else 0}") for k in range(90)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    once = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    few = lambda d: toxicity.fit(d.where("doc_id <> 7"), marks).weights
    assert (few(docs) == few(once)).all()
    assert (quality.fit(docs.where("doc_id <> 7"), marks).value == quality.fit(once.where("doc_id <> 7"), marks).value).all()


def test_flat_trees_walk_like_plain_ones():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = quality.fit_trees(x, y, trees=30)
    assert ((t.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        z = t.base
        for f, c, v in zip(t.feature, t.limit, t.value):
            k = 0
            while k < len(f):
                k = 2 * k + (1 if row[f[k]] <= c[k] else 2)
            z += v[k - len(f)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose([walk(row) for row in x[:200]], t.score(x[:200]))


def test_nnpu_finds_positives_among_unlabelled():
    r = np.random.default_rng(1)
    word = lambda toxic: np.unique(np.append(r.integers(100, 3000, 30), r.integers(0, 5, 2) if toxic else [])).astype(np.int32)
    positive = [word(True) for _ in range(300)]
    truth = r.random(4000) < 0.2
    unlabelled = [word(t) for t in truth]
    model = toxicity.nnpu_fit(positive, unlabelled, 0.2)
    assert ((model.score(unlabelled) >= 0.3) == truth).mean() > 0.98
    assert model.score([np.zeros(0, np.int32)])[0] < 0.3
