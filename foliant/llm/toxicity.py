"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) on hashed words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, free_name, short_batches, table, written

BUCKETS = 1 << 18
#: The classifier is fitted on at most so many confirmed toxic rows and so many others, taken
#: in the order of a hash of the id.  All other figures cover every document.
MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000
FEATURES = 4096
#: A word is used if confirmed rows have it oftener by so many standard errors.
LIFT = 6.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: ASCII punctuation and control characters part words, as blanks do.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class WordHasher:
    """The different words of a text as sorted bucket numbers; buckets of seen words are kept, up to a bound."""

    def __init__(self, bound: int = 60_000):
        self.seen: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, text: bytes) -> np.ndarray:
        import zlib

        words = set(text.translate(_LOWER).translate(_PARTS).split())
        if len(self.seen) > self.bound:
            self.seen.clear()
        seen, out = self.seen, []
        for w in words:
            b = seen.get(w)
            if b is None:
                b = seen[w] = zlib.crc32(w) & (BUCKETS - 1)
            out.append(b)
        return np.unique(np.array(out, np.int32))


@dataclass
class Model:
    """A linear model over the presence of hashed words: weights by bucket, zero for unused ones."""

    weights: np.ndarray
    bias: float

    def score(self, buckets: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(_product(buckets, self.weights) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def _product(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[r].sum() if len(r) else 0.0 for r in rows], np.float64)


def nnpu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = FEATURES, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with the logistic loss.

    Where the second part falls below zero its gradient is reversed, as the estimator asks.
    Words are chosen by how much oftener confirmed rows have them than unlabelled ones.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(BUCKETS), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    count = lambda rows: np.bincount(np.concatenate(rows) if rows else np.zeros(0, np.int32), minlength=BUCKETS).astype(np.float64)
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = count(positive), count(unlabelled)
    rate_p, rate_u = in_p / n_p, in_u / n_u
    spread = np.sqrt((rate_u * (1 - rate_u) + 1.0 / n_u) * (1.0 / n_p + 1.0 / n_u))
    lift = np.where(in_p >= 3, (rate_p - rate_u) / spread, 0.0)
    chosen = np.argsort(-lift, kind="stable")[:features]
    chosen = chosen[lift[chosen] > LIFT]
    if not len(chosen):
        chosen = np.argsort(-lift, kind="stable")[:1]
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [column[r] for r in rows]
        cols = [c[c >= 0] for c in cols]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols)

    (rp, cp), (ru, cu) = sparse(positive), sparse(unlabelled)
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        zp = np.bincount(rp, weights=w[cp], minlength=n_p) + b
        zu = np.bincount(ru, weights=w[cu], minlength=n_u) + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = prior * (sp - 1.0 - sp) / n_p, su / n_u
        else:
            gp, gu = prior * sp / n_p, -su / n_u
        grad = np.append(np.bincount(cp, weights=gp[rp], minlength=len(w)) + np.bincount(cu, weights=gu[ru], minlength=len(w)) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(BUCKETS)
    weights[chosen] = w
    return Model(weights, float(b))


_hasher: list[WordHasher] = []


def _buckets_of(texts: pa.Array) -> list[np.ndarray]:
    if not _hasher:
        _hasher.append(WordHasher())
    return [_hasher[0](t or b"") for t in texts.cast(pa.binary()).to_pylist()]


def _hash_udf():
    @F.arrow_udf("binary")
    def udf(text: pa.Array) -> pa.Array:
        return pa.array([b.astype("<i4").tobytes() for b in _buckets_of(text)], pa.binary())

    return udf


def _score_udf(spark: SparkSession, model: Model):
    used = np.flatnonzero(model.weights)
    sent = spark.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.bias))  # FEATURES weights at most

    @F.arrow_udf("double")
    def udf(text: pa.Array) -> pa.Array:
        at, values, bias = sent.value
        weights = np.zeros(BUCKETS)
        weights[at] = values
        return pa.array(Model(weights, bias).score(_buckets_of(text)), pa.float64())

    return udf


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit outside the held-out fold: confirmed rows against a sample of all rows, whose labels are not looked at.

    ``prior`` is the share of toxic rows among all text; by default the share of confirmed
    ones among labelled rows outside the held-out fold.  A row that several labels
    name is confirmed if one of them is 1; null labels and null ids confirm nothing.  Of several rows of an id
    the one of the smallest hashed words is taken.  Texts stay where they are: hashed words alone are shuffled and collected.
    """
    short_batches(docs.sparkSession)
    learn = crc_mod(id_col, FOLDS) != HELD_OUT
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn).groupBy(id_col).agg(F.max(label_col).alias("mark"))
    ids = docs.where(F.col(id_col).isNotNull() & learn).select(id_col).distinct().join(marks, id_col, "left")
    if prior is None:
        n, ones = marks.agg(F.count("*"), F.sum(F.when(F.col("mark") == 1, 1).otherwise(0))).first()
        prior = (ones or 0) / n if n else 0.5
    prior = min(max(prior, 1e-3), 0.9)
    mixed = F.xxhash64(F.col(id_col))
    is_toxic = F.coalesce(F.col("mark") == 1, F.lit(False))
    sample = written(ids.where(is_toxic).orderBy(mixed, id_col).limit(max_positive).select(id_col, F.lit(True).alias("toxic_")).unionByName(ids.orderBy(mixed, id_col).limit(max_unlabelled).select(id_col, F.lit(False).alias("toxic_"))))
    # At most max_positive + max_unlabelled ids: a bounded broadcast.
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_")).join(F.broadcast(sample), id_col)
    # Buckets come as bytes in Arrow batches: about a kilobyte a row, never a Python object a number.
    got = rows.select(id_col, "toxic_", _hash_udf()("text_").alias("buckets")).groupBy(id_col, "toxic_").agg(F.min("buckets").alias("buckets")).toArrow()
    got = got.take(pa.compute.sort_indices(got, sort_keys=[(id_col, "ascending"), ("toxic_", "ascending"), ("buckets", "ascending")]))
    arrays = [np.frombuffer(b.as_buffer(), "<i4") for b in got.column("buckets")]
    toxic = got.column("toxic_").to_pylist()
    return nnpu_fit([a for a, y in zip(arrays, toxic) if y], [a for a, y in zip(arrays, toxic) if not y], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the whole text's score, 0 to 1.  Null text scores as empty text.
    Where ``docs`` has a column of that name, it stays, and the score's gets an underscore more."""
    short_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, name), _score_udf(docs.sparkSession, model)(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
