"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, free_name, short_batches, table, written

#: The trees are fitted on at most so many labelled rows, in the order of a hash of the id.
MAX_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE, L2, LEAST = 80, 4, 0.15, 1.0, 5.0
THRESHOLD = 0.5
FOLDS, HELD_OUT = 3, 1

_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?", b"!", b"|", b"#*$%&<>", bytes(range(128, 192)), bytes(range(192, 256)))):
    _CLASSES[list(_chars)] = _k + 1

STATISTICS = (
    *("other", "lower", "upper", "digit", "blank", "newline", "stop", "bang", "bar", "symbol", "continuation", "lead"),
    *("log_bytes", "log_words", "word_bytes", "longest_word", "short_words", "unique_words", "top_word", "repeats_previous", "repeated_fives", "log_lines", "line_words", "repeated_lines", "compression"),
)


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole UTF-8 text, in the order of STATISTICS; shares unless the name says otherwise."""
    n = len(text)
    shares = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=12) / max(n, 1)
    words = text.split()
    n_words = len(words)
    if n_words:
        counts = Counter(words)
        sizes = list(map(len, words))
        word_bytes, longest, short = sum(sizes) / n_words, max(sizes), sum(1 for s in sizes if s <= 3) / n_words
        unique, top = len(counts) / n_words, max(counts.values()) / n_words
        same = sum(map(bytes.__eq__, words, words[1:])) / n_words
        fives = len(words) - 4
        repeated = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / fives if fives > 0 else 0.0
    else:
        word_bytes = longest = short = unique = top = same = repeated = 0.0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n_lines = len(lines)
    return [
        *shares, np.log1p(n), np.log1p(n_words), word_bytes, float(longest), short, unique, top, same, repeated,
        np.log1p(n_lines), n_words / max(n_lines, 1), 1 - len(set(lines)) / max(n_lines, 1), len(zlib.compress(text, 1)) / (n + 20),
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth in flat arrays: node k's children are 2k + 1 and 2k + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # rows at or under it go left
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """All trees for all rows at once, a level at a time."""
        trees, inner = self.feature.shape
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows, which = np.arange(len(part))[:, None], np.arange(trees)[None, :]
            node = np.zeros((len(part), trees), np.int64)
            while node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[which, node]] > self.limit[which, node])
            out[at : at + 4096] = self.base + self.value[which, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = L2, least: float = LEAST) -> Trees:
    """Gradient boosting on the logistic loss; splits are sought in histograms of quantile bins."""
    inner = 2**depth - 1
    if not len(y):
        return Trees(np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, inner + 1)), 0.0)
    n, d = x.shape
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    z = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best, best_f, best_b = np.full(wide, 1e-6), np.zeros(wide, np.int64), np.full(wide, bins, np.int64)
            for f in range(d):
                key = local * bins + binned[:, f]
                gs = np.cumsum(np.bincount(key, weights=g, minlength=wide * bins).reshape(wide, bins), axis=1)
                hs = np.cumsum(np.bincount(key, weights=h, minlength=wide * bins).reshape(wide, bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = -1.0
                gain[:, len(cuts[f]) :] = -1.0
                at = gain.argmax(axis=1)
                got = gain[np.arange(wide), at]
                better = got > best
                best[better], best_f[better], best_b[better] = got[better], f, at[better]
            for k in range(wide):
                feature[t, first + k] = best_f[k]
                limit[t, first + k] = cuts[best_f[k]][best_b[k]] if best_b[k] < bins else np.inf
            f_of, b_of = best_f[local], best_b[local]
            node = 2 * node + 1 + (binned[np.arange(n), f_of] > b_of)
        leaf = node - inner
        gl, hl = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value[t] = -rate * gl / (hl + l2)
        z += value[t][leaf]
    return Trees(feature, limit, value, base)


def _statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATISTICS))


def _statistics_udf():
    @F.arrow_udf("array<double>")
    def udf(text: pa.Array) -> pa.Array:
        x = _statistics_of(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))

    return udf


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Fit on labelled rows outside the held-out fold, at most ``max_rows`` ids in the order of a hash.

    Null labels and ids teach nothing; several labels of an id count as their maximum.  Of several rows of an id the one
    of the smallest statistics teaches.  Texts stay where they are: statistics alone are shuffled and collected.
    """
    short_batches(docs.sparkSession)
    learn = crc_mod(id_col, FOLDS) != HELD_OUT
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn).groupBy(id_col).agg(F.max(label_col).cast("double").alias("mark_"))
    sample = written(docs.select(id_col).distinct().join(marks, id_col).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_rows))
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_")).join(F.broadcast(sample), id_col)  # at most max_rows ids
    rows = rows.select(id_col, "mark_", _statistics_udf()("text_").alias("x")).groupBy(id_col, "mark_").agg(F.min("x").alias("x"))
    got = rows.toArrow().sort_by(id_col)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit_trees(x, got.column("mark_").to_numpy())


def score(docs: DataFrame, model: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the whole text's score, 0 to 1.  Null text scores as empty text.
    Where ``docs`` has a column of that name, it stays, and the score's gets an underscore more."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees of fixed number and depth

    @F.arrow_udf("double")
    def udf(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(_statistics_of(text)), pa.float64())

    return docs.withColumn(free_name(docs, name), udf(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
