"""Exact inner-product search over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it (iDistance: Jagadish et al.,
2005); neighbours in that order form annuli of bounded size, and runs of annuli form blocks.  For a query q and a
vector x of an annulus, |q - x| >= | |q - p| - |x - p| |, and 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2, so the annulus's
distances and largest norm bound the products it can hold.  Each query first searches its home, the block of
the highest bound; its k-th product there then tells which other blocks it has to see at all, and in a
block it expands annuli in the order of its own bounds until one falls below its k-th product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import table, trimmed, written

SCALE = 256
K = 5
QUERY_MOD = 50
#: Pivots are taken from at most so many rows, in the order of a hash of the id; every row is indexed.
PIVOT_SAMPLE = 4096
PIVOTS = 32
ANNULUS_ROWS = 256
QUERY_BLOCK = 2048
#: Annuli that a task searches for one block of queries.
GROUP_ANNULI = 32
#: Blocks that the directory lists, about; blocks have several groups of annuli where the table is large, so the directory stays a few MB.
BLOCKS = 16_384

_NO_ID = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min


def usable(vec: Column) -> Column:
    """Not null, not empty of meaning: no null and no non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """id and v, the components as floor(scale * x) with x as double, held within a long; rows that can't take part are out."""
    x = df.select(df[id_col].alias("id"), df[vec_col].alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    return x.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"))


def _packed(dim: int):
    """Vectors as ``dim`` little-endian longs; shorter ones end in zeros."""

    @F.arrow_udf("binary")
    def udf(v: pa.Array) -> pa.Array:
        out = np.zeros((len(v), dim), "<i8")
        sizes = np.diff(v.offsets.to_numpy())
        out[np.arange(dim)[None, :] < sizes[:, None]] = v.flatten().to_numpy()
        return pa.array([row.tobytes() for row in out], pa.binary())

    return udf


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of packed vectors, int64."""
    parts = [x.as_buffer() for x in (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)]
    return np.frombuffer(b"".join(parts), "<i8").reshape(len(parts), dim)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows of the sample far from each other: each next one is the farthest from those chosen."""
    if not len(sample):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :], 0))


_ANNULUS = "annulus long, grp long, pivot int, near double, far double, norm2 double, ids binary, vectors binary"


def _build(dim: int):
    """Rows in (pivot, distance) order in; annuli of at most ANNULUS_ROWS rows of one pivot out."""
    names = [c.split()[0] for c in _ANNULUS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, distance, ids = (batch.column(c).to_numpy() for c in ("pivot", "distance", "id"))
            x = _matrix(batch.column("v"), dim)
            edges = np.flatnonzero(pivot[1:] != pivot[:-1]) + 1
            rows = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pivot)]):
                for at in range(a, b, ANNULUS_ROWS):
                    s = slice(at, min(b, at + ANNULUS_ROWS))
                    norm2 = float((x[s].astype(np.float64) ** 2).sum(axis=1).max())
                    rows.append((base + number, base + number // GROUP_ANNULI, int(pivot[at]), float(distance[s].min()), float(distance[s].max()), norm2, ids[s].astype("<i8").tobytes(), x[s].tobytes()))
                    number += 1
            yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(names, zip(*rows))}, schema=pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())))))

    return run


def build_index(vectors: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """Annuli of all of ``vectors`` (id, packed v).  The order ends in the id, so even a third of equal vectors deals out evenly."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(pivots)  # PIVOTS rows

    @F.arrow_udf("struct<pivot:int,distance:double>")
    def key(v: pa.Array) -> pa.Array:
        d = _distances(_matrix(v, dim), sent.value)
        which = d.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(which, pa.int32()), pa.array(d[np.arange(len(d)), which])], ["pivot", "distance"])

    keyed = written(vectors.withColumn("k", key("v")).select("id", "v", "k.pivot", "k.distance"))  # also keeps range bounds and rows the same
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    return written(ordered.mapInArrow(trimmed(_build(dim)), _ANNULUS))


def bounds(q: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, near: np.ndarray, far: np.ndarray, norm2: np.ndarray) -> np.ndarray:
    """For each query and each annulus what no product of theirs exceeds; a little more, for rounding."""
    d = _distances(q, pivots)[:, pivot]
    q2 = (q.astype(np.float64) ** 2).sum(axis=1)[:, None]
    scale = q2 + norm2[None, :]
    gap = np.maximum(0, np.maximum(near[None, :] - d, d - far[None, :]) - 1e-6 * np.sqrt(scale) - 1e-6)
    return (scale - gap**2) / 2 + 1e-9 * scale + 1e-3


def products(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products; those beyond a long are held at its ends.  ``largest`` bounds all components' sizes."""
    most = q.shape[1] * largest * largest
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, _LEAST, _NO_ID).astype(np.int64)


def search_group(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, annuli: list[tuple], pivots: np.ndarray, k: int, largest: float, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query id, vector id, score) of some annuli (pivot, near, far, norm2, ids, vectors) for each query, ties to smaller ids.

    ``floor`` holds products that k others are known to reach: lower ones don't matter.
    """
    n = len(q)
    bound = bounds(q, pivots, *(np.array(c) for c in list(zip(*annuli))[:4]))
    order = np.argsort(-bound, axis=1, kind="stable")
    data = [(np.frombuffer(a[4], "<i8"), np.frombuffer(a[5], "<i8").reshape(-1, q.shape[1])) for a in annuli]
    best_s, best_i = np.full((n, k), _LEAST, np.int64), np.full((n, k), _NO_ID, np.int64)
    kth, live = floor.astype(np.float64), np.arange(n)
    for step in range(len(annuli)):
        at = order[live, step]
        # Equal products may still win by a smaller id, so only lower bounds stop a query, for good: its later bounds are lower still.
        go = bound[live, at] >= kth[live]
        live, at = live[go], at[go]
        if counts is not None:
            counts["searched"] = counts.get("searched", 0) + len(live)
            counts["skipped"] = counts.get("skipped", 0) + int((~go).sum()) * (len(annuli) - step)
        if not len(live):
            break
        for a in np.unique(at):
            rows = live[at == a]
            ids, x = data[a]
            s = products(q[rows], x, largest)
            own = q_ids[rows][:, None] == ids[None, :]  # a row is no candidate for itself
            better = ~own & (s >= kth[rows][:, None])
            some = better.any(axis=1)
            rows, s, better = rows[some], s[some], better[some]
            if not len(rows):
                continue
            s = np.concatenate([best_s[rows], np.where(better, s, _LEAST)], axis=1)
            i = np.concatenate([best_i[rows], np.where(better, np.broadcast_to(ids, better.shape), _NO_ID)], axis=1)
            take = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s falls as s rises, and never overflows
            best_s[rows], best_i[rows] = np.take_along_axis(s, take, 1), np.take_along_axis(i, take, 1)
            full = best_i[rows, -1] != _NO_ID
            kth[rows[full]] = np.maximum(kth[rows[full]], best_s[rows[full], -1].astype(np.float64))
    there = best_i != _NO_ID
    return np.repeat(q_ids, k)[there.ravel()], best_i[there], best_s[there]


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vector id and score: each query row's ``k`` best among all other rows of ``df``.

    ``queries`` holds rows of the same columns.  A query meets only the blocks that its bounds ask for; in
    a search task are at most QUERY_BLOCK queries, about, and GROUP_ANNULI annuli, and k rows a query leave it.
    Vectors that are null or hold a null or non-finite component take no part, nor do null ids;
    rows that repeat an id are candidates one by one, but none for that id's queries.
    Query rows of one id and different vectors share one list.  Shorter vectors count as if they ended in
    zeros.  Components and scores beyond a long are held at its ends.  Queries with fewer candidates have fewer rows, or none.
    """
    spark = df.sparkSession
    vectors, asked = quantised(df, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale).dropDuplicates(["id", "v"])
    either = vectors.select("v").unionByName(asked.select("v"))
    dim, high, low = either.agg(F.max(F.size("v")), F.max(F.array_max("v").cast("double")), F.min(F.array_min("v").cast("double"))).first()
    dim, largest = int(dim or 0), max(high or 0.0, -(low or 0.0))
    if not dim:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0).cast("long").alias("score")).limit(0)
    pack = _packed(dim)
    vectors, asked = vectors.select("id", pack("v").alias("v")), written(asked.select("id", pack("v").alias("v")))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toArrow()  # at most PIVOT_SAMPLE rows
    pivots = choose_pivots(_matrix(sample.column("v"), dim).astype(np.float64))
    index = build_index(vectors, dim, pivots)

    groups = index.select("grp").distinct().count()
    per = max(1, -(-groups // BLOCKS))  # groups of a block: neighbours of one partition
    block = (F.shiftright("grp", 32) * (1 << 32) + (F.col("grp") % (1 << 32) / per).cast("long")).alias("block")
    listed = index.groupBy(block, "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm2").alias("norm2")).orderBy("block", "pivot").toArrow()
    directory = {c: listed.column(c).to_numpy() for c in ("block", "pivot", "near", "far", "norm2")}  # about BLOCKS rows, PIVOTS more and one a partition
    sent = spark.sparkContext.broadcast((pivots, directory))

    def upper(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks, and each query's bound of each."""
        pivots, d = sent.value
        blocks, first = np.unique(d["block"], return_index=True)
        return blocks, np.maximum.reduceat(bounds(q, pivots, d["pivot"], d["near"], d["far"], d["norm2"]), first, axis=1)

    @F.arrow_udf("array<long>")
    def home(v: pa.Array) -> pa.Array:
        q, out = _matrix(v, dim), []
        for at in range(0, len(q), 64):
            blocks, b = upper(q[at : at + 64])
            out += blocks[b.argmax(axis=1)][:, None].tolist()
        return pa.array(out, pa.list_(pa.int64()))

    @F.arrow_udf("array<long>")
    def others(v: pa.Array, floor: pa.Array) -> pa.Array:
        q, least, out = _matrix(v, dim), floor.fill_null(_LEAST).to_numpy(), []
        for at in range(0, len(q), 64):
            blocks, b = upper(q[at : at + 64])
            b[np.arange(len(b)), b.argmax(axis=1)] = -np.inf  # home is searched
            limit = np.where(least[at : at + 64] == _LEAST, -np.finfo(float).max, least[at : at + 64].astype(np.float64))
            out += [blocks[row >= least_].tolist() for row, least_ in zip(b, limit)]
        return pa.array(out, pa.list_(pa.int64()))

    def both(q: pa.Table, a: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not q.num_rows or not a.num_rows:
            return none
        q, a = q.sort_by("id"), a.sort_by("annulus")
        annuli = list(zip(*(a.column(c).to_pylist() for c in ("pivot", "near", "far", "norm2", "ids", "vectors"))))
        out = search_group(q.column("id").to_numpy(), _matrix(q.column("v"), dim), q.column("floor").to_numpy(), annuli, sent.value[0], k, largest)
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, out))))

    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    where = index.select("grp", block).distinct()

    def search(rows: DataFrame) -> DataFrame:
        """Queries (id, v, floor, blocks) against their blocks' groups; a group is sent to the blocks of queries that ask for it."""
        left = rows.select("id", "v", "floor", F.explode("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).join(where, "block").drop("block")
        left = written(left)
        asked_for = left.select(F.col("grp").alias("__grp"), F.col("part").alias("__part")).distinct()
        right = index.join(asked_for, F.col("grp") == F.col("__grp"))
        return left.groupBy("part", "grp").cogroup(right.groupBy("__part", "__grp")).applyInArrow(both, "query_id long, id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    at_home = written(search(asked.withColumn("floor", F.lit(_LEAST)).withColumn("blocks", home("v"))))
    ranked = at_home.dropDuplicates(["query_id", "id", "score"]).withColumn("rank", F.row_number().over(best))
    floors = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = asked.join(floors, "id", "left").withColumn("blocks", others("v", "floor")).withColumn("floor", F.coalesce("floor", F.lit(_LEAST)))
    found = at_home.unionByName(search(rest))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return top_k(df, df.where(F.col("vec_id") % QUERY_MOD == 0))


OP8_SQL = f"""
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM x AS q JOIN x ON q.vec_id % {QUERY_MOD} = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
