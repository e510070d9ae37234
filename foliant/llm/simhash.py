"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import give_back, id_text, short_batches, table, trimmed, written
from foliant.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a UTF-8 text, repeats included; A-Z in lower case."""
    w = text.translate(_LOWER).split()  # bytes.split() parts at the six ASCII blanks, as the contract does
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [h(b" ".join(w), seed)]
    shifted = [w[k:] for k in range(words)]
    return [h(s, seed) for s in map(b" ".join, zip(*shifted))]


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """A 64-bit fingerprint a text: a bit is set if over half of the shingle hashes set it."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        hashes = shingle_hashes(text, words, seed)
        if not hashes:
            continue
        ones = np.zeros(64, np.int64)
        h = np.array(hashes, "<u8")
        for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
            part = h[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = (2 * ones > len(h)).astype(np.uint8)
        out[k] = np.packbits(bits, bitorder="little").view("<u8")[0]
    return out


def fingerprint_udf(words: int):
    @F.arrow_udf("long")
    def udf(text: pa.Array) -> pa.Array:
        return pa.array(fingerprints(text.cast(pa.binary()).to_pylist(), words).view(np.int64), pa.int64())

    return udf


#: A fingerprint is cut into so many segments; two within RADIUS bits differ by one bit at most in some segment.
SEGMENTS = 2
SEGMENT_BITS = 64 // SEGMENTS
#: Fingerprints of one segment value; values that more share are searched by complete points instead.
BUCKET = 64


def segments(fp: Column) -> list[Column]:
    """The segments' values, each with its segment's number above it."""
    mask = F.lit((1 << SEGMENT_BITS) - 1)
    return [F.shiftrightunsigned(fp, SEGMENT_BITS * k).bitwiseAND(mask) + F.lit(k << SEGMENT_BITS) for k in range(SEGMENTS)]


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def segment_balls(fp: Column, radius: int) -> Column:
    """What a fingerprint looks up in the segments' tables: each segment, and for radius 1 also each with one bit set that
    wasn't.  Of two segments one bit apart, the one without the bit finds the other, so each pair is found from one side."""
    def around(v: Column) -> Column:
        clear = F.filter(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: v.bitwiseAND(_bit(i)) == 0)
        return F.transform(clear, lambda i: v.bitwiseOR(_bit(i)))

    own = F.array(*segments(fp))
    return F.concat(own, *map(around, segments(fp))) if radius else own


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints linked at ``radius`` 1 or 2 bits.

    ``nodes`` has one row (node, fp) a different fingerprint.  A table for each segment maps its values to fingerprints.
    Two fingerprints within ``radius`` bits differ by at most ``radius // SEGMENTS`` in some segment, so
    balls of that radius around the segments' values find them; every match's complete distance is verified.
    A value that more than ``bucket`` fingerprints share leaves the tables, and
    the fingerprints that look it up meet at complete points (``point_links``): no bucket's pairs are made.
    """
    if radius not in (1, 2):
        raise ValueError("fingerprints are linked at 1 or 2 bits")
    listed = nodes.select("node", "fp", F.explode(F.array(*segments(F.col("fp")))).alias("key"))
    hot = written(listed.groupBy("key").count().where(F.col("count") > bucket).select("key"))
    asked = nodes.select("node", "fp", F.explode(segment_balls(F.col("fp"), radius // SEGMENTS)).alias("key"))
    some_hot = not hot.isEmpty()
    tables = listed.join(hot, "key", "left_anti") if some_hot else listed
    met = asked.join(tables.select(F.col("node").alias("v"), F.col("fp").alias("fp2"), "key"), "key")
    found = met.where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)).select(F.col("node").alias("u"), "v")
    if not some_hot:
        return found
    crowded = asked.join(hot, "key", "left_semi").select("node", "fp").distinct()
    return found.unionByName(point_links(crowded, radius))


def ball(fingerprint: Column) -> Column:
    """The complete points within distance 1; at most 65 different fingerprints share one."""
    return F.concat(F.array(fingerprint), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fingerprint.bitwiseXOR(_bit(i))))


def point_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``links`` without segments: two fingerprints are within 2 bits if and only if their balls of radius 1 meet, so
    each point's members are linked to the smallest of them: linear work, no pairs, whatever the documents are."""
    points = nodes.select("node", "fp", F.explode(ball(F.col("fp"))).alias("point"))
    if radius == 1:  # each meets the other itself, not a point between them
        points = points.withColumn("own", F.col("point") == F.col("fp"))
        met = points.where(~F.col("own")).join(points.where("own").select(F.col("node").alias("v"), "point"), "point")
        return met.select(F.col("node").alias("u"), "v")
    first = F.min("node").over(Window.partitionBy("point"))
    return points.withColumn("v", first).select(F.col("node").alias("u"), "v").where("u <> v")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (long) and component_id of every row.

    Fingerprints collapse to different values first, so copies cost nothing more, however
    many there are.  component_id is the smallest id that can be reached.  A text without a
    word has fingerprint zero and is linked like any other; null text counts as empty.  A row
    with a null id belongs to its component but never names it, unless all ids in it are null
    (then component_id is null).  Repeated ids and rows stay.
    """
    short_batches(df.sparkSession)
    rows = written(id_text(df, id_col, text_col).select("id", fingerprint_udf(words)("text").alias("fp")))
    # Nodes are fingerprints themselves; ids of any type stay out of the graph.
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(names, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Near duplicates by the similarity of shingle sets: wide fingerprints and multi-index hashing find the pairs, the sets decide.

STAGE_WORDS = 5
#: Least Jaccard similarity of near duplicates.
SIMILARITY = 0.8
#: Bits of a wide fingerprint, and 64-bit words that hold them.
WIDE_BITS = 256
WIDE = WIDE_BITS // 64
#: A segment has NEAR_BITS bits and some home bits more.  Two fingerprints meet in its table if they agree in the home bits and
#: differ in NEAR_RADIUS of the others at most.
NEAR_BITS, NEAR_RADIUS = 8, 2
#: Most pairs of the least similarity that may meet in no table, by calculation.
MISSED = 3e-6

_SALT = np.random.default_rng(SEED).integers(0, 1 << 64, WIDE_BITS // 8, np.uint64)
_BALL = np.array([m for m in range(1 << NEAR_BITS) if m.bit_count() <= NEAR_RADIUS])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def wide_fingerprint(hashes: np.ndarray, block: int = 4096) -> np.ndarray:
    """The SimHash of a set that isn't empty, as WIDE words; memory is bounded for very long texts.

    Each shingle has a weight of either sign for each bit, a byte drawn from its hash; the bit is set if the weights' sum is
    over zero.  Weights of one size would sum to zero too often in short texts.
    """
    total = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), block):
        x = hashes[at : at + block, None] ^ _SALT
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        total += x.view(np.int8).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total + len(hashes) > 0, bitorder="little").view("<u8")  # a byte is -1/2 on average


@functools.cache
def tables(similarity: float, home: int) -> tuple[int, np.ndarray]:
    """The most bits that near fingerprints differ in, and the tables' segments: a row of bit numbers each, home bits first.

    Sets of Jaccard similarity J have a cosine of 2J / (1 + J) at least, and a bit differs with probability acos(cosine) / pi.
    The tables are as many as leave MISSED of the pairs.  The bits are cut into segments, over and over in other orders.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = [math.comb(WIDE_BITS, d) * p**d * (1 - p) ** (WIDE_BITS - d) for d in range(WIDE_BITS + 1)]
    most, beyond = WIDE_BITS, 0.0
    while beyond + far[most] < MISSED / 3:
        beyond += far[most]
        most -= 1
    width = home + NEAR_BITS
    inside = [math.comb(NEAR_BITS, i) / math.comb(width, i) for i in range(NEAR_RADIUS + 1)]  # all i bits that differ are no home bits
    meet = [sum(math.comb(d, i) * math.comb(WIDE_BITS - d, width - i) * inside[i] for i in range(NEAR_RADIUS + 1)) / math.comb(WIDE_BITS, width) for d in range(most + 1)]
    count = 1
    while sum(f * (1 - m) ** count for f, m in zip(far, meet)) > MISSED - beyond:
        count += 1
    order, each = np.random.default_rng(SEED), WIDE_BITS // width
    cut = [order.permutation(WIDE_BITS)[: each * width].reshape(each, width) for _ in range(-(-count // each))]
    return most, np.concatenate(cut)[:count]


def _bits(w: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=1, bitorder="little")


def cells(w: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """For each fingerprint and table the cell it lies in: the table's number above the home bits."""
    home = segments[:, :-NEAR_BITS]
    value = _bits(w)[:, home] @ (1 << np.arange(home.shape[1], dtype=np.int64))
    return value + (np.arange(len(segments), dtype=np.int64) << 40)


def near_values(w: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The part of a segment within which a ball is searched."""
    return _bits(w)[:, segment[-NEAR_BITS:]] @ (1 << np.arange(NEAR_BITS, dtype=np.int64))


def band_keys(hashes: np.ndarray, similarity: float = SIMILARITY, home: int = 4) -> np.ndarray:
    """The cells that a set's fingerprint lies in, one a table."""
    return cells(wide_fingerprint(hashes)[None, :], tables(similarity, home)[1])[0]


def cell_links(w: np.ndarray, near: np.ndarray, most: int, work: int = 1 << 20) -> np.ndarray:
    """Pairs of the fingerprints of one cell, as many as connect those that differ in ``most`` bits at most.

    Each looks up the ball around its near value; complete distances decide.  ``work`` bounds the pairs judged at once.
    """
    order = np.argsort(near, kind="stable")
    start = np.searchsorted(near[order], np.arange((1 << NEAR_BITS) + 1))
    root, out = np.arange(len(w)), []
    for value in np.flatnonzero(np.diff(start)):
        own = order[start[value] : start[value + 1]]
        ball = value ^ _BALL
        other = np.concatenate([order[start[v] : start[v + 1]] for v in ball[ball >= value]])
        for i in range(0, len(own), 1024):
            a = own[i : i + 1024]
            step = max(1, work // len(a))
            for j in range(0, len(other), step):
                b = other[j : j + step]
                if (root[a] == root[b[0]]).all() and (root[b] == root[b[0]]).all():
                    continue
                far = sum(np.bitwise_count(w[a, None, k] ^ w[None, b, k]).astype(np.uint16) for k in range(w.shape[1]))
                x, y = np.nonzero(far <= most)
                contract(root, np.maximum(a[x], b[y]), np.minimum(a[x], b[y]), out)
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def set_udf(words: int):
    """node, a hash of the text's shingle set, and its wide fingerprint; 0 and null if the set is empty."""
    kind = pa.struct([(f"w{k}", pa.int64()) for k in range(WIDE)])

    @F.arrow_udf(f"struct<node:long,w:struct<{','.join(f'w{k}:long' for k in range(WIDE))}>>")
    def udf(text: pa.Array) -> pa.Array:
        nodes, wide = np.zeros(len(text), np.uint64), np.zeros((len(text), WIDE), np.uint64)
        for k, t in enumerate(text.cast(pa.binary())):
            s = shingle_set(t.as_py(), words)
            if len(s):
                nodes[k], wide[k] = xxhash.xxh64_intdigest(s.tobytes(), SEED), wide_fingerprint(s)
        w = pa.StructArray.from_arrays([pa.array(wide[:, k].view(np.int64)) for k in range(WIDE)], fields=list(kind), mask=pa.array(nodes == 0))
        out = pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), w], ["node", "w"])
        del nodes, wide
        give_back()
        return out

    return udf


def near_udf(words: int, similarity: float):
    """Whether the Jaccard similarity of two texts' shingle sets is ``similarity`` or more."""

    @F.arrow_udf("boolean")
    def udf(one: pa.Array, other: pa.Array) -> pa.Array:
        out, last, held = [], None, set()
        for a, b in zip(one.cast(pa.binary()), other.cast(pa.binary())):
            a = a.as_py()
            if a != last:  # rows come sorted by this side
                last, held = a, set(shingle_hashes(a, words))
            s = set(shingle_hashes(b.as_py(), words))
            both = len(held & s)
            out.append(both / max(1, len(held) + len(s) - both) >= similarity)
        held = s = None
        give_back()
        return pa.array(out, pa.bool_())

    return udf


def contract(root: np.ndarray, a: np.ndarray, b: np.ndarray, out: list) -> None:
    """Join the rows a and b in ``root``; of these pairs as many as it takes are added to ``out``."""
    while len(a):  # pairs already joined fall away at once
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        one = np.unique(high, return_index=True)[1]  # one link for each root that goes
        out.append(np.stack([a[one], b[one]], axis=1))
        root[high[one]] = low[one]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def spanning(root: np.ndarray, near, block: int) -> np.ndarray:
    """Pairs (a, b), a > b, of the near ones as many as connect all; blocks of rows at a time.

    ``root`` has for each row the first one that it's connected to already, and is changed;
    ``near(i, j)`` judges the rows of the block from i against those of the one from j.
    """
    out = []
    for i in range(0, len(root), block):
        for j in range(0, i + 1, block):
            if (root[i : i + block] == root[j]).all() and (root[j : j + block] == root[j]).all():
                continue
            a, b = np.nonzero(near(i, j))
            a, b = a + i, b + j
            contract(root, a[b < a], b[b < a], out)
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def set_links(sets: list[np.ndarray], roots: np.ndarray, similarity: float, cells: int = 1 << 22, split: int = 0) -> np.ndarray:
    """Pairs of sets whose Jaccard similarity is ``similarity`` or more, as many as connect those of different ``roots``.

    All pairs are judged, by products of 0/1 matrices of at most ``cells`` entries; members of one set only have no column.
    With ``split``, only pairs of one of the first ``split`` sets and a later one.
    """
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    wide, ends = int(shared.sum()), np.cumsum(size)
    block = max(16, min(1024, cells // max(1, wide)))

    def dense(i: int) -> np.ndarray:
        part = size[i : i + block]
        c = column[ends[i] - size[i] : ends[min(i + block, len(sets)) - 1]]
        row = np.repeat(np.arange(len(part)), part)[c >= 0]
        out = np.zeros((len(part), wide), np.float32)
        out[row, c[c >= 0]] = 1
        return out

    def near(i: int, j: int) -> np.ndarray:
        if split and (i + block <= split or j >= split):  # both on one side
            return np.zeros((0, 0), bool)
        both = (dense(i) @ dense(j).T).astype(np.float64)
        hit = both / np.maximum(1, size[i : i + block, None] + size[None, j : j + block] - both) >= similarity
        if split:
            hit &= (np.arange(i, i + len(hit)) >= split)[:, None] & (np.arange(j, j + hit.shape[1]) < split)[None, :]
        return hit

    _, first, back = np.unique(roots, return_index=True, return_inverse=True)
    return spanning(first[back], near, block)


def _cells_of(segments: np.ndarray, wide: bool):
    """Rows (node, w0, w1, ...) in; each of their cells out, with the row or with the number of rows in the batch."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in ("node", *(f"w{k}" for k in range(WIDE)))]
            at = cells(np.stack(columns[1:], axis=1), segments).ravel()
            if wide:
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.repeat(c, len(segments))) for c in columns)], ["cell", "node", *(f"w{k}" for k in range(WIDE))])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(at, return_counts=True)], ["cell", "n"])

    return run


def _link_cells(segments: np.ndarray, most: int):
    """Rows sorted by cell, low and high in; links between close fingerprints of each out."""

    def links_of(at: tuple, rows: list) -> pa.RecordBatch:
        rows = np.concatenate(rows)
        w = np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
        pairs = cell_links(w, near_values(w, segments[at[0] >> 40]), most)
        return pa.RecordBatch.from_arrays([pa.array(rows[pairs[:, k], 0]) for k in range(2)], ["u", "v"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in ("cell", "low", "high")], axis=1)
            rows = np.stack([batch.column(k).to_numpy() for k in ("node", *(f"w{k}" for k in range(WIDE)))], axis=1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for i, j in zip(edges, edges[1:]):
                key = tuple(at[i].tolist())
                if key != now and held:
                    yield links_of(now, held)
                    held = []
                now = key
                held.append(rows[i:j])
        if held:
            yield links_of(now, held)

    return run


def close_links(nodes: DataFrame, similarity: float, home: int | None = None, tile: int | None = None) -> DataFrame:
    """Links (u, v) that connect the wide fingerprints (node, w0, w1, ...) that sets of ``similarity`` have.

    Multi-index hashing: each segment of the bits has a table.  Its home bits name the cell that a fingerprint is dealt to, within it
    those in a ball around the segment's other bits are looked up, and the complete distance of all bits decides.  The home bits grow with
    the corpus, so that a cell has some 16 times the root of all rows; a cell of over twice that, ``tile``, is dealt to pairs of tiles.
    """
    spark = nodes.sparkSession
    rows = nodes.count()
    home = max(0, math.ceil(math.log2(max(1, rows)) / 2 - 4)) if home is None else home
    tile = tile or max(TILE, math.ceil(16 * math.sqrt(rows)))
    most, segments = tables(similarity, home)
    words = ", ".join(f"w{k} long" for k in range(WIDE))
    count = nodes.mapInArrow(trimmed(_cells_of(segments, False)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    large = written(count.where(F.col("n") > 2 * tile).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    dealt = nodes.mapInArrow(trimmed(_cells_of(segments, True)), f"cell long, node long, {words}")
    if large.isEmpty():
        dealt = dealt.withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    else:  # a pair of tiles holds each of the two in full
        dealt = dealt.join(F.broadcast(large), "cell", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda t: F.col("tiles").isNull() | (t != F.col("own")))
        dealt = dealt.withColumn("other", F.explode(others)).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    dealt = dealt.select("cell", "low", "high", "node", *(f"w{k}" for k in range(WIDE)))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "node")
    return dealt.mapInArrow(trimmed(_link_cells(segments, most)), "u long, v long")


#: Members of one point that a task compares among themselves; a point with more is dealt to tiles, and each pair of
#: tiles is a piece of work of its own.
TILE = 1024


def open_points(points: DataFrame, roots: DataFrame, tile: int = TILE) -> DataFrame:
    """(band, node, root, low, high, own) of the points (node, band) whose members may still hold links between components.

    A point of two members was settled with its hub.  Points of the same members are one.  Members of a point
    with k tiles come k times, for the pairs (low, high) of tiles that theirs, ``own``, is in.
    """
    rooted = points.select("node", "band").join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    same = [F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2")]
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *same).where("low < high and n > 2")
    mixed = mixed.groupBy("n", "low", "high", "h1", "h2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = rooted.join(mixed, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.select("band", "node", "root", "own", other.alias("other"))
    return dealt.select("band", "node", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")


def _link_points(words: int, similarity: float):
    """Rows (band, low, high, own, node, root, text) sorted by these in; links between near members of two tiles, or of one, out."""

    def links_of(at: tuple, rows: list) -> pa.RecordBatch:
        _, low, high = at
        node = np.array([r[1] for r in rows], np.int64)
        split = sum(r[0] == low for r in rows) if low < high else 0
        none = low < high and split in (0, len(rows))
        pairs = np.zeros((0, 2), np.int64) if none else set_links([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), similarity, split=split)
        return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["u", "v"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for band, low, high, own, node, root, text in zip(*(batch.column(k).to_pylist() for k in ("band", "low", "high", "own", "node", "root")), batch.column("text").cast(pa.binary())):
                if (band, low, high) != now and rows:
                    yield links_of(now, rows)
                    rows = []
                now = (band, low, high)
                rows.append((own, node, root, shingle_set(text.as_py(), words)))
        if rows:
            yield links_of(now, rows)

    return run


def open_links(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect all near members of each of the open points ``members``; no pairs leave the tasks."""
    spark = members.sparkSession
    dealt = members.join(texts, "node").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "band", "low", "high").sortWithinPartitions("band", "low", "high", "own", "node")
    return dealt.mapInArrow(trimmed(_link_points(words, similarity)), "u long, v long")


def near_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose texts (node, text) are near by their shingle sets."""
    v = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    u = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    return pairs.join(v, "v").join(u, "u").where(near_udf(words, similarity)("text_u", "text_v")).select("u", "v")


_FIRST_ID = -(1 << 63)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_WORDS, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """``df`` with one row of each group of near duplicates: the one of the smallest id.

    Texts are near if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity``
    or more; groups are the connected components.  Equal sets collapse first.  SimHash fingerprints of the sets are searched by
    multi-index hashing (``close_links``), the texts themselves decide each link.  Each member of what is connected by
    fingerprints is held against one hub; where they are not all connected then, against each other.  Texts without a word
    are one group.  Null text counts as empty; a null id is smaller than any other.  Of rows of one id the smaller
    64-bit hash of the text decides, of equal rows one stays.  Columns of ``df`` stay as they are.
    """
    short_batches(df.sparkSession)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    keyed = df.withColumn("__id", F.coalesce(df[id_col].cast("long"), F.lit(_FIRST_ID))).withColumn("__hash", F.xxhash64(text))
    rows = written(keyed.select("__id", "__hash", set_udf(words)(text).alias("s")).select("__id", "__hash", "s.node", "s.w"))
    nodes = written(rows.groupBy("node").agg(F.min(F.struct("__id", "__hash")).alias("low"), F.first("w").alias("w")))

    close = components(close_links(nodes.where("w is not null").select("node", "w.*"), similarity))
    points = written(close.select("node", F.col("root").alias("band")).unionByName(close.select(F.col("root").alias("node"), F.col("root").alias("band")).distinct()))
    hubs = points.where("node <> band").select(F.col("band").alias("u"), F.col("node").alias("v"))
    found = written(near_pairs(hubs, _texts(keyed, text, nodes, points), words, similarity))
    rest = written(open_points(points, components(found), tile))
    found = found.unionByName(written(open_links(rest, _texts(keyed, text, nodes, rest.select("node")), words, similarity)))

    roots = components(found).withColumnRenamed("node", "__n")
    named = nodes.join(roots, F.col("node") == F.col("__n"), "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("low").alias("low"))
    keep = named.select(F.col("low.__id").alias("__kid"), F.col("low.__hash").alias("__khash"))
    kept = keyed.join(keep, (F.col("__id") == F.col("__kid")) & (F.col("__hash") == F.col("__khash")), "left_semi")
    return kept.dropDuplicates(["__id", "__hash"]).select(*df.columns)


def _texts(keyed: DataFrame, text: Column, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of the nodes asked for, each once, from the row that names the node."""
    ends = asked.select(F.col("node").alias("__n")).distinct()
    named = nodes.join(ends, F.col("node") == F.col("__n")).select("node", F.col("low.__id").alias("__kid"), F.col("low.__hash").alias("__khash"))
    own = keyed.select("__id", "__hash", text.alias("__text"))
    met = own.join(named, (F.col("__id") == F.col("__kid")) & (F.col("__hash") == F.col("__khash"))).select("node", F.col("__text").alias("text"))
    return written(met.dropDuplicates(["node"]))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
