"""Removal of passages that start earlier elsewhere: exact, by suffix arrays over shards of candidates.

A string is ``LENGTH`` bytes.  Sorting all suffixes of a corpus in one array can't be dealt
out, so strings are first given to shards by content: of the hashes of a string's 32-byte
windows the smallest is its *anchor* (winnowing: Schleimer, Wilkerson and Aiken, 2003).  Equal
strings have equal anchors at equal offsets, so they meet in the anchor's shard.

1. Each document's anchors, with a hash of all the bytes that a string around the anchor can
   hold (its context).  Equal contexts in one Arrow batch leave it as one row.
2. By anchor: of equal contexts all but the first are repeats, whole.  An anchor with a single
   context needs nothing more; most of any corpus ends here, without a byte being moved.
3. The first of each context of the remaining anchors is cut out of its text, and shards of
   those pieces get suffix arrays and common prefixes; runs of 100 and more common bytes are
   the equal strings.  An anchor with more pieces than a shard holds is cut into shards that
   are merged by binary search in the task; one with more than PART_CONTEXTS pieces also
   into parts for several tasks, whose different strings meet once more as sorted runs of digests.
4. Removed bytes are gathered by document and cut out of the texts.

Every step is keyed by anchor or document; nothing is compared pair by pair, no group is
capped, and only documents' own rows are ever as long as a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import pieces, short_batches, table, trimmed, written
from foliant.llm.suffixes import merge_shards, repeats

LENGTH = 100
ANCHOR = 32
SHARD_BYTES = 1 << 18
#: Contexts of an anchor that one task searches at once; an anchor with more is cut into parts.
PART_CONTEXTS = 4096
#: Bytes of text hashed at once in a Python worker.
CHUNK_BYTES = 1 << 20

_NO_ID = -(1 << 63)
_M = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M(0x9E3779B97F4A7C15))


def window_hashes(data: np.ndarray, width: int = ANCHOR) -> np.ndarray:
    """64-bit hashes of all ``width``-byte windows; the width is a power of two."""
    with np.errstate(over="ignore"):
        h, base, size = _BYTE[data], _M(0x9E6C63D0876A68DF), 1
        while size < width:
            h = h[:-size] * base + h[size:]
            base, size = base * base, 2 * size
        return _mix(h)


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the documents data[begin:end], each of at least ``length`` bytes.

    Returns (document number, place in the document, anchor hash, context hash).
    """
    empty = np.zeros(0, np.int64)
    if not len(begin):
        return empty, empty, empty, empty
    reach, windows = length - width, length - width + 1
    hashes = window_hashes(data, width)
    low = (hashes & _M(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= windows:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < windows:
        low = np.minimum(low[: len(low) - (windows - size)], low[windows - size :])
    starts = np.zeros(len(low) + 1, np.int32)  # strings that don't cross documents
    np.add.at(starts, begin, 1)
    np.add.at(starts, np.minimum(end - length + 1, len(low)), -1)
    chosen = np.zeros(len(data), bool)
    chosen[(low[np.cumsum(starts[:-1]) > 0] & _M(0xFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(begin, at, side="right") - 1
    left, right = np.minimum(at - begin[doc], reach), np.minimum(end[doc] - width - at, reach)
    with np.errstate(over="ignore"):
        context = _mix((left * 4096 + right).astype(np.uint64) + _M(1))
        for offset in [*range(-reach, reach, width), reach]:
            context = (context ^ hashes[at + np.clip(offset, -left, right)]) * _M(0x9FB21C651E98DF25)
            context ^= context >> _M(29)
    return doc, at - begin[doc], hashes[at].view(np.int64), context.view(np.int64)


_ROW = "key long, kind byte, anchor long, context long, doc long, tie long, at int, left short, right short"


def _rows(key, kind, anchor, context, doc, tie, at, left, right) -> pa.RecordBatch:
    n = len(at)
    kinds = np.full(n, kind, np.int8)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, kinds, anchor, context, doc, tie, at.astype(np.int32), left.astype(np.int16), right.astype(np.int16))], ["key", "kind", "anchor", "context", "doc", "tie", "at", "left", "right"])


def _find_anchors(length: int, width: int):
    reach = length - width

    def one(docs: list[bytes], ids: np.ndarray, ties: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(d) for d in docs], np.int64)
        end = np.cumsum(sizes)
        number, at, anchor, context = anchors(np.frombuffer(b"".join(docs), np.uint8), end - sizes, end, length, width)
        left, right = np.minimum(at, reach), np.minimum(sizes[number] - width - at, reach)
        doc, tie = ids[number], ties[number]
        order = np.lexsort((at, tie, doc, context, anchor))
        anchor, context, doc, tie, at, left, right = (x[order] for x in (anchor, context, doc, tie, at, left, right))
        again = np.zeros(len(at), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
        itself = again & (doc == doc[first]) & (tie == tie[first]) & (at == at[first])
        keep, gone = ~again, again & ~itself
        yield _rows(anchor[keep], 0, *(x[keep] for x in (anchor, context, doc, tie, at, left, right)))
        if gone.any():  # repeats already; their key only spreads them
            with np.errstate(over="ignore"):
                spread = _mix(doc[gone].view(np.uint64) * _M(31) + at[gone].astype(np.uint64)).view(np.int64)
            yield _rows(spread, 1, *(x[gone] for x in (anchor, context, doc, tie, at, left, right)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("raw").to_pylist()
            ids, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            took, size = [], 0
            for k, t in enumerate(texts):
                if len(t) >= length:
                    took.append(k)
                    size += len(t)
                if size >= CHUNK_BYTES or (k == len(texts) - 1 and took):
                    yield from one([texts[i] for i in took], ids[took], ties[took])
                    took, size = [], 0

    return run


_FOUND = "mark boolean, anchor long, part int, doc long, tie long, first int, last int"


def _found(mark: bool, anchor, doc, tie, first, last, part=None) -> pa.RecordBatch:
    part = np.zeros(len(doc), np.int32) if part is None else part.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), mark)), *(pa.array(x) for x in (anchor, part, doc, tie, first.astype(np.int32), last.astype(np.int32)))], ["mark", "anchor", "part", "doc", "tie", "first", "last"])


def _by_anchor(length: int, width: int, part_contexts: int):
    """Sorted rows in; marks (removed bytes) and requests (contexts to cut out) out.

    A stream: of the rows before a batch only the first of the open context is kept, and of the
    open anchor how many contexts it had.  Requests of an anchor are numbered off in parts of
    ``part_contexts``, so that one with very many is searched by many tasks.
    """
    names = ("anchor", "context", "doc", "tie", "at", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: list[np.ndarray] | None = None  # the first row of the open context
        before = 0  # contexts of the open anchor, the open one included
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            cols = [batch.column(c).to_numpy() for c in names]
            cols = [x.astype(np.int64) if c in ("at", "left", "right") else x for c, x in zip(names, cols)]
            done = kind == 1
            if done.any():
                a, _, d, t, at, left, right = (x[done] for x in cols)
                yield _found(True, a, d, t, at - left, at + width + right)
            cols = [x[~done] for x in cols]
            if not len(cols[0]):
                continue
            carried = open_row is not None
            if carried:
                cols = [np.concatenate([o, x]) for o, x in zip(open_row, cols)]
            anchor, context, doc, tie, at, left, right = cols
            n = len(at)
            new_anchor, new_context = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_context[1:] = new_anchor[1:] | (context[1:] != context[:-1])
            first = np.maximum.accumulate(np.where(new_context, np.arange(n), 0))
            begin, end = at - left, at + width + right
            whole = end - begin >= length
            itself = (doc == doc[first]) & (tie == tie[first]) & (at == at[first])
            gone = ~itself & whole
            if gone.any():
                yield _found(True, anchor[gone], doc[gone], tie[gone], begin[gone], end[gone])
            which = np.cumsum(new_anchor) - 1
            count = np.cumsum(new_context)
            number = count - count[np.flatnonzero(new_anchor)][which]  # of the context in its anchor
            if carried:
                number = np.where(which == 0, number + before - 1, number)
            total = np.zeros(which[-1] + 1, np.int64)
            np.maximum.at(total, which, number + 1)
            ask = new_context & (total[which] > 1)
            if carried and before > 1:
                ask[0] = False  # it was asked for when it came
            ask &= whole
            if ask.any():
                yield _found(False, anchor[ask], doc[ask], tie[ask], begin[ask], end[ask], number[ask] // part_contexts)
            last = first[-1]
            open_row, before = [x[last : last + 1] for x in cols], int(number[-1]) + 1

    return run


def _cut_contexts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            raws, ids, ties = batch.column("raw").to_pylist(), batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            asked = batch.column("asked")
            per = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            which = np.repeat(np.arange(len(raws)), per)
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            cut = [raws[w][a:b] for w, a, b in zip(which.tolist(), first.tolist(), last.tolist())]
            out = pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("part"), pa.array(ids[which]), pa.array(ties[which]), pa.array(first), pa.array(cut, pa.binary())], ["anchor", "part", "doc", "tie", "first", "raw"])
            for at in range(0, out.num_rows, 10_000):
                yield out.slice(at, 10_000)

    return run


#: A row marks removed bytes, or holds a run: digests of a part's different strings in one range, sorted, and where they start.
_SEARCHED = "mark boolean, digests int, run binary, doc long, tie long, first int, last int"
_RUN = np.dtype([("d0", "<i8"), ("d1", "<i8"), ("doc", "<i8"), ("tie", "<i8"), ("first", "<i4")])
#: Digests are dealt to ranges of about so many; there are 2**RANGE_BITS ranges at least.
RANGE_ROWS = 100_000
RANGE_BITS = 12


def _digests(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each string: two hashes of its 32-byte windows."""
    hashes = window_hashes(data)
    with np.errstate(over="ignore"):
        d0, d1 = np.full(len(at), _M(length)), np.full(len(at), _M(~length & 0xFFFFFFFF))
        for offset in [*range(0, length - ANCHOR, ANCHOR), length - ANCHOR]:
            h = hashes[at + offset]
            d0 = _mix(d0 ^ h)
            d1 = (d1 + h) * _M(0x9FB21C651E98DF25)
            d1 ^= d1 >> _M(32)
    return d0.view(np.int64), d1.view(np.int64)


def _search_shards(length: int, shard_bytes: int, part_contexts: int, range_bits: int = RANGE_BITS):
    """Whole parts of anchors in, sorted; removed bytes out, found by suffix arrays.

    Of an anchor that has several parts also the digests of each part's different strings
    go out, for the last merge.
    """

    def shard(raws: list[bytes], rank0: np.ndarray, first: np.ndarray):
        """data, room and rank of each byte: rank0 orders the documents, then the place counts."""
        sizes = np.array([len(r) for r in raws], np.int64)
        end = np.cumsum(sizes)
        inside = np.arange(int(end[-1])) - np.repeat(end - sizes, sizes)
        return np.frombuffer(b"".join(raws), np.uint8), np.repeat(sizes, sizes) - inside, np.repeat(rank0 << 32, sizes) + np.repeat(first, sizes) + inside

    def out(mark: bool, digests: np.ndarray, runs: list[bytes | None], who: np.ndarray, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(who), mark)), pa.array(digests.astype(np.int32)), pa.array(runs, pa.binary()), pa.array(who[:, 0]), pa.array(who[:, 1]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["mark", "digests", "run", "doc", "tie", "first", "last"])

    def runs_of(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A part's strings as one sorted run for each range of digests."""
        rows = np.sort(np.concatenate(found), order=["d0", "d1", "doc", "tie", "first"])
        where = rows["d0"].view(np.uint64) >> _M(64 - range_bits)
        order = np.argsort(where, kind="stable")  # signed and unsigned order differ
        rows, where = rows[order], where[order]
        a = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        b = np.append(a[1:], len(rows))
        none = np.zeros((len(a), 2), np.int64)
        yield out(False, where[a], [rows[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], none, none[:, 0], none[:, 0])

    def report(rank: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ranks of repeated strings' starts as merged runs of bytes."""
        rank = np.unique(rank)
        if not len(rank):
            return
        apart = np.ones(len(rank), bool)
        apart[1:] = rank[1:] - rank[:-1] > length  # also between documents: their ranks are 2**32 apart
        a = np.flatnonzero(apart)
        b = np.append(a[1:], len(rank)) - 1
        yield out(True, np.zeros(len(a)), [None] * len(a), docs[rank[a] >> 32], rank[a] & 0xFFFFFFFF, (rank[b] & 0xFFFFFFFF) + length)

    def search(rows: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = Counter(r[:2] for r in rows)
        split = {p for p, n in sizes.items() if p[1] > 0 or n >= part_contexts}  # there are, or may be, other parts
        docs = sorted({(r[2], r[3]) for r in rows})
        number = {d: k for k, d in enumerate(docs)}
        docs = np.array(docs, np.int64)
        shards, now, size = [], [], 0
        for r in rows:
            now.append(r)
            size += len(r[5])
            if size >= shard_bytes:
                shards.append(now)
                now, size = [], 0
        if now:
            shards.append(now)
        kept, gone = [], []
        for part in shards:
            data, room, rank = shard([r[5] for r in part], np.array([number[r[2], r[3]] for r in part], np.int64), np.array([r[4] for r in part], np.int64))
            repeated, first = repeats(data, room, rank, length)
            gone.append(rank[repeated])
            kept.append((data, first, rank[first], np.repeat(np.array([r[:2] in split for r in part]), [len(r[5]) for r in part])[first]))
        beaten = merge_shards([k[:3] for k in kept], length) if len(kept) > 1 else [np.zeros(len(k[1]), bool) for k in kept]
        strings = []
        for (data, first, rank, parted), lost in zip(kept, beaten):
            gone.append(rank[lost])
            more = parted & ~lost
            if more.any():
                found = np.zeros(int(more.sum()), _RUN)
                found["d0"], found["d1"] = _digests(data, first[more], length)
                found["doc"], found["tie"] = docs[rank[more] >> 32].T
                found["first"] = rank[more] & 0xFFFFFFFF
                strings.append(found)
        if strings:
            yield from runs_of(strings)
        yield from report(np.concatenate(gone), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "doc", "tie", "first", "raw"))):
                if size >= shard_bytes and row[:2] != rows[-1][:2]:  # shards of whole parts
                    yield from search(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield from search(rows)

    return run


def _merge_runs(length: int):
    """Runs in, sorted by range: all but the first start of a digest are removed bytes.

    A range's runs are merged two by two: the places of one run's digests in the other are found by binary search.
    """

    def merge(runs: list[np.ndarray]) -> np.ndarray:
        while len(runs) > 1:
            pairs = []
            for x, y in zip(runs[::2], runs[1::2]):
                at = np.searchsorted(x["d0"], y["d0"]) + np.arange(len(y))
                both = np.empty(len(x) + len(y), _RUN)
                own = np.ones(len(both), bool)
                own[at] = False
                both[own], both[at] = x, y
                pairs.append(both)
            runs = pairs + ([runs[-1]] if len(runs) % 2 else [])
        return runs[0]

    def removed(runs: list[bytes]) -> pa.RecordBatch:
        rows = merge([np.frombuffer(r, _RUN) for r in runs])
        same = np.zeros(len(rows), bool)
        same[1:] = rows["d0"][1:] == rows["d0"][:-1]
        near = same.copy()
        near[:-1] |= same[1:]
        rows = np.sort(rows[near], order=["d0", "d1", "doc", "tie", "first"])  # only digests that come again
        new = np.ones(len(rows), bool)
        new[1:] = (rows["d0"][1:] != rows["d0"][:-1]) | (rows["d1"][1:] != rows["d1"][:-1])
        head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))] if len(rows) else rows
        rows = rows[~((rows["doc"] == head["doc"]) & (rows["tie"] == head["tie"]) & (rows["first"] == head["first"]))]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (rows["doc"], rows["tie"], rows["first"], rows["first"] + np.int32(length))], ["doc", "tie", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for where, r in zip(batch.column("digests").to_pylist(), batch.column("run").to_pylist()):
                if where != now and held:
                    yield removed(held)
                    held = []
                now = where
                held.append(r)
        if held:
            yield removed(held)

    return run


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in [first, last)."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    apart = np.ones(len(first), bool)
    apart[1:] = first[1:] > last[:-1]
    a = np.flatnonzero(apart)
    return list(zip(first[a].tolist(), last[np.append(a[1:], len(first)) - 1].tolist()))


def _cut_out():
    kind = pa.struct([("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    @F.arrow_udf("struct<kept:binary,spans:array<struct<start:long,end:long>>>")
    def udf(raw: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for r, m in zip(raw.to_pylist(), marks):
            if not m.is_valid or not len(m.values):
                out.append({"kept": r, "spans": []})
                continue
            spans = merged(m.values.field("first").to_numpy().astype(np.int64), m.values.field("last").to_numpy().astype(np.int64))
            edges = [0, *(x for s in spans for x in s), len(r)]
            out.append({"kept": b"".join(r[a:b] for a, b in zip(edges[::2], edges[1::2])), "spans": [{"start": a, "end": b} for a, b in spans]})
        return pa.array(out, kind)

    return udf


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, part_contexts: int = PART_CONTEXTS, name: str = "dedup") -> DataFrame:
    """``df`` with a struct ``name`` of raw (UTF-8 bytes), kept (what is left of them) and spans (removed runs of bytes).

    A byte goes if a ``length``-byte string over it also starts earlier: in a document of smaller
    id, or in the same one before.  Matches never cross documents and are judged on the input.
    Null text counts as empty.  A null id comes before all others.  Rows of equal id
    and equal text are one document: each gets its result.  Rows of equal id and different
    texts come one before the other by the texts' 64-bit hashes.  Columns of ``df`` stay.
    """
    spark = df.sparkSession
    short_batches(spark)
    source = df.withColumn("__raw", F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary"))
    source = source.withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))).withColumn("__tie", F.xxhash64("__raw"))
    bare = source.select(F.col("__doc").alias("doc"), F.col("__tie").alias("tie"), F.col("__raw").alias("raw"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bare.where(F.octet_length("raw") >= length).mapInArrow(trimmed(_find_anchors(length, ANCHOR)), _ROW)
    rows = rows.repartition(parts, "key").sortWithinPartitions("anchor", "context", "doc", "tie", "at")
    found = written(rows.mapInArrow(trimmed(_by_anchor(length, ANCHOR, part_contexts)), _FOUND))

    asked = found.where("not mark").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "part", "first", "last")).alias("asked"))
    cut = bare.join(asked, ["doc", "tie"]).mapInArrow(trimmed(_cut_contexts()), "anchor long, part int, doc long, tie long, first int, raw binary")
    # Strings that the runs of split anchors can hold: a context has at most length - ANCHOR + 1 of them.
    many = found.where("not mark and part > 0").count() * (length - ANCHOR + 1)
    range_bits = min(24, max(RANGE_BITS, (2 * many // RANGE_ROWS).bit_length()))
    cut = cut.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part", "doc", "tie", "first")
    searched = written(cut.mapInArrow(trimmed(_search_shards(length, shard_bytes, part_contexts, range_bits)), _SEARCHED))
    across = searched.where("not mark").select("digests", "run").repartition(parts, "digests").sortWithinPartitions("digests")
    across = across.mapInArrow(trimmed(_merge_runs(length)), "doc long, tie long, first int, last int")

    marks = found.where("mark").select("doc", "tie", "first", "last").unionByName(searched.where("mark").select("doc", "tie", "first", "last")).unionByName(across)
    marks = marks.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("__marks"))
    marks = marks.select(F.col("doc").alias("__d"), F.col("tie").alias("__t"), "__marks")
    out = source.join(marks, (F.col("__doc") == F.col("__d")) & (F.col("__tie") == F.col("__t")), "left")
    out = out.withColumn("__cut", _cut_out()("__raw", "__marks"))
    return out.withColumn(name, F.struct(F.col("__raw").alias("raw"), F.col("__cut.kept"), F.col("__cut.spans"))).drop("__raw", "__doc", "__tie", "__d", "__t", "__marks", "__cut")


def as_text(raw_col: str):
    """Bytes as text; those of a character that was cut go."""

    @F.arrow_udf("string")
    def udf(raw: pa.Array) -> pa.Array:
        return pa.array([None if r is None else r.decode("utf-8", "ignore") for r in raw.to_pylist()], pa.string())

    return udf(F.col(raw_col))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "dedup.*")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
