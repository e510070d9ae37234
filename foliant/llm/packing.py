"""Packing of tokenised documents into fixed-length sequences by hierarchical best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import WordMemo, id_text, pieces, short_batches, table, trimmed, written

CAPACITY = 4096
END_ID = 1
#: A bin with at most this many free places is emitted; others go up the tree as items.
SLACK = 4
FAN_IN = 8
#: What one task above the first level takes, in bins and in members of bins.
TASK_BINS, TASK_MEMBERS = 16_384, 1 << 20
#: Words whose ids a Python worker keeps, at about 200 bytes each.  Bounds memory only.
CACHE_WORDS = 600_000
#: Stands between words on their way through the tokenizer; words that have it go alone.
MARK = "½"
_TAIL = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"

_MEMBER = pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = "length int, sequence_id long, closed boolean, members array<struct<id:long,piece:int,start:long,length:long,ids_crc32:long>>"


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, word by word.

    For a tokenizer that drops white space, lower-cases and never joins characters across
    white space, the ids of a text are those of its blank-separated words in turn, so each
    different word is encoded once.  New words go through the tokenizer many at a time, as one
    text with MARK between them: a numeral is a token of its own, so its id parts the words'.
    Special strings in a text are special tokens, as in the tokenizer's plain call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids(MARK)
        self.memo = WordMemo(self._encode, CACHE_WORDS)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # bytes: only A-Z change, the tokenizer does the rest.  Special strings are told by their case.
        return self.memo([(t if b"<|" in t else t.lower()).split() for t in texts])

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words.  Punctuation that ends a word is tokens of its own, so what stands before it is encoded once."""
        memo, whole, ended = self.memo, [], []
        for w in words:
            stem = w.rstrip(_TAIL)
            if len(stem) < len(w) and stem[-1:].isalnum() and b"<|" not in w:  # an ASCII letter or digit
                ended.append((w, stem, w[len(stem) :]))
            else:
                whole.append(w)
        parts = {p for _, stem, tail in ended for p in (stem, tail)}.difference(whole)
        seen = {p: got for p in parts if (got := memo.get(p)) is not None}
        seen.update(self._encode_whole([*whole, *parts.difference(seen)]))
        for w, stem, tail in ended:
            seen[w] = seen[stem] + seen[tail]
        return seen

    def _encode_whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = b"\n".join(words).decode().split("\n") if words else []
        alone = {w: np.array(self._ids(t), "<u4").tobytes() for w, t in zip(words, texts) if MARK in t}
        if alone:
            words, texts = [w for w in words if w not in alone], [t for t in texts if MARK not in t]
        ids = np.array(self._ids(MARK.join(texts)), "<u4")
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != max(0, len(words) - 1):
            raise ValueError(f"{MARK} is no token of its own in this tokenizer")
        data, at = ids.tobytes(), (4 * marks).tolist()
        return alone | {w: data[a:b] for w, a, b in zip(words, [0, *(x + 4 for x in at)], [*at, len(data)])}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a path, made once in a Python worker: its words serve later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item, in the order given, and what each bin holds: each item goes to the
    fullest bin that takes it.  Bins are found in a bit set of free places."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, fill = 0, [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        fill[b] += n
        room -= n
        if room:
            free[room].append(b)
            mask |= 1 << room
    return bins, fill


def pack_items(length: np.ndarray, members: pa.ListArray, capacity: int, slack: int, first_id: int) -> pa.RecordBatch:
    """Best fit of items (lists of members), longest first, ties by place; a row a bin."""
    order = np.argsort(-length, kind="stable")
    bins, fill = best_fit(length[order].tolist(), capacity)
    bins = np.array(bins, np.int64)
    by_bin = np.argsort(bins, kind="stable")
    taken = members.take(pa.array(order[by_bin]))
    counts = np.diff(taken.offsets.to_numpy())
    per_bin = np.bincount(bins[by_bin], weights=counts, minlength=len(fill)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
    fill = np.array(fill, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(fill), pa.array(first_id + np.arange(len(fill), dtype=np.int64)), pa.array(capacity - fill <= slack), pa.ListArray.from_arrays(pa.array(offsets), taken.flatten())],
        ["length", "sequence_id", "closed", "members"],
    )


def _sorted_members(length: np.ndarray, members: pa.ListArray) -> tuple[np.ndarray, pa.ListArray]:
    """Items in the order of their first member's id and piece, so that a task run again packs alike."""
    first = members.flatten().take(pa.array(members.offsets.to_numpy()[:-1]))
    ids, piece = first.field("id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), first.field("piece").to_numpy(zero_copy_only=False)
    order = np.lexsort((length, piece, ids))
    return length[order], members.take(pa.array(order))


def _first_id(level: int) -> int:
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def _tokenise_and_pack(path: str, capacity: int, slack: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        ids, no, start, length, crc = [], [], [], [], []
        for batch in pieces(batches):
            for doc, ids_ in zip(batch.column("id").to_pylist(), encode(batch.column("text").cast(pa.binary()).to_pylist())):
                ids_ += end
                for k, at in enumerate(range(0, len(ids_), 4 * capacity)):
                    part = ids_[at : at + 4 * capacity]
                    ids.append(doc), no.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
        if not ids:
            return
        members = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((ids, no, start, length, crc), _MEMBER)], fields=list(_MEMBER))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), members)
        yield from _in_batches(pack_items(*_sorted_members(np.array(length, np.int64), lists), capacity, slack, _first_id(0)))

    return run


def _pack_again(level: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        members = whole.column("members").combine_chunks()
        members = members if isinstance(members, pa.ListArray) else pa.concat_arrays(members.chunks)
        members = members.cast(pa.list_(_MEMBER)) if members.type != pa.list_(_MEMBER) else members
        length = whole.column("length").to_numpy().astype(np.int64)
        yield from _in_batches(pack_items(*_sorted_members(length, members), capacity, slack, _first_id(level)))

    return run


def _in_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 2000):
        yield batch.slice(at, 2000)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, task_bins: int = TASK_BINS) -> DataFrame:
    """A row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Each partition tokenises its documents and packs its pieces by best fit, longest first.
    Bins with at most ``slack`` free places are done; the others, with all they hold, become
    the items of the next level, ``FAN_IN`` partitions to one, but no task gets more than
    TASK_BINS bins and TASK_MEMBERS members on average.  The tree ends in a single partition, or where the open bins
    are so many that partitions can't get fewer: pieces of over half a sequence, say, of which no two go together.
    Every level is written before the next reads it, and items are sorted, so a task that runs again packs alike.

    Null and empty texts make one piece of the end id alone.  Repeated rows are packed each.
    No rows in, no rows out.
    """
    short_batches(df.sparkSession)
    rows = id_text(df, id_col, text_col)
    level, parts = 0, max(1, rows.rdd.getNumPartitions())
    now = written(rows.withColumn("id", F.col("id").cast("long")).mapInArrow(trimmed(_tokenise_and_pack(tokenizer, capacity, slack, end_id)), _BINS))
    done = [now.where("closed")]
    while True:
        open_ = now.where("not closed")
        bins, members = open_.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        fewer = max(-(-parts // FAN_IN), -(-bins // task_bins), -(-members // TASK_MEMBERS))
        if not bins or (level and fewer >= parts):
            done.append(open_)
            break
        level, parts = level + 1, fewer
        now = written(open_.repartition(parts, "sequence_id").mapInArrow(trimmed(_pack_again(level, capacity, slack)), _BINS))
        done.append(now.where("closed"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # Offsets are sums over the at most ``capacity`` members before.
    placed = out.select("sequence_id", F.posexplode("members").alias("at", "m"), F.col("members.length").alias("lengths"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select(F.col("m.id").alias(id_col), "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", before.alias("offset"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
