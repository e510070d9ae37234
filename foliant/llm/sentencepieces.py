"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton over the pieces reports, at each end position and along its output links, every piece
that ends there; each relaxes the best score of that position from the one at its start.

A unigram model's best path is the one of the highest sum of scores.  A BPE model has no
such sum: its encoding is the one that merges reach.  It is a path all the same, since a
sequence of pieces is what the merges leave if and only if each neighbouring pair is; so for BPE
a piece relaxes a position only if it and the best path's last piece are such a pair.  At each
position at most one path remains, and the ids are those of the merges.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import WordMemo, free_name, short_batches, table

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: What an unknown character's score is below the lowest of all.
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 600_000
CACHE_PAIRS = 1_000_000


class Pieces:
    """A model file's pieces, with ``encode`` and ``decode`` on single texts and lists of texts."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and escaped, leading blanks are supported")
        if trained.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.bpe, self.byte_fallback, self.prefix = trained.model_type == BPE, trained.byte_fallback, norm.add_dummy_prefix
        self.surface = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, k in enumerate(self.kind) if k == UNKNOWN)
        self.bytes_ = {int(self.surface[i][1:-1], 16): i for i, k in enumerate(self.kind) if k == BYTE}  # <0x0A> and so on
        self.low = min([self.score[i] for i in self.normal.values()], default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.normal.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        # Where no piece goes on from a character to a blank, or over a line end, texts part there
        # (but without bytes to fall back on, unknown characters to both sides are one id).
        self.parts = self.byte_fallback and not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.normal)
        self.raw = [s.replace(BLANK, " ").encode() for s in self.surface]
        for i, k in enumerate(self.kind):
            if k in (CONTROL, UNKNOWN):
                self.raw[i] = b"" if k == CONTROL else trained.unk_surface.encode()
        for b, i in self.bytes_.items():
            self.raw[i] = bytes([b])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.size = [len(x) for x in self.surface]
        #: Characters that are pieces; in a BPE model that holds all characters of its pieces, others part a text.
        self.known = {p for p in self.normal if len(p) == 1}
        self.reachable = self.bpe and all(self.known.issuperset(p) for p in self.normal)
        self.memo = WordMemo(lambda words: {w: np.array(self.viterbi(w.replace(" ", BLANK)), "<u4").tobytes() for w in words}, CACHE_WORDS)

    def merges(self, text: str) -> list[str]:
        """What BPE leaves of a text: of all neighbours whose union is a piece the best go first, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.normal.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _pair(self, a: int, b: int) -> bool:
        """Whether merges leave piece b after piece a; a < 0 stands for no piece or an unknown character."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            left = [self.surface[a]] if a >= 0 else []
            known = self.pairs[a, b] = self.merges("".join(left) + self.surface[b]) == [*left, self.surface[b]]
        return known

    def reach(self, text: str) -> list[int]:
        """Ids of a text of known characters under BPE: the pass of ``viterbi`` without its unknown characters.  A piece relaxes
        its end's best score if it makes the sum higher and may follow the best path to its start."""
        worst = float("-inf")
        best, last = [worst] * (len(text) + 1), [-1] * (len(text) + 1)
        best[0] = 0.0
        score, pairs, pair = self.score, self.pairs, self._pair
        for end, (size, i) in self.automaton.iter(text):
            end += 1
            total = best[end - size] + score[i]
            if total > best[end]:
                before = last[end - size]
                ok = pairs.get((before, i))
                if ok or ok is None and pair(before, i):
                    best[end], last[end] = total, i
        out, at = [], len(text)
        while at:
            i = last[at]
            out.append(i)
            at -= self.size[i]
        return out[::-1]

    def viterbi(self, text: str) -> list[int]:
        """Ids of an escaped text, by one pass over the automaton's reports."""
        if self.reachable and self.known.issuperset(text):
            return self.reach(text)
        n = len(text)
        worst = float("-inf")
        best, came, last = [worst] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        score, normal, pairs, bpe = self.score, self.normal, self.pairs, self.bpe
        done = 0  # positions up to here are final

        def alone(at: int) -> None:
            """An unknown character may stand for itself."""
            if text[at] not in normal and best[at] + self.low > best[at + 1]:
                best[at + 1], came[at + 1], last[at + 1] = best[at] + self.low, at, -1

        for end, (size, i) in self.automaton.iter(text):
            while done < end:
                alone(done)
                done += 1
            start = end + 1 - size
            total = best[start]
            if total == worst:
                continue
            if bpe:
                if not (pairs.get((last[start], i)) or self._pair(last[start], i)):
                    continue
            total += score[i]
            if total > best[end + 1]:
                best[end + 1], came[end + 1], last[end + 1] = total, start, i
        while done < n:
            alone(done)
            done += 1
        out: list[int] = []
        at = n
        while at > 0:
            start, i = came[at], last[at]
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes_[b] for b in reversed(text[start:at].encode()))
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
            at = start
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """A text with its added blank, parted where no piece crosses."""
        if not text:
            return []
        text = " " + text if self.prefix else text
        text = text.replace(BLANK, " ")
        return _WORDS.findall(text) if self.parts else [text]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes."""
        return self.memo([self.words(t) for t in texts])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


_WORDS = re.compile(r"\n| *[^ \n]+| +")
_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a path, loaded once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _texts(col: pa.Array) -> list[str]:
    return [t or "" for t in col.to_pylist()]


def encode(df: DataFrame, path: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text.  Null and empty texts have none; other columns stay,
    and where one has the name given, the new one gets an underscore more."""
    short_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def udf(text: pa.Array) -> pa.Array:
        got = pieces(path).encode_batch(_texts(text))
        sizes = np.array([0, *(len(g) // 4 for g in got)], np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.frombuffer(b"".join(got), "<i4")))

    return df.withColumn(free_name(df, name), udf(df[text_col].cast("string")))


def decode(df: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids; null for null ids, a replacement character for bytes that make none.
    Other columns stay; where one has the name given, the new one gets an underscore more."""
    short_batches(df.sparkSession)

    @F.arrow_udf("string")
    def udf(ids: pa.Array) -> pa.Array:
        p = pieces(path)
        return pa.array([None if i is None else p.decode(i) for i in ids.to_pylist()], pa.string())

    return df.withColumn(free_name(df, name), udf(df[ids_col]))


def digest(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip: whether decoding gives the text back.

    The blank sign U+2581 itself reads as a blank, as the format has it, so round_trip compares with those replaced.  Other columns stay; where one has such a name, the new one gets an underscore more.
    """
    short_batches(df.sparkSession)

    @F.arrow_udf("struct<n_ids:long,ids_crc32:long,round_trip:boolean>")
    def udf(text: pa.Array) -> pa.Array:
        p, n, crc, same = pieces(path), [], [], []
        texts = _texts(text)
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            for t, ids in zip(part, p.encode_batch(part)):
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(p.decode(np.frombuffer(ids, "<u4").tolist()) == t.replace(BLANK, " "))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["n_ids", "ids_crc32", "round_trip"])

    out = df.withColumn("__d", udf(df[text_col].cast("string")))
    return out.select(*df.columns, *(F.col(f"__d.{c}").alias(free_name(df, c)) for c in ("n_ids", "ids_crc32", "round_trip")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
