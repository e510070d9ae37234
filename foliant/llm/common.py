"""What the operators share: written tables that cut lineage, column selection and Arrow helpers.

Conventions that hold for every operator in this subpackage

* Only the named id and text columns are read, under internal names, so any
  further column (also one whose name clashes with an output) does no harm.
* A null text counts as the empty text; a null id is an id like any other.
* Repeated rows stay repeated rows.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: texts may be long, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="foliant-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends there,
    every later reader sees the same rows, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append(path)
    if len(_paths) == 1:
        atexit.register(lambda: release(spark))
    return spark.read.schema(df.schema).parquet(path)


#: Tables written by this driver and not released yet.
_paths: list[str] = []


def tables_written() -> int:
    return len(_paths)


def release(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Delete the tables that ``written`` made, all of them or those after the first ``since``, but the last ones.

    A result reads them when it is computed, so release them after its last use.  What is left goes when
    the driver ends; after a driver that was killed, the folder foliant-<application id> may be deleted by hand.
    """
    end = len(_paths) - but_last
    gone = _paths[since:end]
    del _paths[since:end]
    with contextlib.suppress(Exception):  # a stopped session deletes nothing
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for p in map(jvm.org.apache.hadoop.fs.Path, gone):
            p.getFileSystem(conf).delete(p, True)


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` and ``text`` (never null)."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def crc_mod(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; the folds of the classifiers.  A null id counts as ''."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while ``df`` has a column of that name (case aside, as Spark has it):
    an operator never writes over a caller's column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system at a task's end.

    Python workers stay for later tasks; what the allocators keep would add up on an executor.
    """

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return outer


def give_back() -> None:
    """Freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class WordMemo:
    """Bytes made of words, kept for words that come again, in two generations of bounded size.

    ``make`` gives a dict for a list of different words.  Words met again move to the younger
    generation; the older one is dropped when that is full.  Results never depend on the bound.
    """

    def __init__(self, make: Callable[[list], dict], bound: int):
        self.make, self.bound = make, bound
        self.young: dict = {}
        self.old: dict = {}

    def get(self, word: bytes | str) -> bytes | None:
        got = self.young.get(word)
        return self.old.get(word) if got is None else got

    def __call__(self, texts: list[list]) -> list[bytes]:
        young, old, new = self.young, self.old, []
        for w in set().union(*texts).difference(young):
            got = old.get(w)
            if got is None:
                new.append(w)
            else:
                young[w] = got
        for at in range(0, len(new), 50_000):
            young.update(self.make(new[at : at + 50_000]))
        get = young.__getitem__
        out = [b"".join(map(get, t)) for t in texts]
        if len(young) > self.bound // 2:
            self.young, self.old = {}, young
        return out
