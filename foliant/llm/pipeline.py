"""The corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and its result, written
as Parquet and read again, is the next one's ``docs``.  All but the last return the columns of
``documents``.  Nulls in any column, empty texts and tables, repeated rows and further columns
whose names clash are taken by every stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import dedup, packing, secrets, simhash, toxicity
from foliant.llm.common import release, table, tables_written, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the threshold; the classifier is fitted on ``docs`` and the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, name="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (see ``simhash.keep_one``)."""
    return simhash.keep_one(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier elsewhere; n_chars follows.  Bytes of a cut character go too."""
    out = dedup.remove_repeats(docs, name="__dedup")
    kept = F.when(F.size("__dedup.spans") == 0, F.col("text")).otherwise(dedup.as_text("__dedup.kept"))
    return _same_columns(out.withColumn("text", kept), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; n_chars follows."""
    return _same_columns(secrets.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_passages),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; between them the rows are written in the shared folder, and what the
    stages before wrote there is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), tables_written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            release(spark, before, but_last=1)
    return docs


#: A fitted model, fingerprints, suffix arrays and a tokenizer can't be said in SQL.
ORACLE_SQL = None
