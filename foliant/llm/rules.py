"""Quality rules whose verdicts are given to whole hosts; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import free_name, table, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MOST_SYMBOLS = 40  # per cent of the words
MOST_DUP_LINES = 50  # per cent of the lines
#: A host is rejected if its shrunken failure rate is so many standard deviations of the fitted prior above the prior's
#: mean, and at least so large a part of the way from there to 1; a rate above the last figure always is.
HOST_DEVIATIONS, HOST_STEP, HOST_MOST = 1.5, 0.25, 0.95
#: The prior's weight, in documents, stays between these.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0

BLANKS = r" \t\n\u000B\u000C\r"  # SQL literals know no \f


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the rules' counts of each whole text; null counts as empty.  Columns of ``df`` stay, and where one has
    a count's name, the count gets an underscore more.

    n_repeat_words: each 8-word window gets a 64-bit hash.  Texts whose hashes all differ have
    none; in others the sorted (hash, place) pairs show which windows have an equal
    neighbour, and the words under those windows are counted.
    """
    t = df.withColumn("__text", F.coalesce(df[text_col].cast("string"), F.lit("")))
    t = t.withColumn("__trim", F.expr(f"trim(BOTH '{BLANKS}' FROM __text)"))
    t = t.withColumn("__words", F.expr(rf"if(__trim = '', array(), split(__trim, '[ \\t\\n\\u000B\\f\\r]+'))"))
    t = t.withColumn("__lines", F.expr(rf"filter(split(__text, '\\n'), x -> trim(BOTH '{BLANKS}' FROM x) <> '')"))
    t = t.withColumn(
        "__windows", F.expr(f"if(size(__words) < {WINDOW}, array(), transform(sequence(1, size(__words) - {WINDOW - 1}), i -> xxhash64(slice(__words, i, {WINDOW}))))")
    )
    t = t.withColumn("__sorted", F.expr("if(size(array_distinct(__windows)) = size(__windows), NULL, array_sort(transform(__windows, (h, i) -> struct(h AS h, i AS i))))"))
    t = t.withColumn("__at", F.expr("if(__sorted IS NULL, NULL, array_sort(transform(filter(transform(__sorted, (x, k) -> struct(x.i AS i, coalesce(x.h = get(__sorted, k - 1).h, false) OR coalesce(x.h = get(__sorted, k + 1).h, false) AS twice)), x -> x.twice), x -> x.i)))"))
    covered = f"if(__at IS NULL, 0L, aggregate(transform(__at, (x, k) -> least({WINDOW}, coalesce(get(__at, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x))"
    counts = {
        "n_words": "cast(size(__words) AS long)",
        "word_chars": "cast(char_length(array_join(__words, '')) AS long)",
        "n_symbols": "cast(char_length(__text) - char_length(translate(__text, '#*$%&|<>', '')) AS long)",
        "n_lines": "cast(size(__lines) AS long)",
        "n_dup_lines": "cast(size(__lines) - size(array_distinct(__lines)) AS long)",
        "n_repeat_words": covered,
    }
    return t.select(*df.columns, *(F.expr(e).alias(free_name(df, c)) for c, e in counts.items()))


def host_verdicts(rows: DataFrame, host_col: str = "host", failed_col: str = "failed") -> DataFrame:
    """A row a host: n, failures, rate shrunk by an empirical beta prior, kept.

    The prior's mean is the failure rate of all documents; its weight comes from the spread
    of the hosts' rates beyond what chance gives (method of moments).  Two sums reach the
    driver.  A null host is a host of its own.  The limit on rates comes from the prior too:
    a host is rejected if its rate is far above the mean by the prior's own spread.
    """
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed_col).cast("long")).alias("failures"))
    n, failures = hosts.agg(F.sum("n"), F.sum("failures")).first()
    if not n:
        mean, total = 0.5, LEAST_WEIGHT
    else:
        mean = min(max(failures / n, 1e-6), 1 - 1e-6)
        spread, chance, weight = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failures") / F.col("n") - mean, 2)), F.lit(mean * (1 - mean)) * F.count("*"), F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()
        between = (spread - chance * (1 - 1 / max(n, 1))) / weight if weight and weight > 0 else 0.0
        total = mean * (1 - mean) / between - 1 if between > 0 else MOST_WEIGHT
        total = min(max(total, LEAST_WEIGHT), MOST_WEIGHT)
    deviation = (mean * (1 - mean) / (total + 1)) ** 0.5
    most = min(mean + max(HOST_DEVIATIONS * deviation, HOST_STEP * (1 - mean)), HOST_MOST)
    rate = (F.col("failures") + mean * total) / (F.col("n") + total)
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= most)


def filter_by_host(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts, base_failed, host rate and verdict of every row.

    A row fails if it has under 20 words or over 30 % of its words in repeated 8-word windows
    (base_failed), or too many symbols or repeated lines; the host's rate counts all of these.
    ``kept`` is false for a row that base_failed and for all rows of a rejected host.

    Null and empty texts have no words, so they fail.  Null ids and repeated rows are rows
    like others.  The counts (no texts) are written once; hosts' totals are summed in the
    map tasks first, so that a host with a third of all rows is no burden, and joined
    back by host, where AQE broadcasts a small host table and splits a skewed host.
    """
    named = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[host_col].cast("string").alias("host"))
    rows = statistics(named).drop("text")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
    rows = written(rows.withColumn("base_failed", base).withColumn("failed", base | more))
    verdicts = host_verdicts(rows).select(F.col("host").alias("__host"), "rate", "host_kept")
    joined = rows.join(verdicts, rows.host.eqNullSafe(F.col("__host")))
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "failed", F.col("rate").alias("host_rate"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_by_host(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
