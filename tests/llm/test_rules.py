import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm.rules import filter_by_host, host_verdicts, op9_quality_rules, statistics
from foliant.llm.sql import SQL


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


def check(rows, texts):
    assert len(rows) == len(texts)
    have = sorted((r.doc_id is not None, r.doc_id, tuple(r)[1:7]) for r in rows)
    assert have == sorted((d is not None, d, plain(t)) for d, t in texts)
    assert not any(r.kept and r.base_failed for r in rows)


def test_every_case(docs, none):
    check(filter_by_host(docs).drop("failed", "host_rate").collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert filter_by_host(none).count() == 0


def test_letters_f_and_form_feeds_at_the_ends(spark):
    texts = ["free of", "f", "ff f", "fluff\nf\nf\nff\nf", "\x0cone two\x0c", "\x0c", "a\n\x0c\n\x0c\n\x0ca", "f\x0cf \x0c", "f " * 20, "\x0b\x0c\r of"]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    check(filter_by_host(spark.createDataFrame(rows, "doc_id long, text string, source string")).drop("failed", "host_rate").collect(), list(enumerate(texts)))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op9_quality_rules(spark, sf).collect()
    check(rows, texts)
    assert all(r.kept != r.base_failed for r in rows)  # no host there is bad


def test_query_rejects_a_bad_host_whole(spark, tmp_path):
    """Clean documents of a host that mostly fails go, those of others stay; Spark and the SQL agree."""
    import duckdb

    r = random.Random(5)
    clean = lambda: " ".join("".join(r.choices("abdeghiklmnorstu", k=5)) for _ in range(40))
    rows = [(k, clean() if k // 20 % 4 else "too short", f"good{k % 20}") for k in range(2000)]
    rows += [(2000 + k, clean() if k % 5 == 0 else "w " * 50, "bad") for k in range(300)]
    rows += [(2300 + k, "| " * 30, None) for k in range(50)] + [(2400, "tiny", "tiny"), (2401, clean(), "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_quality_rules(spark, str(tmp_path)).collect()
    by = {x.doc_id: x for x in got}
    assert all(by[2000 + k].kept is False for k in range(300)) and not by[2000].base_failed
    assert not any(by[2300 + k].kept for k in range(50)) and by[2401].kept
    assert all(by[k].kept != by[k].base_failed for k in range(2000))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    assert sorted(map(tuple, got)) == sorted(db.execute(f"SELECT {names} FROM ({SQL['op9_quality_rules']})").fetchall())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghijklmnopqrstuvwxyz \t\n\x0b\x0c\r", max_size=60), min_size=1, max_size=40))
def test_any_letters_and_blanks(spark, texts):
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    check(filter_by_host(spark.createDataFrame(rows, "doc_id long, text string, source string")).drop("failed", "host_rate").collect(), list(enumerate(texts)))


def test_columns_that_clash_stay(docs):
    mine = docs.select("text").withColumns({c: F.lit("mine") for c in ("n_words", "N_SYMBOLS", "n_words_")})
    out = statistics(mine)
    assert out.columns == ["text", "n_words", "N_SYMBOLS", "n_words_", "n_words__", "word_chars", "n_symbols_", "n_lines", "n_dup_lines", "n_repeat_words"]
    assert {(r.n_words, r.N_SYMBOLS, r.n_words_) for r in out.collect()} == {("mine", "mine", "mine")}


def test_host_rates_shrink(spark):
    rows = [(f"good{k % 30}", False) for k in range(3000)] + [("bad", True)] * 400 + [("tiny", True)] + [(None, True)] * 90
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert not got["bad"].host_kept and not got[None].host_kept and got["good3"].host_kept
    assert 0.1 < got["tiny"].rate < 1.0 and got["bad"].rate > 0.95  # one failed document says little
    assert got["bad"].n == 400 and got[None].failures == 90
