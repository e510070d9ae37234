"""Secret scans with positions; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import free_name, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are whole either way, so the least length may stand in the pattern
HEX = r"[0-9a-f]{24,}"
CANDIDATE_LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{CANDIDATE_LEAST},}}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
WINDOW = 20
#: Least entropy, in bits a character, of some window of WINDOW characters, by character class.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.7),
}
#: Added spans whose text has one of these, in any case, are suppressed.
ALLOWED = ("example", "sample", "placeholder", "dummy", "changeme", "redacted", "xxxx", "0123456789", "abcdefgh", "sha256-", "sha512-")


def _q(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    return 'r"' + pattern.replace('"', r"\x22") + '"'


def _spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """SQL for the matches of a pattern as array<struct<start, kind, end, s>>, in code points.

    Matches and the stretches between them alternate, so running sums of their lengths are
    the places.  Matches whose ``group`` has under ``least`` characters are dropped afterwards.
    """
    p = _q(pattern)
    # Fields 0, 1 and 2: the match, its group, the stretch before it; the last stretch has no match.
    zipped = f"arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}), split({text}, {p}, -1))"
    empty = "cast(array() AS array<struct<start:int,kind:int,end:int,s:string>>)"
    step = f"""if(x.`0` IS NULL, a, named_struct('at', a.at + char_length(x.`2`) + char_length(x.`0`), 'out', if(char_length(x.`1`) < {least}, a.out,
        array_append(a.out, named_struct('start', a.at + char_length(x.`2`), 'kind', {kind}, 'end', a.at + char_length(x.`2`) + char_length(x.`0`), 's', x.`0`)))))"""
    return f"aggregate({zipped}, named_struct('at', 0, 'out', {empty}), (a, x) -> {step}, a -> a.out)"


def _entropy(name: str, spans: str) -> str:
    """SQL that narrows candidate spans of one class to the windows whose Shannon entropy is high.

    The window slides by a character: one count goes up, one goes down, and the sum of
    c * log2(c) follows by their differences; H = log2(W) - sum / W.
    """
    alphabet, least = CLASSES[name]
    w, kind = WINDOW, KINDS.index(name)
    f = lambda c: f"if({c} < 2, 0D, {c} * log2({c}))"
    enters = f"instr('{alphabet}', element_at(cs, i))"
    leaves = f"if(i > {w}, instr('{alphabet}', element_at(cs, i - {w})), 0)"
    moved = f"""named_struct('n', transform(a.n, (c, k) -> c + if(k + 1 = {enters}, 1, 0) - if(k + 1 = {leaves}, 1, 0)),
        'sum', a.sum + if({enters} = {leaves}, 0D, {f(f"(element_at(a.n, {enters}) + 1)")} - {f(f"element_at(a.n, {enters})")}
            + if(i > {w}, {f(f"(element_at(a.n, {leaves}) - 1)")} - {f(f"element_at(a.n, {leaves})")}, 0D)),
        'first', a.first, 'last', a.last)"""
    # The second step sees the new sum under the name b.
    judged = f"""element_at(transform(array({moved}), b -> if(i >= {w} AND log2({w}D) - b.sum / {w} >= {least}D,
        named_struct('n', b.n, 'sum', b.sum, 'first', coalesce(b.first, i - {w}), 'last', i), b)), 1)"""
    start = f"named_struct('n', array_repeat(0, {len(alphabet)}), 'sum', 0D, 'first', cast(NULL AS int), 'last', cast(NULL AS int))"
    found = f"aggregate(sequence(1, size(cs)), {start}, (a, i) -> {judged}, a -> named_struct('first', a.first, 'last', a.last))"
    per = f"element_at(transform(array(split(x.s, '')), cs -> {found}), 1)"
    narrowed = f"transform({spans}, x -> transform(array({per}), r -> named_struct('start', x.start + r.first, 'kind', {kind}, 'end', x.start + r.last, 's', substring(x.s, r.first + 1, r.last - r.first)))[0])"
    return f"filter({narrowed}, x -> x.start IS NOT NULL)"


def _pieces(runs: str, base: str) -> str:
    """SQL for what base spans leave of the runs: stretches long enough, with a letter and a digit."""
    end = "coalesce(array_min(transform(filter(o, b -> b.start > p), b -> b.start)), x.end)"
    piece = f"transform(array({end}), e -> named_struct('start', p, 'kind', x.kind, 'end', e, 's', substring(x.s, p - x.start + 1, e - p)))[0]"
    starts = "filter(array_distinct(concat(array(x.start), transform(o, b -> b.end))), p -> p < x.end AND NOT exists(o, b -> b.start <= p AND p < b.end))"
    left = f"transform(array(filter({base}, b -> b.start < x.end AND x.start < b.end)), o -> if(size(o) = 0, array(x), transform({starts}, p -> {piece})))[0]"
    return f"filter(flatten(transform({runs}, x -> {left})), x -> x.end - x.start >= {CANDIDATE_LEAST} AND x.s RLIKE '[0-9]' AND x.s RLIKE '[A-Za-z]')"


def find_secrets(df: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, base: str = "base_spans", name: str = "spans") -> DataFrame:
    """``df`` with the columns ``base`` and ``name``, base spans and all spans: arrays of (start, kind number, end, s), by start and then kind.

    Base spans are the three patterns' matches.  Candidates for added spans are runs of 20 and more
    characters with a letter and a digit, or as long stretches of them between base spans; each belongs to one class,
    hexadecimal or base64, and is narrowed to its windows of high entropy.  Added spans that
    hold an allowed word are suppressed; base spans always stay.

    Null and empty texts have no spans.  Only the text is looked at; rows with any nulls,
    repeated rows and further columns stay as they are; where one has a name given, the new one gets an underscore more.
    """
    base, name = free_name(df, base), free_name(df, name)
    t = df.withColumn("__t", F.coalesce(df[text_col].cast("string"), F.lit("")))
    empty = "cast(array() AS array<struct<start:int,kind:int,end:int,s:string>>)"
    t = t.withColumn("__assign", F.expr(f"""if(__t RLIKE '(?i)passw|secret|token|api_?key', {_spans('__t', ASSIGN, 0, 2, ASSIGN_LEAST)}, {empty})"""))
    t = t.withColumn("__access", F.expr(f"if(contains(__t, 'AKIA'), {_spans('__t', ACCESS, 1)}, {empty})"))
    t = t.withColumn("__hex", F.expr(f"if(__t RLIKE '[0-9a-f]{{24}}', {_spans('__t', HEX, 2)}, {empty})"))
    # A digit somewhere is needed, so texts without one skip the search for runs.
    t = t.withColumn("__runs", F.expr(f"if(__t RLIKE '[A-Za-z0-9+/=_-]{{0,19}}[0-9]' AND __t RLIKE '[A-Za-z0-9+/=_-]{{20}}', filter({_spans('__t', CANDIDATE, 0)}, x -> x.s RLIKE '[0-9]' AND x.s RLIKE '[A-Za-z]'), {empty})"))
    t = t.withColumn(base, F.expr("array_sort(concat(__assign, __access, __hex))"))
    t = t.withColumn("__runs", F.expr(f"if(size(__runs) = 0, __runs, {_pieces('__runs', f'`{base}`')})"))
    hex_, rest = "filter(__runs, x -> x.s RLIKE '^[0-9a-fA-F]+$')", "filter(__runs, x -> NOT x.s RLIKE '^[0-9a-fA-F]+$')"
    added = f"if(size(__runs) = 0, {empty}, concat({_entropy('entropy_hex', hex_)}, {_entropy('entropy_base64', rest)}))"
    t = t.withColumn("__added", F.expr(added))
    listed = " OR ".join(f"contains(lower(x.s), '{w.lower()}')" for w in allowed) or "false"
    t = t.withColumn(name, F.expr(f"if(size(__added) = 0, `{base}`, array_sort(concat(`{base}`, filter(__added, x -> NOT ({listed})))))"))
    return t.drop("__t", "__assign", "__access", "__hex", "__runs", "__added")


def listed(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.kind + 1), ':', x.start, ':', x.end)), ',')"


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with each span of the text, overlapping ones together, replaced by ``mark``."""
    t = find_secrets(df, text_col, base="__base", name="__spans").withColumn("__t", F.col(text_col).cast("string"))
    step = f"""named_struct('at', greatest(a.at, x.end), 'out', if(x.start < a.at, a.out, concat(a.out, substring(__t, a.at + 1, x.start - a.at), '{mark}')))"""
    cut = f"aggregate(__spans, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(__t, a.at + 1)))"
    return t.withColumn(text_col, F.expr(f"if(size(__spans) = 0, `{text_col}`, {cut})")).drop("__t", "__base", "__spans")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(base_spans, x -> x.kind = {k})) AS long)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(listed("base_spans")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"))
