"""Quality rules with host verdicts, in DataFrame operations only.

Every document is held against five rules.  Rule failures are added up by host (the ``source``); each host's rate
of each rule is shrunk towards the corpus by a beta prior fitted to all hosts by moments, so that a host of few
documents is judged mostly by the prior; a host that fails a rule at a shrunk rate over ``limit`` is rejected, and
the verdict is joined back to its documents.

Only counts are shuffled (one row of numbers per document and one per host), never texts.

Defined results: a null text has no words (it fails the base rules); a null host is a host of its own; repeated rows
count as often as they stand there; other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import plain, written

WORD = r"[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
HOST_LIMIT = 0.5
MIN_WORDS = 50
#: Rule name and condition; ``n_word_lines`` are the lines that hold a word.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_word_lines",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)",
}

# ``transform(array(x), v -> ...)[0]`` names a value, so that it is computed once
_REPEATS = """
case when size(w) < 4 then 0 else
transform(array(transform(sequence(0, size(w) - 3), i -> concat(get(w, i), ' ', get(w, i + 1), ' ', get(w, i + 2)))), t ->
  case when size(array_distinct(t)) = size(t) then 0 else
  transform(array(array_sort(transform(t, (g, i) -> named_struct('g', g, 'p', i)))), s ->
    transform(array(array_sort(transform(filter(s, (x, i) -> (i > 0 and get(s, i - 1).g = x.g) or get(s, i + 1).g <=> x.g), x -> x.p))), p ->
      aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0, (a, x) -> a + x))[0])[0] end)[0] end"""


def document_counts(docs: DataFrame, host: str) -> DataFrame:
    """The base counts of every whole text."""
    rows = docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    counted = F.expr(f"""transform(array(regexp_extract_all(text, '{WORD}', 0)), w -> named_struct(
        'n_words', size(w), 'n_repeat_words', {_REPEATS}))[0]""")
    word_lines = F.expr(f"""transform(array(filter(split(text, '\\n', -1), l -> l rlike '{WORD}')), l -> named_struct(
        'n', size(l), 'dup', size(l) - size(array_distinct(l))))[0]""")
    rows = rows.select("doc_id", "host", counted.alias("c"), word_lines.alias("l"),
                       (F.length("text") - F.length(F.regexp_replace("text", r"[^\x20\x09-\x0D]+", ""))).alias("word_chars"),
                       F.length(F.regexp_replace("text", rf"[^{SYMBOLS}]+", "")).alias("n_symbols"))
    names = {"n_words": "c.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.dup",
             "n_repeat_words": "c.n_repeat_words", "n_word_lines": "l.n"}
    return rows.select("doc_id", "host", *[F.col(c).cast("bigint").alias(n) for n, c in names.items()])


def host_rates(counts: DataFrame) -> DataFrame:
    """``host, n`` and each rule's shrunk failure rate (``rate_<rule>``)."""
    fails = [F.sum(F.expr(f"case when {rule} then 1 else 0 end")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), *fails)
    moments = [F.sum("n").alias("all_n"), F.count("*").alias("hosts")]
    for name in RULES:
        f = F.col(f"f_{name}").cast("double")
        moments += [F.sum(f"f_{name}").alias(f"all_{name}"), F.sum(f * f / F.col("n")).alias(f"sq_{name}")]
    corpus = hosts.agg(*moments).first()  # one row of sums
    value = lambda name: F.lit(float(corpus[name] or 0))
    total = F.lit(float(corpus["all_n"] or 1))
    rates = []
    for name in RULES:
        mean = value(f"all_{name}") / total
        # variance between hosts: the weighted one less what sampling alone would give
        spread = F.greatest(value(f"sq_{name}") / total - mean * mean - mean * (1 - mean) * value("hosts") / total, F.lit(1e-6))
        strength = F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(2.0)), F.lit(1000.0))
        rates.append(F.round((F.col(f"f_{name}") + mean * strength) / (F.col("n") + strength), 6).alias(f"rate_{name}"))
    return hosts.select("host", "n", *rates)


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed``, the host's worst shrunk rate and verdict, ``kept``."""
    counts = written(document_counts(plain(docs, "doc_id", host, "text"), host), "quality-counts")
    rates = host_rates(counts)
    verdicts = rates.select(F.col("host").alias("h"), F.greatest(*[f"rate_{name}" for name in RULES]).alias("host_rate"))
    joined = counts.join(verdicts, F.col("host").eqNullSafe(F.col("h")))
    base = F.expr(f"n_words < {MIN_WORDS} or {RULES['repeats']}")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                         "host_rate", (F.col("host_rate") > limit).alias("host_failed"), (~base & (F.col("host_rate") <= limit)).alias("kept"))


def judge_sql() -> str:
    """The same in DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]+"
    fails = ", ".join(f"sum(case when {rule} then 1 else 0 end) as f_{name}" for name, rule in RULES.items())
    moments = ", ".join(f"sum(f_{n}) as all_{n}, sum(f_{n}::double * f_{n} / n) as sq_{n}" for n in RULES)
    rates = []
    for n in RULES:
        mean = f"(all_{n}::double / all_n)"
        spread = f"greatest(sq_{n} / all_n - {mean} * {mean} - {mean} * (1 - {mean}) * hosts / all_n, 1e-6)"
        strength = f"least(greatest({mean} * (1 - {mean}) / {spread} - 1, 2.0), 1000.0)"
        rates.append(f"round((f_{n} + {mean} * {strength}) / (n + {strength}), 6)")
    base = f"n_words < {MIN_WORDS} or {RULES['repeats']}"
    return f"""
with d as (select doc_id, source as host, coalesce(text, '') as text from documents),
w as (select doc_id, host, text, regexp_extract_all(text, '{word}') as ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) as ls from d),
t as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from t) where c > 1),
p as (select doc_id, count(distinct i + k) as n_repeat_words from r, range(3) as x(k) group by doc_id),
c as (select w.doc_id, host, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_word_lines from w left join p on w.doc_id = p.doc_id),
h as (select host, count(*) as n, {fails} from c group by host),
m as (select sum(n) as all_n, count(*) as hosts, {moments} from h),
v as (select host, greatest({', '.join(rates)}) as host_rate from h, m)
select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed, host_rate,
  host_rate > {HOST_LIMIT} as host_failed, not ({base}) and host_rate <= {HOST_LIMIT} as kept
from c join v on c.host is not distinct from v.host"""
