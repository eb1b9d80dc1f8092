"""Quality by weak supervision, in DataFrame and SQL functions only.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).  The votes of all documents
are summed up as vote patterns with their number (at most 3**rules rows).  Expectation-maximisation over the patterns
estimates each rule's accuracy on good and on bad documents and the share of good ones; a document is kept when its
posterior probability of being good reaches ``threshold``.  No rule can reject a document on its own.

Every expression is SQL text that Spark runs; the same text builds the check query for another engine.  Only
2 * rules + 1 numbers per iteration go through the driver.

Defined cases: a null text counts as no words (all counts 0); a text without words abstains where a ratio is undefined;
an empty table gives an empty result; equal rows get equal results; other columns than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import staged

ITERATIONS = 15
THRESHOLD = 0.5
_SPACE = r"[\\x20\\x09-\\x0D]+"

#: Rules as SQL over the counts of one text.
RULES = {
    "symbols": "case when n_words = 0 then 0 when n_symbols * 1.0 > 0.25 * n_words then -1 when n_symbols * 1.0 <= 0.10 * n_words then 1 else 0 end",
    "marks": "case when word_chars = 0 then 0 when n_marks * 1.0 > 0.09 * word_chars then -1 when n_marks * 1.0 <= 0.06 * word_chars then 1 else 0 end",
    "capitals": "case when word_chars = 0 then 0 when n_capitals * 1.0 > 0.30 * word_chars then -1 when n_capitals * 1.0 <= 0.15 * word_chars then 1 else 0 end",
    "shouts": "case when n_words = 0 then 0 when n_shouts * 1.0 > 0.25 * n_words then -1 when n_shouts * 1.0 <= 0.05 * n_words then 1 else 0 end",
    "word_length": "case when n_words = 0 then 0 when word_chars * 1.0 > 12.0 * n_words or word_chars * 1.0 < 2.5 * n_words then -1 when word_chars * 1.0 <= 9.0 * n_words and word_chars >= 3.0 * n_words then 1 else 0 end",
    "repeats": "case when n_words < 8 then 0 when n_repeat_words * 1.0 > 0.20 * n_words then -1 when n_repeat_words * 1.0 <= 0.05 * n_words then 1 else 0 end",
    "dup_lines": "case when n_lines < 3 then 0 when n_dup_lines * 1.0 > 0.30 * n_lines then -1 when n_dup_lines = 0 then 1 else 0 end",
    "sentences": "case when n_words < 20 then 0 when n_stops * 40.0 < n_words then -1 when n_stops * 25.0 >= n_words then 1 else 0 end",
}


def counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_shouts, n_stops."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    space = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
    words = f"if(btrim(text, {space}) = '', cast(array() as array<string>), split(btrim(text, {space}), '{_SPACE}'))"
    lines = f"filter(split(text, '\\\\n'), x -> btrim(x, {space}) != '')"
    # hashes of the 8-word windows; one lambda variable binds each array, so nothing is worked out again per element
    windows = "if(size(words) < 8, cast(array() as array<bigint>), transform(array(transform(words, w -> xxhash64(w))), h -> transform(sequence(1, size(h) - 7), i -> xxhash64(slice(h, i, 8))))[0])"
    gone = lambda cls: f"cast(char_length(text) - char_length(regexp_replace(text, '{cls}', '')) as bigint)"
    step = body.select("doc_id", "text", F.expr(words).alias("words"), F.expr(lines).alias("lines"))
    step = step.selectExpr(
        "doc_id", "cast(size(words) as bigint) n_words", "cast(char_length(array_join(words, '')) as bigint) word_chars", f"{gone('[#*$%&|<>]')} n_symbols",
        "cast(size(lines) as bigint) n_lines", "cast(size(lines) - size(array_distinct(lines)) as bigint) n_dup_lines",
        f"{gone('[A-Z]')} n_capitals", gone("[!-/:-@{-~]") + " n_marks", f"{gone('!')} n_shouts", f"{gone('[.?]')} n_stops", f"{windows} windows",
    )
    ordered = "sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))"
    again = f"transform(array({ordered}), t -> filter(t, (x, k) -> x.h = get(t, k - 1).h or x.h = get(t, k + 1).h))[0]"
    covered = f"transform(array(sort_array(transform({again}, x -> x.i))), p -> aggregate(transform(p, (x, k) -> cast(least(8, coalesce(get(p, k + 1) - x, 8)) as bigint)), 0L, (a, x) -> a + x))[0]"
    return step.withColumn("n_repeat_words", F.expr(f"if(size(array_distinct(windows)) = size(windows), 0L, {covered})")).drop("windows")


def votes() -> list[str]:
    return [f"{rule} v_{name}" for name, rule in RULES.items()]


def posterior(p: str, a: list[str], b: list[str]) -> str:
    """SQL of the posterior probability of good, from the prior and the accuracies (SQL texts)."""
    terms = [f"case v_{n} when 1 then ln({x} / (1 - {y})) when -1 then ln((1 - {x}) / {y}) else 0 end" for n, x, y in zip(RULES, a, b, strict=True)]
    return f"1 / (1 + exp(-(ln({p} / (1 - {p})) + {' + '.join(terms)})))"


def updates() -> list[str]:
    """SQL aggregates over patterns (n: documents, q: posterior) that give the next prior and accuracies.

    Prior knowledge enters as pseudo-counts of fixed size, so that the data decide as they grow: a rule seldom fires on
    good documents (98 % right, a thousand documents), and bad documents differ, so that each rule finds a part of them
    only (30 %, ten documents)."""
    out = ["(sum(n * q) + 8.5) / (sum(n) + 10) p"]
    for name in RULES:
        v = f"v_{name}"
        good, bad = f"sum(case when {v} != 0 then n * q else 0 end)", f"sum(case when {v} != 0 then n * (1 - q) else 0 end)"
        out.append(f"(sum(case when {v} = 1 then n * q else 0 end) + 980) / ({good} + 1000) a_{name}")
        out.append(f"(sum(case when {v} = -1 then n * (1 - q) else 0 end) + 3) / ({bad} + 10) b_{name}")
    return out


START = {"p": 0.85} | {f"a_{n}": 0.98 for n in RULES} | {f"b_{n}": 0.3 for n in RULES}


def fit(voted: DataFrame, iterations: int = ITERATIONS) -> dict[str, float]:
    """Prior ``p`` and accuracies ``a_rule`` (on good) and ``b_rule`` (on bad documents), from all documents' votes."""
    names = [f"v_{n}" for n in RULES]
    patterns = staged(voted.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "vote-patterns")
    now = dict(START)
    for _ in range(iterations):
        now = patterns.selectExpr("*", f"{_posterior_at(now)} q").selectExpr(*updates()).first().asDict()
        if now["p"] is None:  # no documents at all
            return dict(START)
    return now


def _posterior_at(m: dict[str, float]) -> str:
    lit = lambda x: f"{x!r}D"
    return posterior(lit(m["p"]), [lit(m[f"a_{n}"]) for n in RULES], [lit(m[f"b_{n}"]) for n in RULES])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", iterations: int = ITERATIONS) -> DataFrame:
    """Per row: id, the counts, the votes, ``quality`` (posterior probability of good)."""
    voted = staged(counts(docs, doc_id, text).selectExpr("*", *votes()), "votes")
    model = fit(voted, iterations)
    return voted.withColumn("quality", F.expr(_posterior_at(model))).withColumnRenamed("doc_id", doc_id)
