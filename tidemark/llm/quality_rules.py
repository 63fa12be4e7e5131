"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule reads measures of the text. A sample gives each rule's cost (the time to take those of its measures that
aren't there yet, over that of a job without any) and selectivity (the share it rejects); rules then run by rejections
per cost, largest first. A measure that is not there yet is taken only where no earlier rule has rejected, so that most
of the junk never reaches the dear ones. The order changes the cost, never the verdict. The query's contract asks for
five measures of every row; rules on these alone cost nothing more and come first, and the cascade spares the rest.

Defined results: a null or empty text has no words, all measures 0, and is rejected by `few_words`.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOLS_PERCENT, MAX_DUP_LINE_PERCENT, MEAN_WORD = 20, 30, 50, 30, (2, 20)
MIN_LETTER_WORDS_PERCENT, MAX_BULLET_PERCENT, MAX_ELLIPSIS_PERCENT = 50, 90, 30
SYMBOLS, GAPS, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 8
_LETTER, _BULLET, _ELLIPSIS = r"\p{L}", r"^[ \t\x0B\f\r]*[-*•]", r"(\.\.\.|…)[ \t\x0B\f\r]*\z"
#: Rows of the sample, how often each is measured when time is taken, and what any measure takes at least, in seconds.
SAMPLE_ROWS, TIMES, LEAST_COST = 2000, 10, 1e-4


def _windows() -> Column:
    parts = lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(WINDOW)])
    return F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), parts)).otherwise(F.array().cast("array<bigint>"))


def _repeat_words() -> Column:
    """Words covered by the windows at sorted places: each adds those that the one before didn't cover."""
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    fold = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda a: a["n"])
    return F.coalesce(fold, F.lit(0)).cast("bigint")


#: What can be measured: name, the names it is made from, how. Later ones may use earlier ones.
MEASURES: dict[str, tuple[Sequence[str], object]] = {
    "word_chars": ((), lambda: F.coalesce(F.length(F.translate("text", GAPS, "")), F.lit(0)).cast("bigint")),
    "n_symbols": ((), lambda: F.coalesce(F.length("text") - F.length(F.translate("text", SYMBOLS, "")), F.lit(0)).cast("bigint")),
    "_lines": ((), lambda: F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0)),
    "n_lines": (("_lines",), lambda: F.size("_lines").cast("bigint")),
    "n_dup_lines": (("_lines",), lambda: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")),
    "n_bullet_lines": (("_lines",), lambda: F.size(F.filter("_lines", lambda x: x.rlike(_BULLET))).cast("bigint")),
    "n_ellipsis_lines": (("_lines",), lambda: F.size(F.filter("_lines", lambda x: x.rlike(_ELLIPSIS))).cast("bigint")),
    "_words": ((), lambda: F.filter(F.split(F.coalesce("text", F.lit("")), common.WORD_GAP), lambda x: x != "")),
    "n_words": (("_words",), lambda: F.size("_words").cast("bigint")),
    "n_letter_words": (("_words",), lambda: F.size(F.filter("_words", lambda x: x.rlike(_LETTER))).cast("bigint")),
    "_hashes": (("_words",), lambda: F.transform("_words", lambda x: F.xxhash64(x))),
    "_windows": (("_hashes",), _windows),
    # Windows in order of their hash, where any comes twice; those with an equal neighbour are repeated.
    "_sorted": (("_windows",), lambda: F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
    "_places": (("_sorted",), lambda: F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False))), lambda x: x["i"]))),
    "n_repeat_words": (("_places",), _repeat_words),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    fails: str  # SQL over the measures


RULES = (
    Rule("few_words", ("n_words",), f"n_words < {MIN_WORDS}"),
    Rule("repeats", ("n_words", "n_repeat_words"), f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    Rule("symbols", ("n_symbols", "n_words"), f"100 * n_symbols > {MAX_SYMBOLS_PERCENT} * n_words"),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines"),
    Rule("word_length", ("word_chars", "n_words"), f"word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words"),
    Rule("letters", ("n_letter_words", "n_words"), f"100 * n_letter_words < {MIN_LETTER_WORDS_PERCENT} * n_words"),
    Rule("bullets", ("n_bullet_lines", "n_lines"), f"100 * n_bullet_lines > {MAX_BULLET_PERCENT} * n_lines"),
    Rule("ellipses", ("n_ellipsis_lines", "n_lines"), f"100 * n_ellipsis_lines > {MAX_ELLIPSIS_PERCENT} * n_lines"),
)
#: What the query's contract asks for of every row.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(rows: DataFrame, names: Sequence[str], where: Column | None = None) -> DataFrame:
    """Adds those measures that aren't there yet, and what they are made from; only where `where` holds, if given."""
    for name in names:
        if name not in rows.columns:
            rows = measure(rows, MEASURES[name][0], where)
            how = MEASURES[name][1]()
            rows = rows.withColumn(name, how if where is None else F.when(where, how))
    return rows


def order(docs: DataFrame, rules: Sequence[Rule] = RULES, taken: Sequence[str] = ()) -> list[Rule]:
    """The rules by rejections per second, as a sample of SAMPLE_ROWS rows shows; the measures in `taken` are there anyhow.

    A rule's cost is the shorter of two runs less that of a job without measures, all with the sample in memory, each row
    TIMES times over, and code and workers warmed up by the count of rejections before.
    """
    sample = common.bounded_sample(docs.select("doc_id", "text", F.lit(0).alias("all_rows")), "all_rows", SAMPLE_ROWS).select("text").repartition(2)
    sample = measure(sample, taken).cache()
    needs = [n for rule in rules for n in rule.needs]
    rejected = measure(sample, needs).agg(*[F.count_if(F.expr(r.fails)).alias(r.name) for r in rules]).first()
    often = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(names: Sequence[str]) -> float:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            measure(often, names).agg(F.count_if(F.col("_time") > 0), *[F.count(n) for n in names]).first()
            runs.append(time.perf_counter() - began)
        return min(runs)

    empty, found = seconds(()), []
    for rule in rules:
        more = [n for n in rule.needs if n not in sample.columns]
        cost = LEAST_COST + (max(0.0, seconds(more) - empty) if more else 0.0)
        found.append((rejected[rule.name] / cost, rule))
    sample.unpersist()
    return [rule for _, rule in sorted(found, key=lambda x: (-x[0], x[1].name))]


def cascade(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds failed_rule: the first of the rules, in the given order, that rejects the row; null if none does.

    Write the result, or checkpoint it, before filtering by failed_rule: Spark would copy the whole chain of measures and
    conditions into the filter, once for each mention in the next.
    """
    rows = rows.withColumn("failed_rule", F.lit(None).cast("string"))
    for rule in rules:
        rows = measure(rows, rule.needs, F.col("failed_rule").isNull())
        rows = rows.withColumn("failed_rule", F.coalesce("failed_rule", F.when(F.expr(rule.fails), rule.name)))
    return rows


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = cascade(measure(docs, BASE), order(docs, taken=BASE))
    base_failed = F.expr(f"{RULES[0].fails} OR {RULES[1].fails}")
    return out.select("doc_id", *BASE, base_failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' ') AS win
        FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least({WINDOW}, i - coalesce(last, -{WINDOW}))) AS n
        FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM rep) GROUP BY r),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t\x0B\f\r]*[-*•]'))) AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\x0B\f\r]*\z'))) AS n_ellipsis_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > {MAX_SYMBOLS_PERCENT} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines
            OR word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words
            OR 100 * n_letter_words < {MIN_LETTER_WORDS_PERCENT} * n_words OR 100 * n_bullet_lines > {MAX_BULLET_PERCENT} * n_lines
            OR 100 * n_ellipsis_lines > {MAX_ELLIPSIS_PERCENT} * n_lines) AS kept
FROM b
"""
