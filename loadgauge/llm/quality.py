"""Quality rules as a short-circuit cascade.

Each rule is a boolean column that is true where a document fails.  On a sample the rules are
timed one by one and the patterns of their failures counted; then the next rule is always the
one that rejects most of what is left per second.  The cascade is one CASE expression: Spark
stops at the first rule that fails.  The order changes cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadgauge.llm.common import SPACES, free_name, let, words_of
from loadgauge.plans.joining import settle

SAMPLE_ROWS = 2000
WINDOW = 8
# Letters of scripts that write words without spaces between them.
UNSPACED = (
    r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
    r"\p{IsJavanese}\p{IsBalinese}\p{IsNew_Tai_Lue}\p{IsTai_Le}\p{IsTai_Tham}ー&&\p{L}]"
)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return F.coalesce(lines, F.array().cast("array<string>"))


def n_dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur more than once in the text.

    Windows are told apart by 64-bit hashes of hashes of words.  Most texts repeat none, which
    one hash set shows; else equal windows are found by sorting, and the covered words counted
    in one pass over their starts.
    """

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return let(
            F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window)))
        )

    def repeated_starts(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def equal_neighbours(s: Column) -> Column:
            n = F.size(s)
            twin = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"]))
                | ((j < n - 1) & (s[F.least(j + 1, n - 1)]["h"] == s[j]["h"])),
            )
            return F.sort_array(F.transform(twin, lambda j: s[j]["i"]))

        return let(at, equal_neighbours)

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(repeated_starts(h)))

    return F.when(F.size(words) > window, let(hashes(words), count)).otherwise(0).cast("long")


def base_rules(words: Column, n_words: Column) -> list[Rule]:
    return [
        Rule("short", n_words < 20),
        Rule("repeats", 100 * n_repeat_words(words) > 30 * n_words),
    ]


def content_rules(text: Column, words: Column, n_words: Column) -> list[Rule]:
    """Rules against marked-up, shouted, tabular and repetitive texts.

    The limits leave room for text in any alphabet: capitals are measured against all letters,
    with case or without, and words only where most letters are of scripts that part them by
    spaces.  For text in cased letters alone this asks for more capitals than small letters.
    """
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    unspaced = F.regexp_count(text, F.lit(UNSPACED))
    marks = F.regexp_count(text, F.lit(r"[!?]"))
    chars = word_chars(words)
    dup = let(lines_of(text), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 40 * F.size(x))
    return [
        Rule("symbols", 100 * n_symbols(text) > 20 * n_words),
        Rule("dup_lines", dup),
        Rule("capitals", 2 * capitals > letters),
        Rule("marks", 100 * marks > 50 * n_words),
        Rule("word_length", ((chars < 2 * n_words) | (chars > 14 * n_words)) & (2 * unspaced <= letters)),
    ]


def _failed(rule: Rule) -> Column:
    return F.coalesce(rule.fails, F.lit(False))


def order_rules(rows: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of rejection per cost, measured on about ``sample_rows`` rows.

    A rule's rejection counts only documents that the rules before it let pass.  Only counts per
    pattern of failures reach the driver.  On an empty table the order stays as given.
    """
    sample = settle(rows.sample(min(1.0, sample_rows / max(1, rows.count())), seed=5))
    patterns = sample.select(F.array(*[_failed(r) for r in rules]).alias("p")).groupBy("p").count().collect()
    if not patterns:
        return list(rules)

    def seconds(column: Column) -> float:
        begin = time.perf_counter()
        sample.agg(F.count_if(column)).collect()
        return time.perf_counter() - begin

    idle = seconds(F.lit(True))
    cost = {r.name: max(seconds(_failed(r)) - idle, 1e-3) for r in rules}
    left, ordered = list(range(len(rules))), []
    alive = [(row["p"], row["count"]) for row in patterns]
    while left:
        rejected = {k: sum(n for p, n in alive if p[k]) for k in left}
        best = max(left, key=lambda k: (rejected[k] / cost[rules[k].name], -k))
        left.remove(best)
        ordered.append(rules[best])
        alive = [(p, n) for p, n in alive if not p[best]]
    return ordered


def first_failure(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that a document fails, null if it passes all."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(_failed(rule), F.lit(rule.name)).otherwise(verdict)
    return verdict


def good_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass the base rules and the content rules; columns as they are.

    Null, empty and blank texts have no words and fail ``short``.  Repeated rows share their
    verdict.  Columns of ``docs`` that clash with names used here stay untouched.
    """
    name = free_name(docs, "__words")
    rows = docs.withColumn(name, words_of(F.col("text")))
    words, n = F.col(name), F.size(name)
    rules = base_rules(words, n) + content_rules(F.col("text"), words, n)
    rules = order_rules(rows, rules, sample_rows)
    return rows.filter(first_failure(rules).isNull()).select(docs.columns)


def quality_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts of each text, base_failed, rejected_by and kept: a row per document.

    A document that fails a base rule is not put to the cascade.  Null and blank texts have
    zeros and fail.
    """
    rows = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    text, words, n = F.col("text"), F.col("words"), F.col("n_words")
    rules = order_rules(rows, content_rules(text, words, n), sample_rows)
    rows = rows.withColumn("n_repeat_words", n_repeat_words(words))
    base_failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    rejected = F.when(base_failed, "base").otherwise(first_failure(rules))
    return rows.select(
        "doc_id", "n_words", word_chars(words).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"), "n_repeat_words", base_failed.alias("base_failed"),
        rejected.alias("rejected_by"),
    ).withColumn("kept", F.col("rejected_by").isNull())
