"""Report quality without a judge: facts found, numbers that no prompt holds, assertions, and form words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.documents import unnegated

# Negations, assertions of liability, words of a form, small numbers that need no source.
NEGATION = r"(不能|不宜|无法|不应|不得|不足以|尚不能|难以|不作|未|不|并非|是否|如|若|假如|如果)"
ASSERTION = r"(承担|负有?|应负)(全部|主要|次要|同等)?责任|(全部|主要|次要|同等)责任"
FORM_WORDS = ("字段", "记载为", "未提供")
SMALL = ("1", "2", "3", "4", "5", "6", "7")
NUMBER = r"\d+(?:\.\d+)?"
SECTION_NUMBER = r"(?m)^#+\s*\d+(?:\.\d+)*"


def _pairs(text: Column) -> Column:
    return F.array_distinct(T.char_grams(T.compact(text), 2))


def fact_recall(facts: Column, report: Column, threshold: float = 0.6) -> Column:
    """The share of values of two characters or more of whose pairs of characters the report holds `threshold` or more."""
    long = F.filter(facts, lambda v: F.length(v) >= 2)

    def found(body: Column) -> Column:
        hit = lambda v: T.bound(_pairs(v), lambda p: (F.size(p) > 0) & (F.size(F.filter(p, lambda x: F.contains(body, x))) >= F.lit(threshold) * F.size(p)))
        return F.size(F.filter(long, hit)) / F.greatest(F.size(long), F.lit(1))

    return T.bound(T.compact(report), found)


def fabricated_numbers(report: Column, prompt: Column) -> Column:
    """Sorted distinct numbers of the report, numbers of sections and small ones aside, that the prompt does not hold."""
    numbers = F.regexp_extract_all(F.regexp_replace(report, SECTION_NUMBER, ""), F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.filter(F.array_distinct(numbers), lambda n: ~n.isin(*SMALL) & ~F.contains(prompt, n)))


def offline_quality(rows: DataFrame) -> DataFrame:
    """rows(.., report, prompt, facts array) with chars, recall, fabricated, asserted (how many assertions have no negation in their sentence before them) and form."""
    report = F.coalesce("report", F.lit(""))
    form = sum((T.count_of(report, F.lit(w)) for w in FORM_WORDS), F.lit(0))
    sentences = F.transform(F.split(report, r"[。；\n]"), lambda s: unnegated(s, ASSERTION, NEGATION))
    asserted = F.aggregate(sentences, F.lit(0), lambda a, b: a + b)
    return rows.withColumns({"chars": F.length(report), "recall": F.round(fact_recall(F.col("facts"), report), 2), "fabricated": fabricated_numbers(report, F.coalesce("prompt", F.lit(""))), "asserted": asserted, "form": form})
