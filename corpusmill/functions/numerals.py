"""Chinese numerals as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units of Chinese numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERAL = "[零〇一二三四五六七八九十百千两]"


def _lookup(table: dict[str, int], key: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def numeral_value(text: Column) -> Column:
    """The number that a numeral, or a string of ASCII digits, stands for; null for anything else.

    Walks the characters with a pending digit: a unit multiplies it (1 where none is pending).
    """

    def step(state: Column, c: Column) -> Column:
        digit, unit = _lookup(DIGITS, c), _lookup(UNITS, c)
        return F.struct(
            F.when(unit.isNotNull(), state["sum"] + F.when(state["pending"] == 0, 1).otherwise(state["pending"]) * unit).otherwise(state["sum"]).cast("long").alias("sum"),
            F.when(digit.isNotNull(), digit).otherwise(0).cast("long").alias("pending"),
            (state["ok"] & (digit.isNotNull() | unit.isNotNull())).alias("ok"),
        )

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("pending"), F.lit(True).alias("ok"))
    walked = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda s: F.when(s["ok"], s["sum"] + s["pending"]))
    return F.when(text.rlike("^[0-9]+$"), text.cast("long")).when(F.length(text) > 0, walked)


def folded_numbers(text: Column) -> Column:
    """Decimal strings that the numerals of a text can stand for: values, digit by digit readings, single digits."""
    runs = F.regexp_extract_all(text, F.lit(NUMERAL + "+"), F.lit(0))

    def of_run(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda c: c != "")
        digits = F.filter(F.transform(chars, lambda c: _lookup(DIGITS, c).cast("string")), lambda d: d.isNotNull())
        whole = F.when(run.rlike("[十百千]"), F.array(numeral_value(run).cast("string"))).when(F.length(run) >= 2, F.array(F.array_join(digits, "")))
        return F.concat(F.coalesce(whole, F.array().cast("array<string>")), digits)

    return F.array_distinct(F.flatten(F.transform(runs, of_run)))


def numeral_of(n: Column) -> Column:
    """The Chinese numeral of 0..999."""
    digits = F.array(*[F.lit(c) for c in "零一二三四五六七八九"])
    at = lambda i: F.element_at(digits, i.cast("int") + 1)
    ones, tens, hundreds = n % 10, F.floor(n / 10) % 10, F.floor(n / 100)
    tail = F.when(ones > 0, at(ones)).otherwise("")
    below = F.when(tens == 0, tail).otherwise(F.concat(F.when((tens == 1) & (hundreds == 0), "").otherwise(at(tens)), F.lit("十"), tail))
    gap = F.when((tens == 0) & (ones > 0), "零").otherwise("")
    return F.when(n == 0, "零").when(hundreds == 0, below).otherwise(F.concat(at(hundreds), F.lit("百"), gap, below))


def law_item(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """struct<law, article> of a reference such as 《law》第N条; brackets and the state's name are left out of the law."""
    number = F.regexp_extract(text, "第([0-9]+|[零一二三四五六七八九十百]+)条", 1)
    title = F.regexp_extract(text, "《(.+?)》", 1)
    law = F.trim(F.replace(F.regexp_replace(title, "[（(].*?[）)]", ""), F.lit("中华人民共和国"), F.lit("")))
    for short, full in (aliases or {}).items():
        law = F.when(law == short, full).otherwise(law)
    return F.struct(F.when(title != "", law).alias("law"), F.when(number != "", numeral_value(number)).alias("article"))
