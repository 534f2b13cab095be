"""Text expressions: all return Columns, and all but duplicated_grams() stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, which Java's \s does not cover.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
HAN = r"[一-鿿]"
HEADING = r"(?m)^#{1,6}\s+\S.*$"


def compact(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def present(value: Column) -> Column:
    """Not null and not blank: an empty string is a missing value."""
    return F.coalesce(F.length(compact(value)) > 0, F.lit(False))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once per row, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def item_counts(items: Column) -> Column:
    """Structs (item, n): each different item of an array and how often it is there; null without items. Sorts the array, and a run ends where the next item differs."""

    def of(xs: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == F.size(xs)) | ~F.get(xs, i).eqNullSafe(F.get(xs, i - 1)))
        run = lambda at, end, i: F.struct(F.get(xs, end - 1).alias("item"), (end - F.coalesce(F.get(at, i - 1), F.lit(0))).cast("long").alias("n"))
        return F.when(F.size(xs) > 0, bound(ends, lambda at: F.transform(at, lambda end, i: run(at, end, i))))

    return bound(F.sort_array(items), of)


def grams(items: Column, n: int, joiner: str = "") -> Column:
    """Arrays joined from n neighbouring items (strings); none if there are fewer than n."""

    def of(xs: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(xs) - n + 1), lambda i: F.array_join(F.slice(xs, i, n), joiner))
        return F.when(F.size(xs) >= n, many).otherwise(F.array().cast("array<string>"))

    return bound(items, of)


def char_grams(text: Column, n: int) -> Column:
    """Character n-grams; the text is cut into characters once, so long texts stay linear."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return grams(chars, n)


def word_grams(words: Column, n: int) -> Column:
    return grams(words, n, " ")


def duplicate_ratio(items: Column) -> Column:
    """The share of items that repeat an earlier one; 0 without items."""
    return bound(items, lambda xs: F.when(F.size(xs) > 0, (F.size(xs) - F.size(F.array_distinct(xs))) / F.size(xs)).otherwise(F.lit(0.0)))


def duplication(text: str | None, n: int, floor: int = 0) -> float:
    """The share of a text's n-character windows that repeat an earlier one; 0 for texts shorter than n or than floor.

    Windows meet by a 64-bit hash; those of one hash are compared with each other, so the share is exact.
    """
    if text is None or len(text) < max(n, floor):
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(codes, n)
    h = np.zeros(len(windows), dtype=np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + windows[:, j]
    order = np.argsort(h)
    again = h[order][1:] == h[order][:-1]
    a, b = order[1:][again], order[:-1][again]
    same = all(np.array_equal(codes[a + j], codes[b + j]) for j in range(n))
    repeats = int(again.sum()) if same else len(windows) - len({text[i : i + n] for i in range(len(windows))})
    return repeats / len(windows)


def duplicated_grams(text: Column, n: int, floor: int = 0) -> Column:
    """duplication() of a text; null for a null text."""

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        return pd.Series([duplication(t, n, floor) for t in texts], dtype=float)

    return F.when(text.isNotNull(), share(text))


def duplicated_grams_each(texts: Column, n: int, floor: int = 0) -> Column:
    """duplication() of each text of an array."""

    @F.pandas_udf("array<double>")
    def shares(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [duplication(t, n, floor) for t in x] for x in lists], dtype=object)

    return shares(texts)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def keyword_tokens(text: Column) -> Column:
    """Search tokens: neighbouring pairs of each run of Han characters, and ASCII tokens of two characters or more."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(HAN + "+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: char_grams(r, 2)))
    return F.concat(pairs, F.regexp_extract_all(low, F.lit(r"[a-z0-9_.:/-]{2,}"), F.lit(0)))


def keyword_count(text: Column) -> Column:
    """How many keyword_tokens() a text has, without making them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_count(low, F.lit(f"{HAN}(?={HAN})")) + F.regexp_count(low, F.lit(r"[a-z0-9_.:/-]{2,}"))


def sentences(text: Column) -> Column:
    """Parts between full stops, semicolons (either width) and line ends, blank ones left out."""
    return F.filter(F.split(text, r"[。；;\n]"), lambda s: F.trim(s) != "")


def sentences_kept(text: Column) -> Column:
    """Sentences that keep the mark behind them."""
    return F.filter(F.split(text, r"(?<=[。！？!?；;\n])"), lambda s: F.trim(s) != "")


def keyword_density(text: Column, listed: tuple[str, ...]) -> Column:
    """How many of the listed words stand in each 1000 characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))
    return F.lit(1000.0) * F.size(F.filter(found, lambda w: w.isin(*listed))) / F.greatest(F.length(text), F.lit(1))


# Fixed value: the title of a text without headings.
UNTITLED = "正文"
RULES = r"(?:-{3,}|\*{3,}|_{3,})[ \t]*"


def heading_parts(markdown: Column) -> Column:
    """array<struct<heading, body>>: each heading line, and all that stands below it up to the next."""
    headings = F.regexp_extract_all(markdown, F.lit(HEADING), F.lit(0))
    bodies = F.slice(F.split(markdown, HEADING, -1), 2, 1 << 30)
    return F.arrays_zip(headings.alias("heading"), bodies.alias("body"))


def sections(markdown: Column) -> Column:
    """array<struct<title, body>> of the Markdown headings and what stands below each, without rules at its ends.

    An empty section's body is its heading. A text without headings is one section with a fixed title; an
    empty text, or null, has none.
    """
    text = F.trim(F.regexp_replace(F.coalesce(markdown, F.lit("")), rf"\A{SPACE}+|{SPACE}+\z", ""))

    def section(p: Column) -> Column:
        body = F.regexp_replace(p["body"], rf"\A(?:\s*{RULES}(?:\n|\z))+|(?:(?:\A|\n)\s*{RULES})+\s*\z", "")
        body = F.regexp_replace(body, rf"\A{SPACE}+|{SPACE}+\z", "")
        title = F.trim(F.regexp_replace(p["heading"], r"^#+\s*", ""))
        return F.struct(title.alias("title"), F.when(body != "", body).otherwise(F.trim(p["heading"])).alias("body"))

    alone = F.struct(F.lit(UNTITLED).alias("title"), text.alias("body"))
    found = F.transform(heading_parts(text), section)
    return F.when(F.size(found) > 0, found).when(text != "", F.array(alone)).otherwise(F.array().cast("array<struct<title:string,body:string>>"))


def unbalanced_bold(text: Column) -> Column:
    """Some line holds an odd number of ** marks."""
    return F.exists(F.split(text, r"\r?\n"), lambda line: F.regexp_count(line, F.lit(r"\*\*")) % 2 == 1)


def count_of(text: Column, part: Column) -> Column:
    """How often part stands in text, not overlapping; 0 for an empty part."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def contains_loosely(text: Column, quote: Column) -> Column:
    """The quote stands in the text, white space left aside."""
    return F.contains(compact(text), compact(quote))


def coverage(value: Column, body: Column) -> Column:
    """Share of the value's distinct pairs of Han, letter and digit characters that the body holds; null if it has fewer than two such characters."""
    kept = F.regexp_replace(value, r"[^一-鿿A-Za-z0-9]", "")
    pairs = F.array_distinct(char_grams(kept, 2))
    return bound(F.struct(pairs.alias("p"), body.alias("b")), lambda v: F.when(F.size(v["p"]) > 0, F.size(F.filter(v["p"], lambda g: F.contains(v["b"], g))) / F.size(v["p"])))


def pointer_tokens(ref: Column) -> Column:
    """Parts of a JSON pointer, ~1 and ~0 decoded in that order."""
    parts = F.filter(F.split(ref, "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def normal_label(value: Column) -> Column:
    """Lower case; every run of other characters than letters and digits is one underscore; none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}]+", "_"), F.lit("_"))


def scrub(text: Column, secret: Column, mask: str = "***") -> Column:
    """Every occurrence of a secret (not of an empty one) is masked."""
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit(mask))).otherwise(text)
