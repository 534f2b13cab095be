"""Expressions over JSON values: digests, signatures, string leaves, key checks."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_digest(text: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys and no spaces; null where it does not parse."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                body = json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                out.append(hashlib.sha256(body.encode()).hexdigest())
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return digest(text)


def signature(*parts: Column) -> Column:
    """One digest for equal tuples of values; equal inputs give equal signatures, whatever their types."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def string_leaves(text: Column) -> Column:
    """All string values of a JSON text, at any depth, in order."""

    def walk(value: object):
        if isinstance(value, str):
            yield value
        elif isinstance(value, dict):
            for v in value.values():
                yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    @F.pandas_udf("array<string>")
    def leaves(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(list(walk(json.loads(t))))
            except (TypeError, ValueError):
                out.append([])
        return pd.Series(out)

    return leaves(text)


def key_faults(found: Column, wanted: list[str]) -> Column:
    """struct<missing, unknown> of a key array against a fixed list."""
    fixed = F.array(*[F.lit(k) for k in wanted])
    return F.struct(F.array_sort(F.array_except(fixed, found)).alias("missing"), F.array_sort(F.array_except(found, fixed)).alias("unknown"))


def without_empty(values: Column) -> Column:
    """A map without null and blank values."""
    return F.map_filter(values, lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False)))


def normalised_call(call: Column) -> Column:
    """One shape for calls recorded in either of two: content and tokens at the top, or under response and usage."""
    return F.struct(
        F.coalesce(call["content"], call["response"]["content"]).alias("content"),
        F.coalesce(call["reasoning"], call["response"]["reasoning"], F.lit("")).alias("reasoning"),
        F.coalesce(call["prompt_tokens"], call["usage"]["prompt_tokens"]).alias("prompt_tokens"),
        F.coalesce(call["output_tokens"], call["usage"]["completion_tokens"]).alias("output_tokens"),
    )


def without_reasoning(messages: Column, field: str = "reasoning") -> Column:
    """Chat messages without their reasoning field."""
    return F.transform(messages, lambda m: m.dropFields(field))


def budget_split(text: Column, marker: str) -> Column:
    """struct<before, after, start> around the first marker; start is null and after empty without one."""
    at = F.instr(text, F.lit(marker))
    return F.struct(
        F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text).alias("before"),
        F.when(at > 0, F.substr(text, at + len(marker))).otherwise("").alias("after"),
        F.when(at > 0, at - 1).alias("start"),
    )


def unnegated(text: Column, pattern: str, negation: str, reach: int = 25) -> Column:
    """How many matches have no negation in the `reach` characters before them.

    Places come from the pieces between matches: a match's left context is the end of all that stands before it.
    """
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda r: r["match"].isNotNull())

    def step(state: Column, r: Column) -> Column:
        left = F.right(F.concat(state["left"], r["gap"]), F.lit(reach))
        hit = F.when(left.rlike(negation), 0).otherwise(1)
        return F.struct(F.right(F.concat(left, r["match"]), F.lit(reach)).alias("left"), (state["n"] + hit).alias("n"))

    return F.aggregate(rows, F.struct(F.lit("").alias("left"), F.lit(0).alias("n")), step, lambda s: s["n"])
