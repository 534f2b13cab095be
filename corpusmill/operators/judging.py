"""Judge output: parsing, validity, verified defects, seeded mutations and their calibration."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# The dimensions of a judgement.
DIMENSIONS = ("事实完整性", "证据边界与谨慎性", "因果与责任分析合理性", "法规与知识引用相关性", "文书可用性")
# Sentences of our own that no report has grounds for: a measured speed, a verdict, an article.
FAKE_SPEED = "\n\n经测算，小型客车当时行驶速度为 113 公里/小时，痕迹全长 61 米。\n"
OVERCLAIM = "\n\n由此认定甲方负全部责任，其行为已经构成犯罪，应判处有期徒刑。\n"
FAKE_LAW = "\n\n按照《道路运输条例》第二百零一条，此类情形一律加倍处理。\n"


def json_values(text: str, kind: type) -> Iterator:
    """Every JSON value of the kind that begins at a brace or bracket, outermost first, from left to right."""
    decoder, at = json.JSONDecoder(), 0
    opening = "{" if kind is dict else "["
    while (at := text.find(opening, at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        if isinstance(value, kind):
            yield value


def _without_thinking(text: str) -> str:
    head, mark, tail = text.rpartition("</think>")
    return tail if mark else head or text


def extract_object(column: Column, key: str) -> Column:
    """The first JSON object with `key` in a model's answer, thinking left out, as JSON text; null if there is none."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        hits = (next((json.dumps(v, ensure_ascii=False) for v in json_values(_without_thinking(t or ""), dict) if key in v), None) for t in texts)
        return pd.Series(list(hits), dtype=object)

    return find(column)


def extract_array(column: Column, key: str, last: bool = True) -> Column:
    """The last (or first) JSON array whose elements are objects with `key`, as JSON text."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            hits = [v for v in json_values(t or "", list) if v and all(isinstance(x, dict) and key in x for x in v)]
            out.append(json.dumps(hits[-1 if last else 0], ensure_ascii=False) if hits else None)
        return pd.Series(out, dtype=object)

    return find(column)


def split_objects(column: Column) -> Column:
    """All JSON objects that follow one another in a text, as JSON texts."""

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[json.dumps(v, ensure_ascii=False) for v in json_values(t or "", dict)] for t in texts])

    return find(column)


def parse_judgement(raw: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """raw(key, judge, content, report) -> key, judge, valid, total, scores map, defects, unverified.

    A judgement is valid if each dimension is an integer (not a boolean or string) from 1 to 5. A defect is
    verified if its quote stands in the report, white space left aside.
    """
    doc = F.try_parse_json(extract_object(F.col("content"), "dimensions"))
    rows = raw.withColumn("doc", doc)

    def score(name: str) -> Column:
        at = F.try_variant_get("doc", f'$.dimensions["{name}"]', "variant")
        whole = F.schema_of_variant(at) == "BIGINT"
        value = F.try_variant_get("doc", f'$.dimensions["{name}"]', "int")
        return F.when(whole & value.between(1, 5), value)

    scores = {name: score(name) for name in dimensions}
    valid, total = F.lit(True), F.lit(0)
    for s in scores.values():
        valid, total = valid & s.isNotNull(), total + F.coalesce(s, F.lit(0))
    defects = F.coalesce(F.try_variant_get("doc", "$.defects", "array<struct<dimension:string,type:string,quote:string>>"), F.array().cast("array<struct<dimension:string,type:string,quote:string>>"))
    seen = F.transform(defects, lambda d: F.struct(d["dimension"].alias("dimension"), d["type"].alias("type"), d["quote"].alias("quote"), (T.present(d["quote"]) & T.contains_loosely(F.col("report"), d["quote"])).alias("verified")))
    pairs = [x for name, s in scores.items() for x in (F.lit(name), s)]
    return rows.select("key", "judge", valid.alias("valid"), F.when(valid, total).alias("total"), F.create_map(*pairs).alias("scores"), seen.alias("defects"), F.size(F.filter(seen, lambda d: ~F.coalesce(d["verified"], F.lit(False)))).alias("unverified"))


def without_section(report: Column, title: str) -> Column:
    """The report without the first section whose heading names the title."""
    return F.regexp_replace(report, rf"(?ms)\A(.*?)^#{{1,6}}[^\n]*\Q{title}\E[^\n]*\n.*?(?=^#{{1,6}}\s|\z)(.*)\z", "$1$2")


def longest_section_again(report: Column) -> Column:
    """The report with its longest section, heading and all, twice more; a report of fewer than three sections is doubled."""
    parts = F.transform(T.heading_parts(report), lambda p, i: F.struct((-F.length(p["heading"]) - F.length(p["body"])).alias("n"), i.alias("i"), F.concat(p["heading"], p["body"]).alias("text")))
    again = F.concat(F.lit("\n\n"), F.trim(F.regexp_replace(F.get(F.array_sort(parts), F.lit(0))["text"], r"\s+\z", "")))
    return F.when(F.size(parts) < 3, F.concat(report, F.lit("\n\n"), report)).otherwise(F.concat(F.regexp_replace(report, r"\s+\z", ""), again, again, F.lit("\n")))


def mutations(report: Column) -> Column:
    """array<struct<mutation, target, text>>: the original and each seeded error."""
    strip = F.regexp_replace(report, r"\s*\[依据[:：][^\]]+\]", "")
    texts = (
        ("orig", "", report),
        ("drop_causation", DIMENSIONS[2], without_section(report, "致因分析")),
        ("drop_evidence_boundary", DIMENSIONS[1], without_section(report, "事实与证据边界")),
        ("fake_speed", DIMENSIONS[0], F.concat(F.rtrim(report), F.lit(FAKE_SPEED))),
        ("overclaim_liability", DIMENSIONS[2], F.concat(F.rtrim(report), F.lit(OVERCLAIM))),
        ("fake_law", DIMENSIONS[3], F.concat(F.rtrim(report), F.lit(FAKE_LAW))),
        ("strip_citations", DIMENSIONS[3], strip),
        ("duplicate_section", DIMENSIONS[4], longest_section_again(report)),
    )
    return F.array(*[F.struct(F.lit(m).alias("mutation"), F.lit(d).alias("target"), t.alias("text")) for m, d, t in texts])


def seeded_items(reports: DataFrame) -> DataFrame:
    """reports(report_id, text) -> item_id, report_id, mutation, target, text in no order; errors that change nothing are left out. Made where the reports stand: no text moves."""
    rows = reports.select("report_id", F.col("text").alias("_text"), F.explode(mutations(F.col("text"))).alias("m"))
    kept = rows.where((F.col("m.mutation") == "orig") | (F.col("m.text") != F.col("_text")))
    item = F.concat_ws("::", "report_id", "m.mutation")
    return kept.select(item.alias("item_id"), "report_id", "m.mutation", "m.target", "m.text")


def calibration_plan(reports: DataFrame, seed: str = "7") -> DataFrame:
    """seeded_items() in a seeded order."""
    return seeded_items(reports).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "item_id"), 256))


def calibration_summary(judged: DataFrame) -> DataFrame:
    """judged(report_id, mutation, target, total, scores map) -> mutation, n, mean_drop, detection_rate against each report's original."""
    original = judged.where("mutation = 'orig'").select("report_id", F.col("total").alias("o_total"), F.col("scores").alias("o_scores"))
    pairs = judged.where("mutation <> 'orig'").join(original, "report_id")
    lower = F.try_element_at("scores", F.col("target")) < F.try_element_at("o_scores", F.col("target"))
    return pairs.groupBy("mutation").agg(F.count("*").alias("n"), F.avg(F.col("o_total") - F.col("total")).alias("mean_drop"), F.avg(lower.cast("int")).alias("detection_rate"))
