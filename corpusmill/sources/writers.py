"""Sinks: JSON lines with a manifest, keyed upsert, append-only ledger, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, digest_columns: list[str]) -> DataFrame:
    """Writes rows as JSON lines (the path must not exist) and returns a one-row manifest: rows, and an order-free digest."""
    df.write.mode("errorifexists").json(path)
    return content_manifest(df, digest_columns).withColumn("path", F.lit(path))


def content_manifest(df: DataFrame, digest_columns: list[str]) -> DataFrame:
    """One row: rows, and a digest that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(digest_columns))), 256)
    value = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(value).cast("string").alias("digest"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old and new rows, of each key the latest by `order`; on equal order the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def append_ledger(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def within_cap(committed: Column, amount: Column, cap: Column) -> Column:
    """A reservation fits under the cap, up to rounding."""
    return committed + amount <= cap + 1e-12


def markdown_table(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A summary table as Markdown; for reports of at most `most` rows."""
    rows = df.select(*columns).limit(most).collect()
    shown = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows])


def blind_package(pairs: DataFrame, materials: str, answers: str) -> None:
    """Two folders: what reviewers see (a file per pair, no side labels) and the answer key, apart from each other."""
    a = F.when(F.col("first_is_a"), F.col("chosen")).otherwise(F.col("rejected"))
    b = F.when(F.col("first_is_a"), F.col("rejected")).otherwise(F.col("chosen"))
    pairs.select("pair_id", a.alias("text_a"), b.alias("text_b")).write.mode("errorifexists").option("maxRecordsPerFile", 1).json(materials)
    pairs.select("pair_id", F.when(F.col("first_is_a"), "A").otherwise("B").alias("chosen_side")).write.mode("errorifexists").json(answers)
