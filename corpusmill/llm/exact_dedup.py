"""Exact deduplication through a log-structured merge index, with DataFrame functions only.

Each task is a memtable: it digests its rows and flushes them as one run, sorted by digest, whose
Parquet footer carries a Bloom filter for look-ups of single digests. Compaction merges all runs (and
an older index, if any) into one row per digest with the identifier to keep; rows are counted in the
tasks first, so no digest is gathered. A digest that occurs more than once is a hit. The index's hits
have a filter of their own, which every run is probed with: rows that fail it are single and take no
further part, and the texts of all others are verified byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, stash

BITMAP_BITS = 32768  # of one bitmap of bitmap_construct_agg
MAX_FILTER_BITS = 1 << 29  # 64 MB; an index of more hits has no filter, and all rows go the longer way


def flush_runs(rows: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """rows(doc_id, text) -> stored runs(doc_id, sha, digest), each file sorted by digest."""
    sha = F.unhex(F.sha2("text", 256))
    runs = rows.select("doc_id", sha.alias("sha")).withColumn("digest", F.substring("sha", 1, digest_bytes))
    return stash(
        runs.sortWithinPartitions("digest"),
        "runs",
        **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"},
    )


def compact(runs: DataFrame, older: DataFrame | None = None, keep: str = "largest") -> DataFrame:
    """Merge runs, and an older index, into a stored index(digest, keep_id, n)."""
    part = runs.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    if older is not None:
        part = part.unionByName(older)
    pick_id = F.max("keep_id") if keep == "largest" else F.min("keep_id")
    merged = part.groupBy("digest").agg(pick_id.alias("keep_id"), F.sum("n").alias("n"))
    return stash(merged.sortWithinPartitions("digest"), "index", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"})


@dataclass
class HitFilter:
    """A bitmap over the digests that an index holds more than once: stored pages of bits, or None beyond MAX_FILTER_BITS."""

    pages: DataFrame | None
    bits: int

    def probe(self, rows: DataFrame) -> DataFrame:
        """Adds maybe: false only for digests that are no hits. Without a filter every row may be one."""
        if self.pages is None:
            return rows.withColumn("maybe", F.lit(True))
        slot = F.pmod(F.xxhash64("digest"), F.lit(self.bits))
        pages = F.broadcast(self.pages)  # bits / 8 bytes at most
        joined = rows.withColumn("slot", slot).join(pages, F.expr(f"slot div {BITMAP_BITS}") == F.col("page"), "left")
        byte = f"cast(conv(hex(substring(bits, cast((slot % {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
        maybe = F.coalesce(F.expr(f"(shiftright({byte}, cast(slot % 8 as int)) & 1) = 1"), F.lit(False))
        return joined.withColumn("maybe", maybe).drop("slot", "page", "bits")


def hit_filter(index: DataFrame, n_hits: int, bits_per_hit: int = 16) -> HitFilter:
    """The filter of an index: sized by its hits, and none at all where it would be too large to broadcast."""
    pages = -(-max(n_hits, 1) * bits_per_hit // BITMAP_BITS)
    bits = pages * BITMAP_BITS
    if bits > MAX_FILTER_BITS:
        return HitFilter(None, bits)
    slots = index.where("n > 1").select(F.pmod(F.xxhash64("digest"), F.lit(bits)).alias("slot"))
    page = slots.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("page")).agg(F.expr(f"bitmap_construct_agg(slot % {BITMAP_BITS})").alias("bits"))
    return HitFilter(stash(page, "filter"), bits)


def verify(rows: DataFrame, hits: HitFilter, digest_bytes: int = 32) -> DataFrame:
    """Digests of hits whose rows do not all have the same bytes; empty unless digests collide.

    The least and the greatest text of a digest are equal only if all its texts are, the one that stays
    among them. Each task brings one pair of texts per digest to the shuffle, however many rows it has.
    """
    texts = rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes))
    met = hits.probe(texts).where("maybe").groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return met.where("low <> high").select("digest")


def look_up(runs: DataFrame, index: DataFrame, hits: HitFilter, total: int) -> DataFrame:
    """runs with keep_id and n of their digests.

    Rows that fail the filter occur once and are done without a shuffle. The digests that would fill a
    good part of a task, less than 8 times as many as tasks, are broadcast; the rest meet in a join.
    """
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = index.where("n > 1").select(F.col("digest").alias("i_digest"), "keep_id", "n")
    hot = F.col("n") * (8 * tasks) > total
    often = found.where(hot).toDF("h_digest", "h_keep", "h_n")
    rows = hits.probe(runs).join(F.broadcast(often), F.col("digest") == F.col("h_digest"), "left").drop("h_digest")
    done = rows.where(F.col("h_n").isNotNull() | ~F.col("maybe"))
    rest = rows.where(F.col("h_n").isNull() & F.col("maybe")).join(found.where(~hot), F.col("digest") == F.col("i_digest"), "left")
    columns = runs.columns
    shown = lambda x, keep, n: x.select(*columns, F.when(F.col(n).isNull(), F.col("doc_id")).otherwise(F.col(keep)).alias("keep_id"), F.coalesce(n, F.lit(1)).cast("long").alias("n"))
    return shown(done, "h_keep", "h_n").unionByName(shown(rest, "keep_id", "n"))


def stored(index: DataFrame, digests: list[bytes]) -> DataFrame:
    """Rows of runs or of an index with one of a few digests; files whose Bloom filters hold none of them are passed over."""
    return index.where(F.col("digest").isin(*digests))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest_bytes: int = 32,
    bits_per_hit: int = 16,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. Null ids sort below all others,
    so such a row stays only where its group has no other id. Rows repeated with one id all say the
    same. An empty table gives an empty result. Extra columns are not read.
    keep: which id of a group stays, "largest" or "smallest". digest_bytes: of SHA-256 in the index;
    fewer only make collisions likelier, which verification finds and an exact regrouping mends.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    runs = flush_runs(rows, digest_bytes)
    index = compact(runs, keep=keep)
    size = index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("hits")).first()
    hits = hit_filter(index, size["hits"], bits_per_hit)
    bad = stash(verify(rows, hits, digest_bytes), "collisions")
    out = look_up(runs, index, hits, size["rows"]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "digest"
    )
    if bad.isEmpty():
        return out.drop("digest")
    texts = rows.withColumn("sha", F.sha2("text", 256)).withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bytes)).join(bad.select("digest"), "digest", "left_semi")
    pick_id = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    groups = texts.groupBy("digest", "text").agg(pick_id.alias("keep_id"), F.count("*").alias("group_size"))
    mended = texts.join(groups, ["digest", "text"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return out.join(bad.select("digest"), "digest", "left_anti").drop("digest").unionByName(mended)
