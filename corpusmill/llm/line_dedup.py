"""Line deduplication across documents, with DataFrame functions only.

Line hashes are range-partitioned and sorted by (hash, document, position) inside each partition, so
the first occurrence of a line streams past before its repeats. Lines so frequent that they would
fill a partition alone are found first with a frequent-items sketch of fixed size, and their first
document comes from a pre-aggregated minimum instead; which of the two ways a line takes never
changes the result. Decisions are kept as sparse 64-bit bitmap words per document, not as text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import bound
from corpusmill.llm.common import ASCII_SPACE, LOWER, UPPER, discarded, numbered_columns, pick, restored, stash

MAX_HOT = 4000  # rows of the broadcast list of frequent lines, at most
TRACKED = 16384  # items of the sketch


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """rows(doc_id, th, text) -> one row (doc_id, th, pos, h) per line whose key is long enough; h has 128 bits of SHA-256."""
    lines = rows.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "th", "pos", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("h"))


def frequent(lines: DataFrame) -> DataFrame:
    """Hashes of lines that may hold more than an eighth of a partition's even share; MAX_HOT at most.

    Sketches of the tasks are merged per group of tasks first, so no task reads more than about the square
    root of their number.
    """
    spark = lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, math.isqrt(lines.rdd.getNumPartitions()))
    parts = lines.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("part"))
    sketches = parts.agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(hex(h), {TRACKED})").alias("sketch"))
    merged = sketches.groupBy(F.lit("all").alias("all")).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    top = merged.select("n", F.expr(f"approx_top_k_estimate(sketch, {MAX_HOT})").alias("top"))
    items = top.select("n", F.explode("top").alias("x")).where(F.col("x.count") * (8 * min(tasks, 500)) > F.col("n")).where("x.count > 1")
    return items.select(F.unhex("x.item").alias("h"))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, th, pos) of lines that an earlier document holds too."""
    hot = F.broadcast(stash(frequent(lines), "hot-lines"))
    doc = F.struct("doc_id", "th")
    cold = lines.join(hot, "h", "left_anti").repartitionByRange("h")
    order = Window.partitionBy("h").orderBy("doc_id", "th", "pos")
    streamed = cold.withColumn("holder", F.first(doc).over(order)).where(~doc.eqNullSafe(F.col("holder")))
    common = lines.join(hot, "h", "left_semi")
    holders = F.broadcast(common.groupBy("h").agg(F.min(doc).alias("holder")))
    repeated = common.join(holders, "h").where(~doc.eqNullSafe(F.col("holder")))
    return streamed.select("doc_id", "th", "pos").unionByName(repeated.select("doc_id", "th", "pos"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, th, dropped: map word -> 64 bits); words without a dropped line are left out."""
    word = F.expr("pos div 64").cast("int").alias("word")
    bits = F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")
    words = dropped.groupBy("doc_id", "th", word).agg(bits)
    return words.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def document_bitmaps(rows: DataFrame, min_chars: int) -> DataFrame:
    """rows(doc_id, th, text) -> m_id, m_th, dropped of the documents that lose a line."""
    with discarded(rows.sparkSession):
        lines = stash(line_hashes(rows, min_chars), "lines")
        return stash(drop_bitmaps(dropped_lines(lines)).toDF("m_id", "m_th", "dropped"), "bitmaps", outer=True)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per input row: doc_id, text, n_lines, n_dropped, dropped (sparse bitmap words; null: all lines stay).

    A text is split at \\n; null or empty text is one empty line. A line whose key (see line_key) has
    min_chars code points or more and is found in two documents or more stays only in the smallest
    doc_id that holds it, there as often as it stands. Null ids sort first. Rows repeated with one id
    and text are one document; rows with one id and different texts are two, ordered by text hash.
    An empty table gives an empty result. Extra columns are not read.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("th", F.xxhash64("text"))
    maps = document_bitmaps(rows, min_chars)
    joined = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    n_dropped = dropped_count(F.col("dropped"))
    return joined.select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), "dropped")


def dropped_count(dropped: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.coalesce(F.aggregate(F.map_values(dropped), zero, lambda a, b: a + F.bit_count(b)), zero)


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines that stay, joined by \\n; the bitmap's words are laid out as an array once, so each line costs one look."""
    last = F.array_max(F.map_keys(dropped))
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(dropped, w), F.lit(0).cast("long")))
    word = lambda words, i: F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    stays = lambda words: F.array_join(F.filter(F.split(text, "\n"), lambda _, i: F.getbit(word(words, i), i % 64) == 0), "\n")
    return F.when(dropped.isNull(), text).otherwise(bound(dense, stays))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """keep_bitmaps with kept_text: what is left of each text."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars)
    return maps.withColumn("kept_text", kept_text(F.col("text"), F.col("dropped")))


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents with all their columns and what is left of their texts; those that lose all their lines go.

    n_chars, where there is such a column, follows the new text. The rest is as in keep_bitmaps.
    """
    plain, at = numbered_columns(docs)
    doc_id, text = at[id_col], at[text_col]
    hashed = plain.withColumn("th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = hashed.select(F.col(doc_id).alias("doc_id"), "th", F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = hashed.join(document_bitmaps(rows, min_chars), F.col(doc_id).eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    left = joined.where(F.col("dropped").isNull() | (dropped_count(F.col("dropped")) < F.size(F.split(F.col(text), "\n"))))
    out = left.withColumn(text, kept_text(F.col(text), F.col("dropped")))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return restored(out, docs.columns)
