"""WARC archives: write captures as request, response and metadata records, read them back, and assemble transactions.

Archives are written by Spark's text writer, whose line separator is the blank line that ends a
record; they are read with the binaryFile source and parsed by Content-Length. Both work in any
store that Spark reaches. Files are gzipped whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, stash, with_python_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, payload_bytes long, payload_digest string, digest_ok boolean, fields map<string,string>"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight times twenty bits, each as four digits."""
    return F.get(F.transform(F.array(F.sha1(payload)), lambda digits: _base32(digits)), F.lit(0))


def _base32(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        bits = F.conv(F.substr(digits, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        return F.substr(F.lit(BASE32), (F.floor(bits / F.pow(F.lit(2), 15 - 5 * (i % 4))).cast("int") % 32) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), digit), "")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, content_type: str, *extra: Column) -> Column:
    """Text of a record without the two line ends behind it; extra: whole header lines, null ones left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"),
        *extra,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(EOL, *head), F.lit(EOL + EOL), block)


def _decided(rows: DataFrame, min_bytes: int, archive_bytes: int) -> DataFrame:
    """rows(page_id, url, html, bytes, sha, seq) with first (page_id, seq of the group's response; null where a payload is single), dealt for writing.

    Groups are counted on their digests alone. The payloads that would fill a good part of a task, less
    than 8 times as many as tasks, are broadcast, and their copies lose their html before the shuffle;
    all other rows meet their group in a join on the digest.
    """
    spark = rows.sparkSession
    light = stash(rows.select("page_id", "bytes", "sha", "seq"), "payloads")
    size = light.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = light.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stash(groups, "payload-groups")
    hot = F.col("n") * (8 * tasks) > size["n"]
    often = groups.where(hot).select(F.col("sha").alias("h_sha"), F.col("first").alias("h_first"))
    rows = rows.join(F.broadcast(often), F.col("sha") == F.col("h_sha"), "left")
    copy = F.coalesce(~F.col("h_first").eqNullSafe(F.struct("page_id", "seq")), F.lit(False)) & F.col("h_first").isNotNull()
    key = F.when(F.col("h_first").isNull(), F.col("sha")).otherwise(F.unhex(F.md5(F.col("seq").cast("string"))))
    rows = rows.withColumns({"html": F.when(~copy, F.col("html")), "key": key})
    files = max(tasks, -(-(size["bytes"] + 1000 * size["n"]) // archive_bytes))
    others = groups.where(~hot).select(F.col("sha").alias("g_sha"), F.col("first").alias("g_first"))
    met = rows.repartition(files, "key").join(others.repartition(files, "g_sha"), F.col("key") == F.col("g_sha"), "left")
    return met.withColumn("first", F.coalesce("h_first", "g_first"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write three records per row under path: request, response or revisit, metadata.

    Of rows with equal payloads of at least min_bytes the largest id is the response and the others
    revisit it, without a payload of their own; rows repeated with one id are one response and
    revisits (pages must be a stored table for that, whose rows come in the same order twice). Null html
    is an empty payload; null ids and urls are allowed. White space and control characters in a url are
    written as %20. Records are dealt over as many archives as hold about archive_bytes each.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"), "html", F.monotonically_increasing_id().alias("seq"))
    rows = rows.withColumns({"bytes": F.octet_length("html"), "sha": F.unhex(F.sha2("html", 256)), "sha1": base32_sha1(F.col("html"))})
    rows = _decided(rows, min_bytes, archive_bytes)
    again = F.coalesce(F.col("first.seq") != F.col("seq"), F.lit(False))
    rid = _urn(F.lit("capture"), F.col("seq"))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), rid)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        rid,
        F.when(again, http).otherwise(F.concat(http, F.col("html"))),
        "application/http; msgtype=response",
        uri,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _urn(F.lit("capture"), F.col("first.seq")))),
    )
    request = _record("request", _urn(F.lit("request"), F.col("seq")), F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{EOL}{EOL}")), "application/http; msgtype=request", uri, beside)
    fields = F.concat_ws(EOL, F.lit("via: table"), F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit(""))
    metadata = _record("metadata", _urn(F.lit("metadata"), F.col("seq")), fields, "application/warc-fields", uri, beside)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", EOL + EOL).options(compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def _lines(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split(EOL) if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of each record of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = _lines(data[at:end])
        stop = end + 4 + int(head["content-length"])
        yield head, view[end + 4 : stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; payloads: also the payload of responses, as binary.

    payload_bytes and payload_digest of a response are measured on the payload that was read;
    digest_ok tells whether its header says the same. A revisit has the digest of its header and no length.
    """
    with_python_path(spark)
    schema = RECORD + ", payload binary" * payloads

    names = [c.strip().split(" ")[0] for c in schema.replace("map<string,string>", "map").split(",")]

    def row_of(head: dict[str, str], block: memoryview) -> list:
        kind = head["warc-type"]
        size = digest = ok = payload = None
        fields = {}
        if kind in ("response", "revisit"):
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                raw = bytes(block)
                payload = raw[raw.index(b"\r\n\r\n") + 4 :]
                size, said = len(payload), digest
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                ok = digest == said
        elif kind == "metadata":
            fields = _lines(bytes(block))
        row = [head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), size, digest, ok, fields]
        return row + [payload] * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                records = parse_records(gzip.decompress(data))
                while rows := [row_of(*r) for r in islice(records, 500)]:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "digest_ok": "boolean"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs; null where a record is missing).

    A capture's records are those that name it in concurrent_to, and its own. Records are read once and
    grouped by that. Of several requests or metadata records, the least record id is taken; records of a
    capture that is not there are left out.
    """
    kind = F.col("type")
    side = F.struct(*[F.col(c) for c in records.columns if c != "payload"])
    body = F.struct(*[F.col(c) for c in records.columns])
    main = kind.isin("response", "revisit")
    keyed = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture_id is not null")
    least = lambda value, condition: F.min_by(value, F.when(condition, F.col("record_id")))
    grouped = keyed.groupBy("capture_id").agg(least(body, main).alias("response"), *[least(side, kind == k).alias(k) for k in ("request", "metadata")])
    return grouped.where("response is not null")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Adds original: the response struct that a revisit refers to (null for responses)."""
    originals = captures.where("response.type = 'response'").select(F.col("capture_id").alias("o_id"), F.struct(F.col("metadata.fields")["page-id"].alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")).alias("original"))
    return captures.join(originals, F.col("response.refers_to") == F.col("o_id"), "left").drop("o_id")


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives under path, read them back and assemble them: see write_warc, assemble, resolve_revisits.

    One row per input row; an empty table gives an empty result; extra columns are not read.
    """
    spark = pages.sparkSession
    write_warc(pages, path, min_bytes)
    captures = stash(assemble(read_warc(spark, path, payloads=False)), "captures")
    return resolve_revisits(captures)
