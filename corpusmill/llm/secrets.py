"""Secret scan: fixed patterns plus sliding-window entropy, with DataFrame functions only.

Spark's regular expressions return matched strings, not places. Places come from arithmetic: the
text split at a pattern gives what stands between its matches, so lengths of pieces and matches,
summed in turn, give every start and end in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bound
from corpusmill.llm.common import pick

# The base patterns. The two with a least length match the same spans as without it,
# since their runs are maximal; assign is filtered after matching, for a failing match still uses up its text.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
# Candidates for entropy and the allow list: words, numbers, UUIDs, letter-only paths, repeats of one character, samples.
# The loop of paths is possessive: Java's plain loops over groups recurse once a round and overflow on long texts.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[a-z]++(?:[/_-][a-z]++)*+$",
    r"(.)\1{7}",
    r"(?i)example|sample|dummy|placeholder|0123456789|abcdefgh",
)
# Bits per character that a window must reach, by the class of the candidate's characters.
MAX_WIDTH = 1000
CODES = 128  # candidates are ASCII
CHUNK = 256  # matches that one inner fold places
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^.*$", 3.9))


SPAN = "array<struct<start:int,end:int,match:string,inner:string>>"


def placed(rows: Column) -> Column:
    """rows(gap, match, inner) -> start, end, match, inner: each match stands behind all gaps and matches before it.

    Rows are placed in chunks of CHUNK, then chunks behind each other, so no long array is copied for every match.
    """

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        end = start + F.char_length(row["match"])
        item = F.struct(start.alias("start"), end.alias("end"), row["match"].alias("match"), row["inner"].alias("inner"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    def chunk(xs: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(xs, i * CHUNK + 1, CHUNK), start, step)

    def shifted(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
        bases = F.aggregate(chunks, start, lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["bases"], F.array(s["at"])).alias("bases")))["bases"]
        move = lambda c, by: F.transform(c["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["match"].alias("match"), m["inner"].alias("inner")))
        return F.flatten(F.zip_with(chunks, bases, move))

    chunks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: chunk(xs, i))
    return bound(rows, lambda xs: F.when(F.size(xs) > 0, bound(chunks(xs), shifted)).otherwise(F.array().cast(SPAN)))


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, kind, match>> of the leftmost matches that do not overlap, in code points; end exclusive.

    Where least is set, matches whose group is shorter are taken out afterwards.
    """
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(between.alias("gap"), found.alias("match"), inner.alias("inner"))
    walked = placed(F.filter(rows, lambda r: r["match"].isNotNull()))
    if least:
        walked = F.filter(walked, lambda m: F.char_length(m["inner"]) >= least)
    shaped = F.transform(walked, lambda m: F.struct(m["start"], m["end"], F.lit(kind).alias("kind"), m["match"].alias("match")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    return F.when(text.rlike(pattern), shaped).otherwise(none)


def peak_entropy(s: Column, width: int) -> Column:
    """The highest Shannon entropy, in bits, of any width characters of an ASCII string in a row; 0 if it is shorter.

    The state holds the count of each character in the window, and the sum of c * log2(c) over them.
    One character comes in and one goes out at each step, which changes two counts, so the whole is
    linear in the string's length.
    """
    if not 0 < width <= MAX_WIDTH:
        raise ValueError(f"width must be from 1 to {MAX_WIDTH}")
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    put = lambda counts, x, n: F.concat(F.slice(counts, F.lit(1), x), F.array(n), F.slice(counts, x + 2, CODES))

    def walk(codes: Column) -> Column:
        def enter(state: Column, i: Column) -> Column:
            came = F.get(codes, i)
            had = F.get(state["counts"], came)
            return F.struct((state["sum"] + weight(had + 1) - weight(had)).alias("sum"), put(state["counts"], came, had + 1).alias("counts"), state["peak"].alias("peak"))

        def leave(state: Column, i: Column) -> Column:
            went = F.get(codes, i - width)
            had = F.get(state["counts"], went)
            return F.struct((state["sum"] + weight(had - 1) - weight(had)).alias("sum"), put(state["counts"], went, had - 1).alias("counts"), state["peak"].alias("peak"))

        def step(state: Column, i: Column) -> Column:
            moved = bound(enter(state, i), lambda e: F.when(i >= width, bound(e, lambda x: leave(x, i))).otherwise(e))
            entropy = lambda m: F.when(i >= width - 1, F.greatest(m["peak"], F.log2(F.lit(float(width))) - m["sum"] / width)).otherwise(m["peak"])
            return bound(moved, lambda m: F.struct(m["sum"].alias("sum"), m["counts"].alias("counts"), entropy(m).alias("peak")))

        start = F.struct(F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0.0).alias("peak"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["peak"])

    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)
    return bound(codes, lambda x: F.when(F.size(x) >= width, walk(x)).otherwise(F.lit(0.0)))


def suspicious(s: Column, width: int) -> Column:
    """Not allow-listed, and some window's entropy reaches what its character class asks for."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | s.rlike(pattern)
    limit = F.when(F.lit(False), F.lit(0.0))
    for _, pattern, bits in CLASSES:
        limit = limit.when(s.rlike(pattern), F.lit(bits))
    return F.when(allowed, F.lit(False)).otherwise(peak_entropy(s, width) >= limit)


def listed(items: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = lambda m: F.when(m["kind"] == "assign", 0).when(m["kind"] == "access", 1).when(m["kind"] == "hex", 2).otherwise(3)
    keyed = F.array_sort(F.transform(items, lambda m: F.struct(m["start"].alias("start"), order(m).alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """One row per input row: doc_id, and arrays assign, access, hex, entropy of spans with their text.

    Null text counts as empty and has no spans. Texts are scanned whole, in time linear in their length
    and in the number of matches up to some tens of thousands. Repeated rows give repeated
    results; null ids pass through; an empty table gives an empty result; extra columns are not read.
    """
    text = F.col("text")
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = rows.select(
        "doc_id",
        spans(text, ASSIGN, "assign", group=2, least=8).alias("assign"),
        spans(text, ACCESS, "access").alias("access"),
        spans(text, HEX, "hex").alias("hex"),
        spans(text, CANDIDATE, "entropy").alias("candidates"),
    )
    entropy = F.filter("candidates", lambda m: suspicious(m["match"], width))
    return found.select("doc_id", "assign", "access", "hex", entropy.alias("entropy"))
