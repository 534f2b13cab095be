"""The prefix trie of conversations, by partition refinement.

All conversations start in one class, the root. In each round the classes that are still active are
split by their members' next turn; a class is named by its depth and its smallest member. A class
whose members have nothing different before them, so every class of one, is retired: what is left of
it is a unary chain, read off its smallest member's turns at the end. So there are as many rounds as the longest
beginning that two different conversations share has turns. Leaves and savings are folded back from
the deepest class to the root.

Turns stay one row each. A conversation of any length is numbered by two-level prefix sums over hash
buckets of its turns' order, never gathered; lists of members are hashed as a stream of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, stash, with_python_path

PIECE_CHARS = 1 << 16
HEAD = 6  # turns of another conversation that one begins with are fewer than this
NO_ENDS = hashlib.sha256(b"").hexdigest()


def head_turns(conv_id: Column) -> Column:
    """How many turns of the base conversation a conversation begins with: crc32 of its decimal id, modulo HEAD."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("long")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, pos (from 1), sig, chars, upto: code points up to and with this turn.

    The order is by turn, null first, then by sig. Rows are range-partitioned by it, so that a
    conversation of any length is spread over tasks; numbers run on from earlier tasks by prefix sums.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    sig = F.substring(F.unhex(F.sha2(F.concat(F.sha2(role, 256), text), 256)), 1, 16)
    turns = rows.where("conv_id is not null").select("conv_id", "turn", sig.alias("sig"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("sig")]
    stored = stash(turns.repartitionByRange(F.col("conv_id"), *order).withColumn("task", F.spark_partition_id()), "turns")
    sums = stored.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = sums.select("conv_id", "task", F.coalesce(F.sum("n").over(earlier), zero).alias("n0"), F.coalesce(F.sum("c").over(earlier), zero).alias("c0"))
    mine = Window.partitionBy("conv_id", "task").orderBy(*order)
    numbered = stored.withColumn("pos", F.row_number().over(mine)).withColumn("run", F.sum("chars").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.join(bases, ["conv_id", "task"])
    return joined.select("conv_id", (F.col("pos") + F.col("n0")).alias("pos"), "sig", "chars", (F.col("run") + F.col("c0")).alias("upto"))


def rebuilt_turns(turns: DataFrame, base_of: int) -> DataFrame:
    """ordered turns -> conv_id, depth (from 1), sig, chars, upto of all rebuilt conversations.

    Each conversation begins with the first head_turns() of its base, conv_id - conv_id % base_of, and
    goes on with its own turns behind so many. At most base_of conversations (twice that around zero) have one base.
    """
    few = stash(turns.where(F.col("pos") < HEAD), "heads")  # fewer than HEAD turns of each
    every = few.groupBy("conv_id").agg(F.max("pos").alias("most")).select("conv_id", head_turns(F.col("conv_id")).alias("h"))
    wanted = every.withColumn("base", F.col("conv_id") - F.col("conv_id") % base_of)
    heads = wanted.join(few.withColumnRenamed("conv_id", "base"), "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "sig", "chars", "upto")
    taken = heads.groupBy("conv_id").agg(F.max("depth").alias("k"), F.max("upto").alias("k_chars"))
    skipped = few.where(F.col("pos") <= head_turns(F.col("conv_id"))).groupBy("conv_id").agg(F.max("upto").alias("s_chars"))
    zero = F.lit(0).cast("long")
    begins = every.join(taken, "conv_id", "left").join(skipped, "conv_id", "left").select("conv_id", "h", *[F.coalesce(c, zero).alias(c) for c in ("k", "k_chars", "s_chars")])
    own = turns.join(begins, "conv_id").where("pos > h")
    tails = own.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "sig", "chars", (F.col("k_chars") + F.col("upto") - F.col("s_chars")).alias("upto"))
    return heads.unionByName(tails)


@dataclass
class Refinement:
    """What refine() found, depth by depth.

    classes: depth, conv_id, parent, n, chars, before (code points above), done (retired), length and total
    (code points) of a member. ends: depth, conv_id, member, of classes of two or more in which conversations end.
    """

    classes: list[DataFrame]
    ends: list[DataFrame]


def _summary(step: DataFrame, *keys: str) -> DataFrame:
    same = (F.min("length") == F.max("length")) & (F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))
    largest = [F.max(c).alias(c) for c in ("chars", "before", "length", "total")]
    return step.groupBy(*keys).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), same.alias("done"), *largest)


def refine(turns: DataFrame, members: DataFrame) -> Refinement:
    """turns(conv_id, depth, sig, chars, upto, x, y), stored; members(conv_id, length, total, x, y): one row per conversation.

    x and y are the exclusive or of 64-bit hashes of the turns that a member has before it, with their
    depths; members of a class with equal ones go on alike.
    """
    zero = F.lit(0).cast("long")
    root = _summary(members.withColumns({"chars": zero, "before": zero})).where("n > 0")
    kids = stash(root.withColumn("parent", F.lit(None).cast("long")), "classes")
    first = kids.first()  # one row
    found, ends, depth = [], [], 0
    if first is not None:
        moved = members.select("conv_id", F.lit(first["low"]).alias("class"), F.lit(first["done"]).alias("done"), "length", "total", "x", "y")
    while first is not None:
        found.append(kids.select(F.lit(depth).cast("long").alias("depth"), F.col("low").alias("conv_id"), "parent", "n", "chars", "before", "done", "length", "total"))
        last = F.when(F.col("done"), F.col("length")).otherwise(F.lit(depth)).cast("long")
        ends.append(moved.where(F.col("done") | (F.col("length") == depth)).select(last.alias("depth"), F.col("class").alias("conv_id"), F.col("conv_id").alias("member")))
        if kids.where("not done").isEmpty():
            break
        depth += 1
        going = moved.where(~F.col("done") & (F.col("length") >= depth))
        turn = turns.where(F.col("depth") == depth).select("conv_id", "sig", "chars", (F.col("upto") - F.col("chars")).alias("before"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        rest = [F.col(c).bitwiseXOR(F.col(f"t{c}")).alias(c) for c in ("x", "y")]
        step = going.join(turn, "conv_id").select("conv_id", F.col("class").alias("parent"), "sig", "chars", "before", "length", "total", *rest)
        kids = stash(_summary(step, "parent", "sig"), "classes")
        many = kids.where("n > 1").select("parent", "sig", F.col("low").alias("class"), "done")
        moved = stash(step.join(many, ["parent", "sig"]).select("conv_id", "class", "done", "length", "total", "x", "y"), "members")
    return Refinement(found, ends)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def folded(classes: list[DataFrame]) -> list[DataFrame]:
    """classes of each depth -> the same with n_children, n_leaves, saved: from the deepest to the root."""
    sums, out = None, []
    for level in reversed(classes):
        zero, done = F.lit(0).cast("long"), F.col("done")
        if sums is None:
            now = level.withColumns({c: zero for c in ("kids", "leaves", "below")})
        else:
            now = level.join(sums, "conv_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("kids", "leaves", "below")})
        children = F.when(done, (F.col("length") > F.col("depth")).cast("long")).otherwise(F.col("kids"))
        leaves = F.when(done | (F.col("leaves") == 0), 1).otherwise(F.col("leaves")).cast("long")
        saved = (F.col("n") - 1) * F.when(done, F.col("total") - F.col("before")).otherwise(F.col("chars")) + F.col("below")
        now = stash(now.select(*level.columns, children.alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved")), "folded")
        out.append(now)
        sums = now.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"))
    return out


def hashed_members(ends: DataFrame) -> DataFrame:
    """ends(depth, conv_id, member) -> depth, conv_id, ends_sha256: SHA-256 of the decimal members, ascending, joined by commas.

    Tasks that hold a range of members write pieces of the list; one task then hashes the pieces of a
    class as a stream, so that a class of any size needs no more memory than a piece.
    """
    with_python_path(ends.sparkSession)
    piece, digest = "depth long, conv_id long, first long, piece string", "depth long, conv_id long, ends_sha256 string"

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, chars = None, [], 0
        for batch in batches:
            out = []
            for d, c, m in zip(batch.depth.tolist(), batch.conv_id.tolist(), batch.member.tolist(), strict=True):
                if key != (d, c) or chars > PIECE_CHARS:
                    if held:
                        out.append((*key, held[0], ",".join(map(str, held))))
                    key, held, chars = (d, c), [], 0
                held.append(m)
                chars += len(str(m)) + 1
            yield pd.DataFrame(out, columns=["depth", "conv_id", "first", "piece"])
        if held:
            yield pd.DataFrame([(*key, held[0], ",".join(map(str, held)))], columns=["depth", "conv_id", "first", "piece"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for d, c, text in zip(batch.depth.tolist(), batch.conv_id.tolist(), batch.piece.tolist(), strict=True):
                if key != (d, c):
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = (d, c), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pd.DataFrame(out, columns=["depth", "conv_id", "ends_sha256"])
        if state:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "conv_id", "ends_sha256"])

    order = ["depth", "conv_id", "member"]
    listed = stash(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pieces, piece), "member-pieces")
    return stash(listed.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInPandas(digests, digest), "member-digests")


def prefix_trie(conversations: DataFrame, base_of: int = 100, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per trie node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt first, see rebuilt_turns(). Turns of one number stand by role, then text;
    repeated rows are turns each. Null roles and texts count as empty. Rows without a conv_id are no
    conversation's. Turnless conversations are members of the root alone. An empty table has no node.
    Extra columns are not read.
    """
    rows = pick(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = stash(ordered_turns(rows), "ordered")
    rebuilt = rebuilt_turns(ordered, base_of).withColumns({"x": F.xxhash64("depth", "sig"), "y": F.xxhash64(F.lit(1), "sig", "depth")})
    turns = stash(rebuilt.sortWithinPartitions("depth"), "rebuilt")
    zero = F.lit(0).cast("long")
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("length"), F.sum("chars").alias("total"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    every = ordered.where("pos = 1").select("conv_id").join(sums, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("length", "total", "x", "y")])
    found = refine(turns, stash(every, "members"))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not found.classes:
        return every.where("false").select(*[F.lit(0).cast("long").alias(c) for c in columns], F.lit(NO_ENDS).alias("ends_sha256"))
    top = _union(folded(found.classes)).withColumnsRenamed({"parent": "parent_conv_id", "n": "n_convs", "saved": "saved_tokens"}).select(*columns, "done", "length")
    chains = _union(found.classes).where("done and length > depth").select("conv_id", F.col("depth").alias("top"), F.col("n").alias("n_convs"), "length", "total")
    below = turns.join(chains, "conv_id").where("depth > top")
    tail = below.select(
        "conv_id",
        "depth",
        F.col("conv_id").alias("parent_conv_id"),
        "n_convs",
        (F.col("length") > F.col("depth")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("chars"))).alias("saved_tokens"),
        F.lit(True).alias("done"),
        "length",
    )
    lists = hashed_members(_union(found.ends).where("depth is not null"))
    own_end = (F.col("n_convs") == 1) & F.col("done") & (F.col("length") == F.col("depth"))
    digest = F.when(own_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return top.unionByName(tail).join(lists, ["depth", "conv_id"], "left").select(*columns, digest.alias("ends_sha256"))
