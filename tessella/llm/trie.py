"""The prefix trie of all conversations.

A node is a prefix that some conversations share, and its owner is the smallest
of these.  Once a conversation owns a prefix it owns all longer ones, so its
nodes are the chain from its first owned depth to its end, and a node is named by
(owner, depth).  A prefix is known by the exclusive or of one 128-bit hash for
each turn at its depth, which can be summed up in pieces; its digest's smallest
conversation is the owner.

The first owned depth is found by a binary search for the last depth that is not
owned.  It tries steps of falling powers of two, so a round only meets depths
that are odd multiples of its step: each round joins one probe for each
conversation still in the search with the digests of these depths, and all rounds
together read the digests once.

Sums over subtrees come from the bottom up: first along each chain, then every
chain's total goes to the prefixes above its first owned depth, which are its
conversation's prefixes.  No step walks the tree level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_few, materialize, prepare

#: Conversations that share the first turns of one of them, and the most turns shared.
FAMILY, MOST_SHARED = 100, 5
#: Turns of one conversation that one task sums up.
SEGMENT = 4096
#: Bytes of text in a piece of a list of conversations.
PIECE_BYTES = 1 << 20
NODE = ["q", "high", "low"]


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family: the CRC-32 of its decimal id modulo 6."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")


def head_of(conv_id: Column) -> Column:
    """The conversation that a family begins with."""
    return conv_id - conv_id % FAMILY


def ordered_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, index, digest, chars), turns numbered from 0 in each conversation, and rows (conv_id, turns).

    Turns are sorted by ranges, so a conversation may span many tasks.
    """
    role, text = F.coalesce(df["role"], F.lit("")), F.coalesce(df["text"], F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = df.select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    by = ["conv_id", "turn", "role", "digest"]
    placed = turns.where("conv_id is not null").repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at"))
    placed = materialize(placed, "turns")
    part = F.shiftright("at", 33).alias("part")
    runs = materialize(placed.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count("*").alias("turns")), "runs")
    before = F.sum("turns").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = materialize(runs.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "shifts")
    numbered = placed.withColumn("part", part).join(broadcast_if_few(shift), ["conv_id", "part"])
    sizes = materialize(runs.groupBy("conv_id").agg(F.sum("turns").alias("turns")), "sizes")
    return numbered.select("conv_id", (F.col("at") + F.col("shift")).alias("index"), "digest", "chars"), sizes


def rebuilt_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, digest, chars) of all rebuilt conversations, depth from 1; and rows (conv_id, depth), each conversation and its number of turns."""
    turns, sizes = ordered_turns(df)
    turns = materialize(turns, "numbered")
    heads = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head"), F.least("turns", F.lit(MOST_SHARED)).alias("head_turns"))
    asked = sizes.withColumn("shared", shared_turns(F.col("conv_id"))).withColumn("head", head_of(F.col("conv_id"))).join(broadcast_if_few(heads), "head", "left")
    taken = F.least("shared", F.coalesce("head_turns", F.lit(0))).alias("taken")
    convs = materialize(asked.select("conv_id", "head", "shared", "turns", taken), "conversations")
    few = convs.select("conv_id", "shared", "taken")
    own = turns.join(broadcast_if_few(few), "conv_id").where("index >= shared").select("conv_id", (F.col("taken") + F.col("index") - F.col("shared") + 1).alias("depth"), "digest", "chars")
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("index") < MOST_SHARED)).withColumnRenamed("conv_id", "head")
    lent = first.join(convs.select("conv_id", "head", "taken"), "head").where("index < taken").select("conv_id", (F.col("index") + 1).alias("depth"), "digest", "chars")
    ends = convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("shared"))).alias("depth"))
    return own.union(lent), ends


def running(df: DataFrame, by: str, order: str, columns: list[str], fold: Callable[..., Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` (written) with each of ``columns`` folded over the rows of ``by`` up to its own in ``order`` (from 0).

    Rows are folded in segments of ``SEGMENT`` values of ``order`` and segments
    after each other, so no task needs all rows of a group.
    """
    parts = df.withColumn("segment", F.floor(F.col(order) / SEGMENT))
    own = Window.partitionBy(by, "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(by).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy(by, "segment").agg(*(fold(c).alias(c) for c in columns))
    before = whole.select(by, "segment", *(fold(c).over(past).alias(f"{c}_before") for c in columns)).where("segment > 0")
    inside = parts.withColumns({c: fold(c).over(own) for c in columns})
    both = inside.join(broadcast_if_few(materialize(before, "segments")), [by, "segment"], "left")
    return both.select(*(join(F.col(c), F.coalesce(f"{c}_before", F.lit(0))).alias(c) if c in columns else c for c in df.columns))


def prefixes(turns: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows (conv_id, q, high, low, chars, round): the digest of each conversation's first ``q - 1`` turns, the last turn's length, and the power of two in ``q``."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest"))
    rows = turns.select("conv_id", (F.col("depth") + 1).alias("q"), hashed(1).alias("high"), hashed(2).alias("low"), "chars")
    zero = F.lit(0).cast("long")
    tops = ends.select("conv_id", F.lit(1).cast("long").alias("q"), zero.alias("high"), zero.alias("low"), zero.alias("chars"))
    summed = running(materialize(rows.union(tops), "turn-hashes"), "conv_id", "q", ["high", "low"], F.bit_xor, Column.bitwiseXOR)
    odd = F.bit_count(F.col("q").bitwiseAND(-F.col("q")) - 1)
    return materialize(summed.withColumn("round", odd).sortWithinPartitions("round"), "prefixes")


def last_lost(known: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows (conv_id, last, lost): the ``q`` of each conversation's end, and of its longest prefix that a smaller one shares (0 if there is none)."""
    ends = ends.select("conv_id", (F.col("depth") + 1).alias("last"))
    most = ends.agg(F.max("last")).first()[0] or 0
    found = materialize(ends.where(F.lit(False)).withColumn("lost", F.lit(0).cast("long")), "search")
    for power in range(most.bit_length() - 1, -1, -1):
        step = 1 << power
        fresh = ends.where((F.col("last") >= step) & (F.col("last") < 2 * step)).withColumn("lost", F.lit(0).cast("long"))
        open_now = found.union(fresh)
        probes = open_now.where(F.col("lost") + step <= F.col("last")).select("conv_id", (F.col("lost") + step).alias("q"))
        here = known.where(F.col("round") == power).select("conv_id", *NODE)
        met = here.join(broadcast_if_few(materialize(probes, "probes")), ["conv_id", "q"])
        owners = nodes.where(F.col("round") == power).select(*NODE, "owner")
        lost = met.join(owners, NODE).where("owner < conv_id").select("conv_id", F.col("q").alias("new"))
        after = open_now.join(broadcast_if_few(materialize(lost, "lost")), "conv_id", "left")
        found = materialize(after.select("conv_id", "last", F.coalesce("new", "lost").alias("lost")), "search")
    return found


def end_digests(ends: DataFrame) -> DataFrame:
    """Rows (owner, q, ends_sha256) for the ``ends`` (owner, q, conv_id): the digest of the ids in order, joined by commas.

    Ids are sorted by ranges; a node that ends within one is hashed there, the ids
    of one at a border are handed on as text in pieces, as only a digest's order is
    sequential.
    """
    schema, most = "owner long, q long, part int, piece int, ids string, ends_sha256 string", PIECE_BYTES

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, node, text, size, piece, first = TaskContext.get().partitionId(), [], None, [], 0, 0, True

        def close(last: bool) -> None:
            ids = ",".join(text)
            border = first or last or piece
            rows.append((*node, part, piece, ids if border else None, None if border else hashlib.sha256(ids.encode()).hexdigest()))

        def table() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=["owner", "q", "part", "piece", "ids", "ends_sha256"])

        for batch in batches:
            for owner, q, conv_id in zip(*(batch.column(c).to_pylist() for c in ("owner", "q", "conv_id"))):
                if node != (owner, q):
                    if node:
                        close(False)
                        first = False
                    node, text, size, piece = (owner, q), [], 0, 0
                elif size >= most:
                    rows.append((*node, part, piece, ",".join(text), None))
                    text, size, piece = [], 0, piece + 1
                text.append(str(conv_id))
                size += len(text[-1]) + 1
            yield table()
        if node:
            close(True)
            yield table()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for owner, q, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "q", "ids"))):
                if node != (owner, q):
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (owner, q), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node:
            done.append((*node, state.hexdigest()))
        columns = [pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["owner", "q", "ends_sha256"])

    by = ["owner", "q", "conv_id"]
    found = materialize(ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(runs, schema), "ends")
    pieces = found.where("ids is not null").select("owner", "q", "part", "piece", "ids")
    rest = pieces.repartition("owner", "q").sortWithinPartitions("owner", "q", "part", "piece").select("owner", "q", "ids").mapInArrow(joined, "owner long, q long, ends_sha256 string")
    return found.where("ids is null").select("owner", "q", "ends_sha256").union(rest)


def prefix_trie(df: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node of the trie of the rebuilt conversations.

    ``df`` has conv_id, turn, role and text.  Turns are ordered by turn, a null
    first, then by role and digest; a null role or text is empty.  Rows without a
    conv_id belong to no conversation.  Repeated rows are repeated turns.  A
    conversation that is left without turns is a member of the root alone; an
    empty table has no nodes, not even a root.  Extra columns are ignored.
    """
    prepare(df.sparkSession)
    turns, ends = rebuilt_turns(df)
    ends = materialize(ends, "lengths")
    known = prefixes(turns, ends)
    merged = known.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.first("round").alias("round"))
    nodes = materialize(merged.sortWithinPartitions("round"), "nodes")
    searched = last_lost(known, nodes, ends)
    at_lost = known.select("conv_id", *NODE).join(broadcast_if_few(materialize(searched.where("lost > 0").select("conv_id", F.col("lost").alias("q")), "heads")), ["conv_id", "q"])
    above = at_lost.join(nodes.select(*NODE, F.col("owner").alias("above")), NODE).select("conv_id", "above")
    convs = materialize(searched.join(broadcast_if_few(materialize(above, "above")), "conv_id", "left"), "convs")
    chains = convs.where("lost < last")
    kids = materialize(chains.where("lost > 0").groupBy(F.col("above").alias("owner"), F.col("lost").alias("q")).agg(F.count("*").alias("attached")), "kids")
    values = materialize(nodes.select("owner", "q", ((F.col("n_convs") - 1) * F.col("chars")).alias("value")), "values")
    totals = materialize(values.groupBy("owner").agg(F.sum("value").alias("total")), "totals")
    tips = kids.select(F.col("owner").alias("conv_id"), F.col("q").alias("last"), F.lit(0).alias("leaf"))
    chains = chains.join(broadcast_if_few(tips), ["conv_id", "last"], "left").join(broadcast_if_few(totals.withColumnRenamed("owner", "conv_id")), "conv_id")
    chains = materialize(chains.select("conv_id", "last", "lost", "above", "total", F.coalesce("leaf", F.lit(1)).alias("leaf")), "chains")
    passed = known.select("conv_id", *NODE).join(broadcast_if_few(chains.select("conv_id", "lost", "total", "leaf")), "conv_id").where("q <= lost")
    below = passed.groupBy(*NODE).agg(F.sum("total").alias("below"), F.sum("leaf").alias("leaves"))
    summed = running(values.withColumn("upto", F.col("value")), "owner", "q", ["upto"], F.sum, Column.__add__)
    own_end = F.when(F.col("lost") < F.col("last"), F.col("conv_id")).otherwise(F.col("above"))
    closed = end_digests(convs.select(own_end.alias("owner"), F.col("last").alias("q"), "conv_id"))
    out = nodes.drop("round", "chars").join(materialize(below, "below"), NODE, "left").join(materialize(summed, "summed"), ["owner", "q"])
    out = out.join(kids, ["owner", "q"], "left").join(materialize(closed, "closed"), ["owner", "q"], "left").join(broadcast_if_few(chains.withColumnRenamed("conv_id", "owner")), "owner")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("owner").alias("conv_id"), (F.col("q") - 1).alias("depth"), F.when(F.col("q") == F.col("lost") + 1, F.col("above")).otherwise(F.col("owner")).alias("parent_conv_id"), "n_convs",
        (zero("attached") + (F.col("q") < F.col("last")).cast("long")).alias("n_children"), (zero("leaves") + F.col("leaf")).cast("long").alias("n_leaves"),
        (F.col("total") - F.col("upto") + F.col("value") + zero("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
