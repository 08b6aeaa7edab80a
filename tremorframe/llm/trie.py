"""Operator 12: the prefix trie of conversations, by vertical bitmaps.

A node is a distinct sequence of first turns. Conversations are dealt into shards
of neighbouring ids. Within a shard every (position, turn) has a posting, the
bitset of the shard's conversations with that turn there. A depth-first walk
starts with all conversations; the postings of the next position, intersected with
a node's bitset, are its children, found by the lowest bit not yet taken, so that
one intersection is made per child. Popcounts are the members, and the bits that no
posting takes are the conversations that end at the node.

Shards meet by node, which is the digest of its turns. The sums over subtrees are
made in the shards as well: a node counts once, in the first shard that has it,
and every shard that has a node has all nodes above it, so a shard's sums over its
own subtrees add up to the whole ones. The ids that end at a node are joined
to text per shard; a shard's ids all lie before the next one's, so the lists
are digested one after another as a stream, and a hot node costs a row per shard.

Bounds: a shard holds at most ``SHARD`` conversations, as digests of their turns,
and one conversation is never split. Turns, like nodes, are equal if the
SHA-256 of their role and text are.

Defined cases: null roles and texts are empty; turns of one conversation with the
same number are in the order of their digests, repeated rows are turns of their own; rows
without a conversation id take no part; an empty table has no node, not even the
root; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.session import stage_table

SHARD = 2048
ROOT = b""
PARTS = pa.schema(
    [
        ("shard", pa.int64()),
        ("place", pa.int64()),
        ("stop", pa.int64()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("depth", pa.int64()),
        ("n_chars", pa.int64()),
        ("conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("ends", pa.string()),
    ]
)
PARTS_SQL = (
    "shard long, place long, stop long, node binary, parent binary, depth long, n_chars long, conv_id long, "
    "n_convs long, ends string"
)


def turn_digest(role: Column, text: Column) -> Column:
    """Equal for equal roles and texts; the length keeps the two apart."""
    size = F.octet_length(role).cast("string")
    return F.unhex(F.sha2(F.concat(size, F.lit(":"), role, text), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, turn, n_chars)``, places from 1 by turn number, nulls first."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("number"),
        turn_digest(role, text).alias("turn"),
        F.char_length(text).cast("long").alias("n_chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("number").asc_nulls_first(), "turn")
    return turns.withColumn("place", F.row_number().over(order).cast("long")).drop("number")


def walk(members: list[int], turns: list[list[tuple[bytes, int]]]) -> list[tuple]:
    """The rows of ``PARTS`` of one shard, depth first; ``members`` ascend."""
    postings: dict[tuple[int, bytes], int] = {}
    for bit, own in enumerate(turns):
        for place, (turn, _) in enumerate(own):
            key = (place, turn)
            postings[key] = postings.get(key, 0) | 1 << bit
    rows: list[list] = []
    stack = [((1 << len(members)) - 1, 0, ROOT, None, 0)]
    while stack:
        bits, depth, node, parent, n_chars = stack.pop()
        left, ends = bits, []
        first = members[(bits & -bits).bit_length() - 1]
        children = []
        while left:
            bit = (left & -left).bit_length() - 1
            if len(turns[bit]) == depth:
                ends.append(members[bit])
                left &= left - 1
                continue
            turn, size = turns[bit][depth]
            child = left & postings[(depth, turn)]
            children.append((child, depth + 1, hashlib.sha256(node + turn).digest(), node, size))
            left ^= child
        rows.append([members[0], len(rows), 0, node, parent, depth, n_chars, first, bits.bit_count(), ",".join(map(str, ends))])
        stack.extend(reversed(children))
    # where each subtree stops: at the next row that is not deeper
    open_rows: list[int] = []
    for place, row in enumerate(rows):
        while open_rows and rows[open_rows[-1]][5] >= row[5]:
            rows[open_rows.pop()][2] = place
        open_rows.append(place)
    for place in open_rows:
        rows[place][2] = len(rows)
    return rows


def shard_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and place; place 0 only names the conversation."""

    def done() -> pa.RecordBatch:
        columns = zip(*walk(members, turns))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PARTS.types)], schema=PARTS)

    members: list[int] = []
    turns: list[list[tuple[bytes, int]]] = []
    for batch in batches:
        for conv_id, turn, n_chars in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not members or members[-1] != conv_id:
                if len(members) == size:
                    yield done()
                    members, turns = [], []
                members.append(conv_id)
                turns.append([])
            if turn is not None:
                turns[-1].append((turn, n_chars))
    if members:
        yield done()


def shard_nodes(turns: DataFrame, size: int = SHARD) -> DataFrame:
    """The tries of all shards, from ``(conv_id, place, turn, n_chars)``."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shard_rows(batches, size)

    ranges = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "place")
    return ranges.select("conv_id", "turn", "n_chars").mapInArrow(walked, PARTS_SQL)


def _subtree_sums(part: pd.DataFrame) -> pd.DataFrame:
    """Sums over each node's own subtree; ``place`` counts a shard's rows depth first."""
    part = part.sort_values("place")
    out = {"node": part["node"].to_numpy()}
    for name in ("n_leaves", "saved"):
        upto = np.concatenate(([0], np.cumsum(part[name].to_numpy(np.int64))))
        out[name] = upto[part["stop"].to_numpy()] - upto[part["place"].to_numpy()]
    return pd.DataFrame(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of a node, which follow one another."""
    current, hashed = None, None
    done: list[tuple[bytes, str]] = []

    def rows() -> pa.RecordBatch:
        nodes, digests = zip(*done) if done else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == current:
                hashed.update(b"," + ends.encode())
                continue
            if hashed is not None:
                done.append((current, hashed.hexdigest()))
            current, hashed = node, hashlib.sha256(ends.encode())
        yield rows()
        done = []
    if hashed is not None:
        done.append((current, hashed.hexdigest()))
        yield rows()


def prefix_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per node from ``(conv_id, place, turn, n_chars)``; a row at place 0 without a turn only names its conversation."""
    parts = stage_table(shard_nodes(turns, shard), "trie-parts")
    nodes = parts.groupBy("node", "parent", "depth", "n_chars").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("shard").alias("shard")
    )
    nodes = stage_table(nodes, "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    whole = stage_table(
        nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children"
    )

    # a node counts in its first shard
    own = whole.select(
        "node",
        "shard",
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
    )
    counted = parts.select("node", "shard", "place", "stop").join(own, ["node", "shard"], "left").fillna(0, ["n_leaves", "saved"])
    sums = (
        counted.groupBy("shard")
        .applyInPandas(_subtree_sums, "node binary, n_leaves long, saved long")
        .groupBy("node")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    ends = (
        parts.filter("ends <> ''")
        .repartition("node")
        .sortWithinPartitions("node", "shard")
        .select("node", "ends")
        .mapInArrow(_digests, "node binary, ends_sha256 string")
    )
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        whole.join(sums, "node")
        .join(ends, "node", "left")
        .join(above, "parent", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
