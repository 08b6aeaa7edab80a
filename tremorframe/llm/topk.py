"""Operator 6: exact top-k inner products over a bit-sliced index.

The index holds blocks of rows. Bit i of component d of all rows of a block is a
bitmap (a slice). The product with a query is a sum of slices, shifted by the
bits of the query's component: bitmaps of equal weight are added three at a time
by full adders (sum and carry), negative components in a sum of their own that is
subtracted at the end. The score's slices then give the top rows from the most
significant one downward: rows with the bit set stay ahead while there are
enough of them. What is left are rows that tie for the last place; the smallest
ids among them are taken.

Queries go against the index in blocks: each task holds a block of one and a
block of the other. Nothing is broadcast, and only k rows leave a task per query.

Defined cases: vectors that are null, or hold a null, an infinite or NaN
component, take no part, neither as query nor as candidate, and so do null ids
and vectors that cannot be represented, since a quantised component would have
2**62 or more; a listed score that does not fit in a long is an error; a missing component of a shorter vector counts as
0; rows that share the query's id count as its own row; repeated candidates fill
a place each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.session import stage_table

BLOCK_ROWS = 32_768
QUERY_ROWS = 256
LARGEST = 1 << 62
TOO_LOW = -(1 << 63)
NO_LONG = "a score does not fit in a long: scale the vectors down"
INDEX = "block long, ids binary, low binary, slices binary, dims int, bits int"
HITS = "query_id long, query_key long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, q``: floor(scale * x) of every component, for the vectors that take part."""
    x = F.col("embedding")
    usable = F.forall(x, lambda v: F.coalesce(F.abs(scale * v.cast("double")) < float(LARGEST), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("long"))
    # a vector is checked before it is converted
    return vectors.select("vec_id", F.when(usable, whole).alias("q")).filter("q is not null and vec_id is not null")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are filled up with 0."""
    lengths = np.asarray(column.value_lengths().to_pylist(), np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def slice_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Lowest value of each component, and the slices (component x bit x words) of what lies above it."""
    low = values.min(0)
    above = values - low
    bits = max(1, int(above.max(initial=0)).bit_length())
    width = -(-len(values) // 64) * 64
    padded = np.zeros((values.shape[1], width), np.int64)
    padded[:, : len(values)] = above.T
    planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)]
    return low, np.stack(planes, 1), bits


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of at most ``block_rows`` vectors, cut inside the partitions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            low, slices, bits = slice_rows(matrix(table.column("q").chunk(0)))
            ids = table.column("vec_id").to_numpy().astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary()),
                    pa.array([slices.tobytes()], pa.binary()), pa.array([len(low)], pa.int32()), pa.array([bits], pa.int32()),
                ],
                names=["ids", "low", "slices", "dims", "bits"],
            )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_rows - rows)
                held.append(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows == block_rows:
                    yield block()
                    held.clear()
                    rows = 0
        if held:
            yield block()

    made = vectors.mapInArrow(build, INDEX.removeprefix("block long, "))
    return made.withColumn("block", F.monotonically_increasing_id()).select("block", "ids", "low", "slices", "dims", "bits")


def add_weights(weights: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sum of bitmaps given by weight, as slices from the lowest weight 0 upward."""
    out, weight = [], 0
    while any(w >= weight for w in weights):
        stacks = weights.pop(weight, [])
        x = np.concatenate(stacks) if stacks else np.zeros((0, words), np.uint64)
        while len(x) > 1:
            if len(x) == 2:
                carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
            else:
                n = len(x) // 3
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                half = a ^ b
                carry, x = (a & b) | (half & c), np.concatenate([half ^ c, x[3 * n :]])
            weights.setdefault(weight + 1, []).append(carry)
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        weight += 1
    return out


def score_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of ``query . above`` plus a power of two that makes it positive."""
    words, sides = slices.shape[2], []
    for sign in (1, -1):
        size = np.maximum(sign * query, 0)
        weights: dict[int, list[np.ndarray]] = {}
        for shift in range(int(size.max(initial=0)).bit_length()):
            which = np.flatnonzero(size >> shift & 1)
            if len(which):
                for bit in range(slices.shape[1]):
                    weights.setdefault(shift + bit, []).append(slices[which, bit])
        sides.append(add_weights(weights, words))
    plus, minus = sides
    length = max(len(plus), len(minus)) + 1
    zero = np.zeros(words, np.uint64)
    borrow, out = zero, []
    for i in range(length):
        a = plus[i] if i < len(plus) else zero
        b = minus[i] if i < len(minus) else zero
        differ = a ^ b
        out.append(differ ^ borrow)
        borrow = (~a & b) | (~differ & borrow)
    # two's complement to offset: turn the sign
    out[-1] = ~out[-1]
    return out


def top_rows(score: list[np.ndarray], allowed: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Rows of the k highest scores; of those that tie for the last places the smallest ids."""
    sure, open_rows, n_sure = np.zeros_like(allowed), allowed, 0
    for plane in reversed(score):
        high = open_rows & plane
        n = n_sure + int(np.bitwise_count(high).sum())
        if n > k:
            open_rows = high
        else:
            sure, open_rows, n_sure = sure | high, open_rows & ~plane, n
            if n == k:
                open_rows = np.zeros_like(allowed)
                break
    boundary = rows_of(open_rows)
    chosen = boundary[np.argsort(ids[boundary], kind="stable")][: k - n_sure]
    return np.concatenate([rows_of(sure), chosen])


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def values_at(score: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The scores of some rows, read back from the slices; as Python's ints, since they may be longer than 64 bits."""
    out = np.full(len(rows), -(1 << (len(score) - 1)), object)
    for i, plane in enumerate(score):
        out += ((plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(object) << i
    return out


def as_longs(scores: np.ndarray) -> np.ndarray:
    """The scores, with ``TOO_LOW`` for those below a long, which an end result seldom lists."""
    if any(x >= 1 << 63 for x in scores):
        raise ValueError(NO_LONG)
    return np.array([max(x, TOO_LOW) for x in scores], np.int64)


def search_block(row: dict, queries: pa.Table, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    ids = np.frombuffer(row["ids"], np.int64)
    low = np.frombuffer(row["low"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["bits"], -1)
    everyone = np.packbits(np.arange(slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
    wanted = matrix(queries.column("q").combine_chunks())
    fit = np.zeros((len(wanted), len(low)), np.int64)
    fit[:, : min(wanted.shape[1], len(low))] = wanted[:, : len(low)]
    for query_id, key, q in zip(queries.column("query_id").to_pylist(), queries.column("query_key").to_pylist(), fit):
        score = score_slices(slices, q)
        allowed = everyone
        if len(own := np.flatnonzero(ids == query_id)):
            allowed = everyone.copy()
            np.bitwise_and.at(allowed, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        rows = top_rows(score, allowed, k, ids)
        yield query_id, key, ids[rows], as_longs(values_at(score, rows) + sum(a * b for a, b in zip(q.tolist(), low.tolist())))


def top_k(vectors: DataFrame, is_query: Column, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every row ``is_query`` names."""
    ints = quantised(vectors)
    index = stage_table(build_index(ints, block_rows), "topk-index")
    queries = stage_table(
        ints.filter(is_query).select(
            F.col("vec_id").cast("long").alias("query_id"), F.xxhash64("q").alias("query_key"), "q"
        ).distinct(),
        "topk-queries",
    )
    slots = max(1, index.count())
    query_blocks = max(1, -(-queries.count() // query_rows))
    left = index.withColumns(
        {
            "slot": F.pmod(F.xxhash64("block"), F.lit(slots)),
            "query_block": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))),
        }
    )
    right = queries.withColumns(
        {
            "query_block": F.pmod(F.xxhash64("query_id", "query_key"), F.lit(query_blocks)).cast("int"),
            "slot": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))),
        }
    )

    def search(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = [hit for row in blocks.to_pylist() for hit in search_block(row, asked, k)] if asked.num_rows else []
        lengths = [len(f[2]) for f in found]
        return pa.table(
            {
                "query_id": pa.array(np.repeat([f[0] for f in found], lengths).astype(np.int64)),
                "query_key": pa.array(np.repeat(np.array([f[1] for f in found], np.int64), lengths)),
                "vec_id": pa.array(np.concatenate([f[2] for f in found] or [np.zeros(0, np.int64)])),
                "score": pa.array(np.concatenate([f[3] for f in found] or [np.zeros(0, np.int64)])),
            }
        )

    keys = ["slot", "query_block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, HITS)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    score = F.when(F.col("score") > TOO_LOW, F.col("score")).otherwise(F.raise_error(NO_LONG).cast("long"))
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", score.alias("score"))
    )
