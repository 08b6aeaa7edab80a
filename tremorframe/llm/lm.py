"""Operator 8: language-model scores by deleted interpolation.

The probability of a word after another mixes maximum-likelihood estimates,

    l2 * c(h, w) / c(h)  +  l1 * c(w) / N  +  l0 / (V + 1),

with weights that depend on the bucket (power of two) of the context's count.
They are learned by expectation-maximisation on held-out counts: every training
document is scored with its own occurrences deleted from all counts.

Counts cover all training documents and are exact per 64-bit hash of the word or
pair. Documents travel in blocks of some megabytes. A block asks once for each
word and pair it holds: the sorted hashes go, cut at equal ranges of the hash, to
the task of the range, which adds up the training counts of all blocks and
answers with the totals in the order asked. So nothing is gathered per word and
a frequent word costs one entry per block. Blocks, answers and counted tokens are
written to the shared folder; a lost executor repeats its blocks or ranges.

Defined cases: a null or empty text is the end token alone; null ids and
repeated rows are scored each; without training documents N and V are 0 and
every token has probability 1; an empty table gives an empty result; other
columns are not read. One text has to fit a block's task in memory.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.llm.common import bytes_of, mix, whole, word_hashes
from tremorframe.session import stage_table

BLOCK_BYTES = 8 << 20
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
BUCKETS = 64
# Held-out statistics are kept in cells: half powers of two of the pair's share, powers of two of the word's.
PAIR_CELLS, WORD_CELLS = 96, 48
ROUNDS = 60
BLOCK = "block string, data binary"
REQUEST = "kind int, part int, block string, hashes binary, counts binary"
ANSWER = "kind int, part int, block string, totals binary, known long, total long"
COUNTED = "docs binary, words binary, pairs binary, cells array<long>, cell_n array<long>, cell_pair array<double>, cell_word array<double>"


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high planes of small numbers vanish."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def from_ipc(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def make_blocks(docs: DataFrame, training: Column, block_bytes: int) -> DataFrame:
    """Rows of about ``block_bytes`` of text each: ids, training flags and texts, compressed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            whole_block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{number}"]), pa.array([to_ipc(whole_block)], pa.binary())], names=["block", "data"]
            )

        for batch in batches:
            ends = np.cumsum(np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: batch.num_rows + 1]))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = int(np.searchsorted(ends, before + block_bytes - size)) + 1
                part = batch.slice(at, to - at)
                held.append(part)
                size += int(ends[min(to, batch.num_rows) - 1] - before)
                at += part.num_rows
                if size >= block_bytes:
                    yield block()
                    number, size = number + 1, 0
                    held.clear()
        if held:
            yield block()

    rows = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("training"), whole().cast("binary").alias("text"))
    return rows.mapInArrow(cut, BLOCK)


class Tokens:
    """The hashed tokens of a block: distinct words and pairs, and where each occurs."""

    def __init__(self, block: pa.RecordBatch) -> None:
        words = [word_hashes(t.lower().split()) for t in block.column(2).to_pylist()]
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        flat = np.empty(self.ends[-1] if len(words) else 0, np.uint64)
        for start, w in zip(self.starts, words):
            flat[start : start + len(w)] = w
            flat[start + len(w)] = END
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[self.starts] = START
        self.training = np.repeat(np.array(block.column(1).to_pylist(), bool), self.lengths)
        self.words, self.word_at = np.unique(flat, return_inverse=True)
        self.pairs, self.pair_at = np.unique(mix(before, flat), return_inverse=True)

    def document_counts(self, at: np.ndarray) -> np.ndarray:
        """How often the document of each token holds the same word or pair."""
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        _, where, count = np.unique(owner << 32 | at, return_inverse=True, return_counts=True)
        return count[where]


def bounds(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def ask(blocks: DataFrame, parts: int) -> DataFrame:
    """What each block asks of each range of hashes, with its own training counts."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bounds(parts)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens, rows = Tokens(from_ipc(data.as_py())), []
                for kind, hashes, at in ((1, tokens.words, tokens.word_at), (2, tokens.pairs, tokens.pair_at)):
                    counts = np.bincount(at[tokens.training], minlength=len(hashes)).astype(np.uint32)
                    cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
                    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if b > a:
                            steps = np.diff(hashes[a:b], prepend=np.uint64(0))
                            rows.append((kind, part, name, pack(steps), pack(counts[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary()),
                        pa.array([r[4] for r in rows], pa.binary()),
                    ],
                    names=["kind", "part", "block", "hashes", "counts"],
                )

    return blocks.mapInArrow(requests, REQUEST)


def answer(requests: DataFrame) -> DataFrame:
    """Totals over all blocks, in the order each block asked; ``known`` and ``total`` stand once per range."""

    def add_up(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("hashes")]
        counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")])
        distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(where, counts, len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(h) for h in hashes])
        per_block = [pack(totals[where[e - len(h) : e]]) for h, e in zip(hashes, ends)]
        once = np.arange(len(hashes)) == 0
        return pa.table(
            {
                "kind": table.column("kind"), "part": table.column("part"), "block": table.column("block"),
                "totals": pa.array(per_block, pa.binary()),
                "known": pa.array(np.where(once, int((totals > 0).sum()), 0), pa.int64()),
                "total": pa.array(np.where(once, int(totals.sum()), 0), pa.int64()),
            }
        )

    return requests.groupBy("kind", "part").applyInArrow(add_up, ANSWER)


def context_counts(words: np.ndarray, starts: np.ndarray, documents: int) -> np.ndarray:
    """Count of the word before each token; before the first one stand all documents."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[starts] = documents
    return out


def buckets_of(contexts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two of its count."""
    return np.where(contexts > 0, np.log2(np.maximum(contexts, 1)).astype(np.int64) + 1, 0)


def cell(share: np.ndarray, per_octave: int, most: int) -> np.ndarray:
    depth = -np.log2(np.where(share > 0, share, 1.0)) * per_octave
    return np.where(share > 0, np.minimum(depth.astype(np.int64) + 1, most - 1), 0)


def count_tokens(blocks: DataFrame, answers: DataFrame, documents: int, n: int, v: int) -> DataFrame:
    """Documents with base scores, counts of their tokens, and the held-out statistics of each block."""

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        replies = sorted(
            zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("totals").to_pylist())
        )
        for data in left.column("data"):
            block = from_ipc(data.as_py())
            tokens = Tokens(block)
            of_word, of_pair = (
                np.concatenate([unpack(t, np.uint64) for k, _, t in replies if k == kind]).astype(np.int64)
                for kind in (1, 2)
            )
            words, pairs = of_word[tokens.word_at], of_pair[tokens.pair_at]
            contexts = context_counts(words, tokens.starts, documents)
            base = np.log10((words + 1) / (n + v + 1))
            docs = pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    block.column(1),
                    pa.array(tokens.lengths),
                    pa.array(np.add.reduceat((words > 0).astype(np.int64), tokens.starts)),
                    pa.array(np.add.reduceat(base, tokens.starts)),
                ],
                names=["doc_id", "training", "n_tokens", "n_known", "base_score"],
            )
            # the same with each training document's own occurrences deleted
            own_words, own_pairs = tokens.document_counts(tokens.word_at), tokens.document_counts(tokens.pair_at)
            own_contexts = context_counts(own_words, tokens.starts, 1)
            at = tokens.training
            left_n = np.maximum(n - np.repeat(tokens.lengths, tokens.lengths)[at], 1)
            left_contexts = (contexts - own_contexts)[at]
            pair_share = (pairs - own_pairs)[at] / np.maximum(left_contexts, 1)
            word_share = (words - own_words)[at] / left_n
            key = (
                buckets_of(left_contexts) * PAIR_CELLS + cell(pair_share, 2, PAIR_CELLS)
            ) * WORD_CELLS + cell(word_share, 1, WORD_CELLS)
            cells, where = np.unique(key, return_inverse=True)
            rows.append(
                {
                    "docs": to_ipc(docs),
                    "words": pack(words.astype(np.uint64)),
                    "pairs": pack(pairs.astype(np.uint64)),
                    "cells": cells.tolist(),
                    "cell_n": np.bincount(where, minlength=len(cells)).tolist(),
                    "cell_pair": np.bincount(where, pair_share, len(cells)).tolist(),
                    "cell_word": np.bincount(where, word_share, len(cells)).tolist(),
                }
            )
        return pa.Table.from_pylist(rows, pa.schema([
            ("docs", pa.binary()), ("words", pa.binary()), ("pairs", pa.binary()), ("cells", pa.list_(pa.int64())),
            ("cell_n", pa.list_(pa.int64())), ("cell_pair", pa.list_(pa.float64())), ("cell_word", pa.list_(pa.float64())),
        ]))

    return blocks.groupBy("block").cogroup(answers.select("kind", "part", "block", "totals").groupBy("block")).applyInArrow(
        counted, COUNTED
    )


def learn_weights(counted: DataFrame, v: int) -> np.ndarray:
    """Weights (bucket x [pair, word, uniform]) by expectation-maximisation.

    The cells come to the driver: at most ``BUCKETS * PAIR_CELLS * WORD_CELLS``.
    """
    zipped = F.explode(F.arrays_zip("cells", "cell_n", "cell_pair", "cell_word"))
    sums = (
        counted.select(zipped.alias("c"))
        .groupBy(F.col("c.cells").alias("key"))
        .agg(F.sum("c.cell_n").alias("n"), F.sum("c.cell_pair").alias("pair"), F.sum("c.cell_word").alias("word"))
        .orderBy("key")
        .collect()
    )
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    key = np.array([r["key"] for r in sums], np.int64)
    n = np.array([r["n"] for r in sums], float)
    shares = np.column_stack(
        [[r["pair"] for r in sums] / np.maximum(n, 1), [r["word"] for r in sums] / np.maximum(n, 1), np.full(len(n), 1 / (v + 1))]
    ) if len(sums) else np.zeros((0, 3))
    bucket = key // (PAIR_CELLS * WORD_CELLS)
    for b in np.unique(bucket):
        mine, w = bucket == b, np.array([0.3, 0.6, 0.1])
        for _ in range(ROUNDS):
            parts = shares[mine] * w
            w = (n[mine, None] * parts / parts.sum(1, keepdims=True)).sum(0)
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        weights[b] = w
    # a bucket without held-out tokens takes the next smaller one's
    for b in range(1, BUCKETS):
        if b not in bucket and len(bucket):
            weights[b] = weights[b - 1]
    return weights


def score_documents(
    docs: DataFrame, training: Column, block_bytes: int = BLOCK_BYTES, parts: int | None = None
) -> DataFrame:
    """``doc_id, training, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = stage_table(make_blocks(docs, training, block_bytes), "lm-blocks")
    trained = docs.filter(F.coalesce(training, F.lit(False))).count()
    # as many ranges as blocks, so that a range's task handles about as much as a block's
    parts = parts or max(1, -(-bytes_of(docs, "text") // block_bytes))
    answers = stage_table(answer(ask(blocks, parts)), "lm-answers")
    row = answers.filter("kind = 1").agg(F.sum("total"), F.sum("known")).first()
    n, v = row[0] or 0, row[1] or 0
    counted = stage_table(count_tokens(blocks, answers, trained, n, v), "lm-counted")
    weights = learn_weights(counted, v)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, of_word, of_pair in zip(*(batch.column(i).to_pylist() for i in range(3))):
                told = from_ipc(data)
                words, pairs = unpack(of_word, np.uint64).astype(np.int64), unpack(of_pair, np.uint64).astype(np.int64)
                lengths = np.array(told.column(2).to_pylist(), np.int64)
                starts = np.cumsum(lengths) - lengths
                contexts = context_counts(words, starts, trained)
                w = weights[buckets_of(contexts)]
                p = w[:, 0] * pairs / np.maximum(contexts, 1) + w[:, 1] * words / max(n, 1) + w[:, 2] / (v + 1)
                if n == 0:
                    p = np.ones(len(words))
                columns = [
                    *(told.column(i) for i in range(4)),
                    pa.array(np.full(told.num_rows, n), pa.int64()),
                    told.column(4),
                    pa.array(np.add.reduceat(np.log10(p), starts)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    return counted.select("docs", "words", "pairs").mapInArrow(
        scored,
        f"doc_id {id_type}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
