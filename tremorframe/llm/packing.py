"""Operator 3: packing by power-of-two decomposition.

The ids of a document are cut into pieces of ``sequence_length`` and then into
the powers of two of what is left, longest first. A piece is a sequence of its
own: its length is a power of two, so it needs no padding and no sequence
crosses documents. Pieces of equal length form a bucket, named by the power; the
sequences of a bucket have a range of ids of their own, so a range of ids holds
equal lengths alone, and ``write_buckets`` lays files out that way. Every row is
handled alone, so nothing is shuffled.

Defined cases: a null or empty text is the end id alone, one piece of length 1;
null ids and repeated rows are packed like any other row; an empty table gives
an empty result; only the id and the text are read, so other columns may have
any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tremorframe.llm.common import in_small_batches, whole
from tremorframe.llm.tokens import WordEndIds

SEQUENCE_LENGTH = 4096
END_ID = 2
WORDS = 500_000
DOCS_AT_ONCE = 64
BUCKET_IDS = 58  # bits of the ids of a bucket: 2 ** 25 tasks of 2 ** 33 sequences each


@lru_cache(maxsize=2)
def word_end_ids(path: str, words: int) -> WordEndIds:
    """One memory of words per Python worker."""
    return WordEndIds(path, words)


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """``tokens`` as pieces of ``longest`` and falling powers of two."""
    whole_pieces, rest = divmod(tokens, longest)
    return [longest] * whole_pieces + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    sequence_length: int = SEQUENCE_LENGTH,
    end_id: int = END_ID,
    with_ids: bool = False,
    words: int = WORDS,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids. ``sequence_length`` is a power of two below 2 ** 32.

    A Python worker remembers up to twice ``words`` words, of about 240 bytes each. Fewer take more time.
    """
    if sequence_length & (sequence_length - 1) or not 0 < sequence_length < 1 << 32:
        raise ValueError("sequence_length must be a power of two below 2 ** 32")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_end_ids(tokenizer_path, words)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                rows, starts, lengths, crcs, totals, kept = [], [], [], [], [], []
                for row, ids in enumerate(encoder.ids(part.column(1).to_pylist())):
                    ids += end
                    view, start, total = memoryview(ids), 0, len(ids) // 4
                    for length in binary_lengths(total, sequence_length):
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(view[4 * start : 4 * (start + length)]))
                        start += length
                    rows.extend([row] * (len(starts) - len(rows)))
                    totals.extend([total] * (len(starts) - len(totals)))
                    if with_ids:
                        kept.append(ids)
                columns = {
                    "doc_id": part.column(0).take(pa.array(rows, pa.int32())),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "doc_tokens": pa.array(totals, pa.int64()),
                }
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    cut = in_small_batches(docs).select("doc_id", whole().alias("text")).mapInArrow(
        pieces, schema + (", ids array<int>" if with_ids else "")
    )
    numbered = cut.withColumn("sequence_id", F.monotonically_increasing_id())
    bucket = F.bit_count(F.col("length") - 1)  # of a power of two its exponent
    sequence_id = F.shiftleft(bucket.cast("long"), BUCKET_IDS) + F.col("sequence_id")
    return numbered.withColumns({"sequence_id": sequence_id, "offset": F.lit(0).cast("long"), "bucket": bucket})


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per length; a large bucket is spread over many tasks."""
    sequences.hint("rebalance", "length").write.mode("overwrite").partitionBy("length").parquet(path)
