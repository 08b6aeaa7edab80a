"""Operator 4: token counts from a digest cache.

The cache is a Parquet table of (content digest, version digest, n_tokens). The
content digest is SHA-256 of the UTF-8 text with null as the empty text; the
version digest covers the tokenizer file, its kind and the library's version.
Texts are reduced to distinct digests in the map tasks and after the shuffle,
those the cache knows are left out, the rest is encoded once and appended, and
all documents take their counts from the cache by digest.

An append that ran twice leaves equal rows, which are merged when read.

Defined cases: a null or empty text has 0 bytes and 0 tokens; null ids and
repeated rows give a row each; an empty table appends nothing and gives an empty
result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tokenizers
from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.llm.common import whole
from tremorframe.llm.tokens import ByteIds

LIMIT = 1024
DOCS_AT_ONCE = 64
CACHE = "digest binary, version string, n_tokens long"


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    """One memory of words per Python worker."""
    return ByteIds(path)


def version_of(tokenizer_path: str) -> str:
    """Digest of all that counts depend on besides the text."""
    with open(tokenizer_path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"tokenizers {tokenizers.__version__} {content}".encode()).hexdigest()


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def cached_counts(cache: DataFrame, version: str) -> DataFrame:
    """``(digest, n_tokens)`` of one version, a row per digest."""
    return cache.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, known: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """Cache rows for the distinct texts that ``known`` lacks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(tokenizer_path)
        for batch in batches:
            numbers: list[int] = []
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                ids = encoder.ids(batch.column(1).slice(at, DOCS_AT_ONCE).to_pylist())
                numbers.extend(len(x) // 4 for x in ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": batch.column(0),
                    "version": pa.array([version] * batch.num_rows, pa.string()),
                    "n_tokens": pa.array(numbers, pa.int64()),
                }
            )

    text = whole()
    distinct = docs.select(digest(text).alias("digest"), text.alias("text")).dropDuplicates(["digest"])
    return distinct.join(known, "digest", "left_anti").select("digest", "text").mapInArrow(count, CACHE)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document; what the cache at ``cache_path`` lacks is added to it."""
    spark = docs.sparkSession
    version = version_of(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache_path)
    known = cached_counts(spark.read.schema(CACHE).parquet(cache_path), version)
    encode_misses(docs, known, tokenizer_path, version).write.mode("append").parquet(cache_path)
    counts = cached_counts(spark.read.schema(CACHE).parquet(cache_path), version)
    text = whole()
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest(text).alias("digest"))
    return sized.join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
