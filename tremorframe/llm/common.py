"""Helpers the text operators share.

Words are runs of bytes other than space and 0x09-0x0D, the same set that
``bytes.split()`` cuts at; ``bytes.lower()`` folds A-Z and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"


def whole(text: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text in order, as an array."""
    return F.array_remove(F.split(text, SPACE), "")


def number_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def fold(part: int, modulus: int, doc_id: str = "doc_id") -> Column:
    """Whether the id's number has the remainder ``part``."""
    return number_of(doc_id) % modulus == part


class Memo(dict):
    """Remembers what ``compute`` gave for a key, in two generations of bounded size."""

    def __init__(self, compute: Callable, limit: int = 300_000) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        """Give the memory back: a worker lives on with the next stage."""
        self.clear()
        self.old = {}


_WORD_HASHES = Memo(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words."""
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))


def forget_words() -> None:
    """What ``word_hashes`` remembers is of no use to the next stage."""
    _WORD_HASHES.forget()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two hash arrays, element by element."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


# By default a batch holds 10,000 texts of any length, in Python and, off the heap, in the JVM.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = 4 << 20


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts go to Python in batches of about ``TEXT_BATCH`` bytes from now on."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_BYTES) != str(TEXT_BATCH):
        conf.set(BATCH_BYTES, str(TEXT_BATCH))
    return docs


def bytes_of(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
