"""Operator 11: runs of repeated words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, at least
``max(MIN_WORDS, MIN_EXPONENT * q)`` words long, that neither neighbour extends.

The automaton of the words read so far has a state per class of substrings with
the same ends. Its suffix links form a tree; the path from the state of the
whole prefix to the root holds all suffixes, longest first. The tree is kept in
preferred paths (link-cut), each a splay tree whose states share one last end.
Appending a word accesses the path of the new state: every segment that it
crosses names an earlier end and the longest suffix that also stood there. A
distance between the two ends of at most that length is a square whose root
is primitive, since the segment holds the latest end. The longest suffix gives
the run's first word; the last one is found by reading on. All segments then
become one, coloured with the new end. Any run begins with such a square, so
none is missed. Words times log(words) operations, memory in proportion to the
words of one document.

Only stretches where a run can lie are read by the automaton. After its first q
words a run holds only words seen at most q places before, at least three times q of
them. A word whose last place is further back than a third of the unbroken
stretch around it is therefore in no run's repeated part, and cuts the stretch. The
cuts are repeated while they change anything, at most ``ROUNDS`` times; fewer
rounds leave longer stretches and the same runs.

Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; null ids and repeated rows give a row each; an empty table gives an empty
result; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_WORDS = 6
MIN_EXPONENT = 4
ROUNDS = 40
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Run = tuple[int, int, int]


def squares(ids: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """``(end, common, distance)``: the last ``common`` words up to ``end`` also end ``distance`` before, latest so."""
    # state 0 is none, state 1 the root
    step: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    # splay trees by depth; ``up`` of a tree's root is the state its path hangs on, ``last`` is held by the root
    left, right, up, last = [0, 0], [0, 0], [0, 0], [-1, -1]

    def state(size: int, edges: dict[int, int]) -> int:
        step.append(edges)
        length.append(size)
        for column in (link, left, right, up):
            column.append(0)
        last.append(-1)
        return len(step) - 1

    def rotate(x: int, y: int) -> None:
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner:
            up[inner] = y
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        else:
            last[x] = last[y]
        up[x], up[y] = z, x

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if left[y] != x and right[y] != x:
                return
            z = up[y]
            if left[z] == y:
                rotate(*((y, z) if left[y] == x else (x, y)))
            elif right[z] == y:
                rotate(*((y, z) if right[y] == x else (x, y)))
            rotate(x, up[x])

    tail = 1
    for end, word in enumerate(ids):
        new = state(length[tail] + 1, {})
        at, tail = tail, new
        while at and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if not at:
            link[new] = 1
        else:
            target = step[at][word]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                # the shorter substrings get a state of their own, above the target on its path
                upper = state(length[at] + 1, step[target].copy())
                link[upper] = link[target]
                splay(target)
                left[upper], up[upper] = left[target], target
                if left[target]:
                    up[left[target]] = upper
                left[target] = upper
                while at and step[at].get(word) == target:
                    step[at][word] = upper
                    at = link[at]
                link[target] = link[new] = upper
        # access: take the segments up to the root into one path
        below, x = new, link[new]
        up[new] = x
        while x:
            splay(x)
            if right[x]:
                last[right[x]] = last[x]
            right[x] = below
            if x != 1:
                yield end, length[x], end - last[x]
            below, x = x, up[x]
        last[below] = end


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of words outside of which no run lies."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    back = np.full(n, n + 1)
    back[order[again + 1]] = order[again + 1] - order[again]
    kept = np.flatnonzero(back <= n // (MIN_EXPONENT - 1))
    starts = sizes = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        first = np.flatnonzero(np.diff(kept, prepend=-2) != 1)
        sizes = np.diff(first, append=len(kept))
        starts = kept[first]
        # the repeated part of a run of one word has MIN_WORDS - 1 words, any other has more
        limit = np.where(sizes < MIN_WORDS - 1, 0, sizes // (MIN_EXPONENT - 1))
        stays = back[kept] <= np.repeat(limit, sizes)
        if stays.all():
            break
        kept = kept[stays]
    first = np.flatnonzero(np.diff(kept, prepend=-2) != 1)
    sizes, starts = np.diff(first, append=len(kept)), kept[first]
    lead = sizes // (MIN_EXPONENT - 1)
    return list(zip(np.maximum(starts - lead, 0).tolist(), (starts + sizes).tolist()))


def runs_of(words: Sequence[bytes]) -> list[Run]:
    """``(start, length, period)`` of every run, by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(word, len(seen)) for word in words]
    if len(ids) - len(seen) < MIN_WORDS - 1:
        return []  # too few words that stood before
    found: set[Run] = set()
    for begin, stop in stretches(np.array(ids)):
        reached: dict[int, int] = {}
        for end, common, period in squares(ids[begin:stop]):
            if period > common:
                continue
            end += begin
            if reached.get(period, 0) > end:
                continue
            start, after = end - common - period + 1, end + 1
            while start and ids[start - 1] == ids[start - 1 + period]:
                start -= 1
            while after < len(ids) and ids[after] == ids[after - period]:
                after += 1
            reached[period] = after
            if after - start >= max(MIN_WORDS, MIN_EXPONENT * period):
                found.add((start, after - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """The words without what repeats a run's first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join(word for word, stays in zip(words, keep) if stays)


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every whole text.

    ``runs`` is an array of ``(start, length, period)`` in words, by start, then period.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for content in batch.column(1):
                words = (content.as_py() or b"").split()
                own = runs_of(words)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), run)) for run in own])
                kept.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    )
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
