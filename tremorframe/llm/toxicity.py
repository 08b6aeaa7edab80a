"""Operator 1: toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself, its prefixes and suffixes.
Filters of several widths run over the words of the whole text, the largest
response of each filter is kept, and a logistic layer gives the score. Training
takes a bounded sample of labelled rows (``Settings``): at most ``per_class``
rows of each label, chosen by a hash of the id, of at most ``max_words`` words.
A fifth of the sample is kept out to calibrate: a slope and a shift put the best
threshold at 0.7, and each language with enough rows gets a threshold of its own.
The threshold of a language only adds a verdict; it never enters the score.

Defined cases: a null or empty text has no words and scores as the bias alone; a
null or unknown language takes the overall threshold; null ids, repeated rows
and extra columns are kept as they are; an empty table gives an empty result;
without labels of both kinds the model scores every text 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.llm.common import in_small_batches, whole

POINT = 0.7
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHUNK = 8192


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, and the shape of the network."""

    per_class: int = 3_000
    max_words: int = 1_500
    buckets: int = 1 << 16
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 4
    batch: int = 64
    rate: float = 0.05
    calibrate_share: int = 5
    language_rows: int = 20
    seed: int = 1


GRAMS = 4


def subwords(word: bytes, buckets: int) -> list[int]:
    """Hash buckets of a word and of its first 4, 5 and 6 bytes."""
    return [
        zlib.crc32(word) % buckets,
        zlib.crc32(word[:4], 1) % buckets,
        zlib.crc32(word[:5], 2) % buckets,
        zlib.crc32(word[:6], 3) % buckets,
    ]


def words_of(text: bytes) -> list[bytes]:
    """Folded words without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


@dataclass
class Model:
    settings: Settings
    table: np.ndarray  # buckets x dim
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> width x dim x filters
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None
    shift: float = 0.0
    slope: float = 1.0
    point: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


class Scorer:
    """Scores texts; keeps the vectors of recent words in one matrix of bounded size."""

    LIMIT = 100_000

    def __init__(self, model: Model) -> None:
        self.model, s = model, model.settings
        # row 0, all zero, stands for no word
        self.rows: dict[bytes, int] = {b"": 0}
        self.vectors = np.zeros((self.LIMIT + CHUNK + 8, s.dim), np.float32)
        if model.out is not None:
            self.weights = np.concatenate([model.filters[w][j] for w in s.widths for j in range(w)], axis=1)

    def numbers(self, words: list[bytes]) -> list[int]:
        """Rows of the words in ``vectors``; unknown words are added."""
        found = list(map(self.rows.get, words))
        if None not in found:
            return found
        if len(self.rows) > self.LIMIT:
            self.rows = {b"": 0}
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        start, bare = len(self.rows), [w.strip(EDGES) for w in new]
        grams = np.array([subwords(w, self.model.settings.buckets) for w in bare], np.int64)
        # words of punctuation alone say nothing
        self.vectors[start : start + len(new)] = self.model.table[grams].sum(1) * np.array([[w != b""] for w in bare])
        self.rows.update(zip(new, range(start, start + len(new))))
        return list(map(self.rows.__getitem__, words))

    def largest(self, words: list[bytes], starts: list[int]) -> np.ndarray:
        """Largest responses between ``starts``; texts are already set apart by empty words."""
        s, at, out = self.model.settings, 0, []
        parts = self.vectors[np.array(self.numbers(words))] @ self.weights
        length = len(words) - max(s.widths) + 1
        for width in s.widths:
            total = parts[:length, at : at + s.filters]
            for j in range(1, width):
                total = total + parts[j : j + length, at + j * s.filters : at + (j + 1) * s.filters]
            at += width * s.filters
            out.append(np.maximum.reduceat(total, starts, axis=0))
        return np.concatenate(out, axis=1)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Largest responses of each text, over the whole text, in runs of about ``CHUNK`` words."""
        s = self.model.settings
        gap = [b""] * (max(s.widths) - 1)
        best = np.full((len(texts), len(s.widths) * s.filters), -1e9, np.float32)
        run: list[bytes] = []
        starts: list[int] = []
        owners: list[int] = []

        def flush() -> None:
            if owners:
                np.maximum.at(best, owners, self.largest(run + gap, starts))
            run.clear()
            starts.clear()
            owners.clear()

        for owner, text in enumerate(texts):
            words = text.lower().split() or [b""]
            for start in range(0, len(words), CHUNK):
                # a run also sees the first words of the next one
                part = words[start : start + CHUNK + len(gap)]
                if len(run) + len(part) > CHUNK:
                    flush()
                starts.append(len(run))
                owners.append(owner)
                run.extend(part)
                run.extend(gap)
        flush()
        return best

    def logits(self, texts: list[bytes]) -> np.ndarray:
        m, s = self.model, self.model.settings
        bias = np.concatenate([m.bias[w] for w in s.widths])
        return np.maximum(self.pooled(texts) + bias, 0) @ m.out + m.shift

    def scores(self, texts: list[bytes]) -> np.ndarray:
        m = self.model
        if m.out is None:
            return np.zeros(len(texts))
        z = m.slope * (self.logits(texts).astype(np.float64) - m.point) + np.log(POINT / (1 - POINT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[bytes], labels: np.ndarray, settings: Settings, weights: np.ndarray) -> Model:
    """Train by Adagrad. The first embedding dimension starts at the log odds of its bucket."""
    s, rng = settings, np.random.default_rng(settings.seed)
    vocabulary: dict[bytes, int] = {}
    docs = []
    for text in texts:
        docs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int64))
    grams = np.array([subwords(w, s.buckets) for w in vocabulary], np.int64).reshape(-1, GRAMS)
    seen = np.zeros((2, s.buckets))
    for numbers, y in zip(docs, labels):
        seen[int(y), np.unique(grams[np.unique(numbers)])] += 1
    share = (seen + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1.0)
    odds = np.log(share[1] / share[0])
    # rare buckets say little
    odds *= seen.sum(0) / (seen.sum(0) + 10)
    table = rng.normal(0, 0.02, (s.buckets, s.dim)).astype(np.float32)
    table[:, 0] = odds / 6
    filters = {w: rng.normal(0, 0.1, (w, s.dim, s.filters)).astype(np.float32) for w in s.widths}
    for w in s.widths:
        filters[w][:, 0, : s.filters // 2] = 1.0 / w
    bias = {w: np.full(s.filters, -0.5, np.float32) for w in s.widths}
    out = rng.normal(0.1, 0.05, len(s.widths) * s.filters).astype(np.float32)
    shift, past = np.float32(-1.0), {}

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        past[name] = past.get(name, 1e-6) + grad**2
        return value - s.rate * grad / np.sqrt(past[name])

    table_past = np.full(s.buckets, 1e-6)
    pad = max(s.widths) - 1
    for _ in range(s.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            batch = order[at : at + s.batch]
            used, flat = np.unique(
                np.concatenate([np.append(docs[i], [-1] * pad) for i in batch] + [[-1] * pad]), return_inverse=True
            )
            vectors = table[grams[used]].sum(1) if used[0] >= 0 else np.vstack(
                [np.zeros((1, s.dim), np.float32), table[grams[used[1:]]].sum(1)]
            )
            starts = np.cumsum([0] + [len(docs[i]) + pad for i in batch])
            x = vectors[flat]
            pooled, where = [], []
            for w in s.widths:
                z = sum(x[j : len(x) - pad + j] @ filters[w][j] for j in range(w))
                place = np.array([a + z[a:b].argmax(0) for a, b in zip(starts[:-1], starts[1:])])
                where.append(place)
                pooled.append(np.take_along_axis(z, place, 0) + bias[w])
            hidden = np.maximum(np.hstack(pooled), 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + shift, -30, 30)))
            delta = ((p - labels[batch]) * weights[batch] / len(batch)).astype(np.float32)
            back = np.outer(delta, out) * (hidden > 0)
            new_out = step("out", out, hidden.T @ delta + 1e-4 * out)
            shift = step("shift", shift, delta.sum())
            grad_words = np.zeros_like(vectors)
            for k, w in enumerate(s.widths):
                g = back[:, k * s.filters : (k + 1) * s.filters]
                bias[w] = step(f"b{w}", bias[w], g.sum(0))
                grad_filter = np.zeros_like(filters[w])
                for j in range(w):
                    at_j = where[k] + j  # documents x filters
                    grad_filter[j] = np.einsum("dfe,df->ef", x[at_j], g)
                    np.add.at(grad_words, flat[at_j], g[:, :, None] * filters[w][j].T[None])
                filters[w] = step(f"f{w}", filters[w], grad_filter + 1e-4 * filters[w])
            out = new_out
            moved = np.flatnonzero(np.abs(grad_words).sum(1) * (used >= 0))
            for g in grams[used[moved]].T:
                table_past_add = (grad_words[moved] ** 2).mean(1)
                np.add.at(table_past, g, table_past_add)
                np.add.at(table, g, -0.2 * s.rate * grad_words[moved] / np.sqrt(table_past[g])[:, None].astype(np.float32))
    return Model(s, table, filters, bias, out, float(shift))


def best_point(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Threshold with the best weighted F1; in the middle of the gap it lies in."""
    order = np.argsort(-z, kind="stable")
    hits, taken = np.cumsum((w * y)[order]), np.cumsum(w[order])
    f1 = 2 * hits / (taken + (w * y).sum())
    cut = int(np.argmax(f1))
    after = z[order[cut + 1]] if cut + 1 < len(z) else z[order[cut]] - 1.0
    return float((z[order[cut]] + after) / 2)


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, w: np.ndarray, langs: list[str | None]) -> None:
    """Slope, overall point and the thresholds by language, as scores."""
    model.point = best_point(z, y, w)
    gap = z - model.point
    slopes = np.geomspace(0.2, 20, 60)
    loss = [np.sum(w * np.logaddexp(0, -np.where(y == 1, 1, -1) * a * gap)) + 0.02 * a for a in slopes]
    model.slope = float(slopes[int(np.argmin(loss))])
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        if min((mine & (y == 1)).sum(), (mine & (y == 0)).sum()) >= model.settings.language_rows:
            point = best_point(z[mine], y[mine], w[mine])
            score = model.slope * (point - model.point) + np.log(POINT / (1 - POINT))
            model.thresholds[lang] = float(1 / (1 + np.exp(-score)))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings) -> DataFrame:
    """The bounded sample: ``text, lang, toxic, total`` with the rows of that label in the whole table."""
    known = labels.filter(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    key = F.md5(F.col("doc_id").cast("string"))
    ids = [
        known.filter(F.col("toxic") == y).orderBy(key, "doc_id").limit(settings.per_class) for y in (0, 1)
    ]
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = F.when(F.col("toxic") == 1, totals.get(1, 0)).otherwise(totals.get(0, 0))
    # at most two times per_class ids
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    words = F.regexp_count(whole(), F.lit(r"[^\x20\x09-\x0D]+"))
    return (
        docs.select("doc_id", "text", "lang")
        .join(chosen, "doc_id")
        .filter(words <= settings.max_words)
        .select(whole().alias("text"), "lang", "toxic", total.alias("total"), key.alias("key"))
        .orderBy("key", "text")
        .limit(2 * settings.per_class)
    )


def train(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> Model:
    """Fit and calibrate on the bounded sample of the labelled rows ``usable`` allows."""
    rows = training_rows(docs, labels, usable, settings).collect()
    y = np.array([r["toxic"] for r in rows], np.int64)
    texts = [r["text"].encode() for r in rows]
    empty = Model(settings, np.zeros((1, settings.dim), np.float32))
    apart = np.arange(len(rows)) % settings.calibrate_share == 0
    if min((y[~apart] == 1).sum(), (y[~apart] == 0).sum(), (y[apart] == 1).sum(), (y[apart] == 0).sum()) == 0:
        return empty
    counts = np.bincount(y, minlength=2)
    weights = np.array([r["total"] for r in rows]) / counts[y]
    model = fit(
        [t for t, a in zip(texts, apart) if not a], y[~apart], settings,
        np.where(y[~apart] == 1, len(y) / counts[1], len(y) / counts[0]) / 2,
    )
    z = Scorer(model).logits([t for t, a in zip(texts, apart) if a]).astype(np.float64)
    calibrate(model, z, y[apart], weights[apart], [r["lang"] for r, a in zip(rows, apart) if a])
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score``, in place of a column of that name. Only the text is read for it; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = in_small_batches(docs.drop("_score"))
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(len(columns))
            values = np.concatenate(
                [scorer.scores(texts.slice(i, 64).to_pylist()) for i in range(0, len(texts), 64)] or [np.zeros(0)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(columns))] + [pa.array(values, pa.float64())],
                names=[*columns, "_score"],
            )

    # a second column of one name does no harm, since the batches are read by position
    return docs.select("*", whole().cast("binary").alias("_bytes")).mapInArrow(scored, f"{schema}, _score double")


def score_with_verdict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score`` and ``_toxic``, the verdict by the threshold of the row's language."""
    return score_documents(docs, model).withColumn("_toxic", F.col("_score") >= language_threshold(model, F.col("lang")))


def language_threshold(model: Model, lang: Column) -> Column:
    """The threshold of a row's language, else the overall one."""
    out = F.lit(POINT)
    for name, value in model.thresholds.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out
