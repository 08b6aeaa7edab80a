"""Operators 1, 2, 6, 8, 10 against brute force, with the cases their docstrings define."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremorframe import session
from tremorframe.llm import lm, near_dedup, topk, toxicity, warc
from tremorframe.llm.common import TEXT_BATCH, in_small_batches
from tremorframe.llm.components import components


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string")


# -- toxicity


def labelled(spark, n=400):
    rng = random.Random(11)
    langs = {"en": "awful", "de": "schlimmo"}
    docs, labels = [], []
    for i in range(n):
        lang, bad = rng.choice(list(langs)), rng.random() < 0.3
        text = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 120))]
        if bad:
            text[rng.randrange(len(text))] = langs[lang] + rng.choice(["", "ung", "en", "!"])
        docs.append((i, " ".join(text), lang, "clash"))
        labels.append((i, int(bad)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, _bytes_x string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score_with_verdict(docs, model).collect() if r.doc_id % 3 == 1]
    right = [(r._score >= toxicity.POINT) == bool(truth[r.doc_id]) for r in got]
    assert np.mean(right) > 0.95 and all(0 <= r._score <= 1 for r in got)
    assert np.mean([r._toxic == bool(truth[r.doc_id]) for r in got]) > 0.95
    assert set(model.thresholds) <= {"en", "de"}


def test_toxicity_reads_the_whole_text_and_nothing_else(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, F.lit(True))
    long_text = "w1 " * 30_000
    rows = [(1, long_text, "en", ""), (2, long_text + "awful", "en", ""), (2, long_text + "awful", None, "x"), (None, None, "xx", ""), (3, "", None, ""), (4, " ### !!", "en", "")]
    got = toxicity.score_with_verdict(spark.createDataFrame(rows, docs.schema), model).collect()
    assert [r.doc_id for r in got] == [1, 2, 2, None, 3, 4]
    assert got[0]._score < 0.5 < got[1]._score == got[2]._score
    assert got[3]._score == got[4]._score and 0 <= got[3]._score < 0.5
    texts = [b"w1 w2 awful", b"", b"w5 " * 20_000 + b"awful w1", b"w3"] * 3
    scorer, chunk = toxicity.Scorer(model), toxicity.CHUNK
    together = scorer.scores(texts)
    try:
        toxicity.CHUNK = 7
        small = toxicity.Scorer(model)
        assert np.allclose(small.scores(texts), together, atol=1e-5)
    finally:
        toxicity.CHUNK = chunk
    assert np.allclose(together[:4], [scorer.scores([t])[0] for t in texts[:4]], atol=1e-5)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    model = toxicity.train(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {r._score for r in toxicity.score_documents(docs, model).collect()} == {0.0}


# -- WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [
        (1, "u", "aa"), (2, "u", "aa"), (3, "x\r\ny", None), (4, None, ""), (None, "u", "aa"), (2, "u", "aa"),
        (7, "u", "ééé\r\n\r\nContent-Length: 5\r\n\r\n"), (8, "u", "z" * 3_000_000), (9, "u", "only\x00once"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    decided = warc.decide(pages)
    manifest = warc.write_archives(decided, str(tmp_path / "raw"), file_bytes=1000)
    manifest = spark.createDataFrame(manifest.toPandas())
    index = spark.createDataFrame(warc.normalise(manifest, str(tmp_path / "members")).toPandas())
    got = warc.read_records(index, str(tmp_path / "members"), payloads=True).collect()
    best = defaultdict(lambda: -1)
    for i, _, h in rows:
        best[h or ""] = max(best[h or ""], -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = i != best[h or ""]
        want[(None if i is None else str(i), len(data), digest, "revisit" if revisit else "response", str(best[h or ""]) if revisit else None)] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    assert {r.page_id: r.payload for r in got if r.record_type == "response"}["8"] == b"z" * 3_000_000
    # the sidecar has the same offsets, and any gzip reader reads the files
    import gzip

    for path in (tmp_path / "members").glob("*.warc.gz"):
        side = [json.loads(x) for x in (path.parent / (path.name + ".idx")).read_text().splitlines()]
        assert [s["offset"] for s in side] == np.cumsum([0] + [s["length"] for s in side])[:-1].tolist()
        assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\n") == len(side)
    assert len(list((tmp_path / "raw").glob("*.warc.gz"))) > 2
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_damage_is_an_error():
    record = warc.record_bytes({"revisit": False, "record_id": "urn:uuid:1", "page_id": 1, "url": "u"}, b"abc")
    assert len(list(warc.split_records(iter([record[:10], record[10:] + record])))) == 2
    with pytest.raises(ValueError):
        list(warc.split_records(iter([record[:-3]])))


# -- exact top-k


def brute_top(vectors, k=3):
    usable = [
        (i, [math.floor(256 * x) for x in v]) for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**22 for x in v)
    ]
    out = Counter()
    for i, q in {(i, tuple(q)) for i, q in usable if i % 5 == 0}:
        hits = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
        out.update((i, rank, j, -s) for rank, (s, j) in enumerate(hits, 1))
    return out


@pytest.mark.parametrize("block_rows, query_rows", [(7, 3), (1000, 256)])
def test_topk_equals_brute_force(spark, block_rows, query_rows):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 6), 2)]) for i in range(150)]
    vectors += [(i, [0.5] * 6) for i in range(200, 230)] + [(3, [9.0] * 6)] * 4  # ties and repeated rows
    vectors += [(300, None), (None, [1.0] * 6), (305, [1.0, None]), (310, [float("nan")] * 6), (315, [float("inf")] * 6), (320, [-1.0, 2.0]), (325, []), (326, [1e30] * 6)]
    df = spark.createDataFrame([(*v, "clash") for v in vectors], "vec_id long, embedding array<double>, q string")
    got = topk.top_k(df.drop("q"), F.col("vec_id") % 5 == 0, 3, block_rows, query_rows).collect()
    assert Counter(map(tuple, got)) == brute_top(vectors)


def test_topk_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 1, 256 * -512)]
    assert topk.top_k(df.limit(0), F.lit(True), 5).count() == 0


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_topk_keeps_large_components(spark, block_rows):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(40)]
    vectors += [(50, [2.0**22, 0.0, 0.0, 1.0]), (51, [-(2.0**40), 3.0, 0.0, 0.0]), (52, [0.0, 2.0**41, 0.0, 0.0]), (55, [0.0, -1.0, 2.0**22 + 0.5, 0.0])]
    vectors += [(53, [0.0, 0.0, 0.0, 2.0**39]), (54, [0.0, 0.0, 0.0, 2.0**39 - 1])]
    q = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    want = Counter()
    for i in (i for i in q if i % 5 == 0):
        hits = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i)[:3]
        want.update((i, rank, j, -x) for rank, (x, j) in enumerate(hits, 1))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, 3, block_rows).collect())) == want


@pytest.mark.parametrize("other", [2.0**50, -(2.0**50)])
def test_topk_score_beyond_a_long_is_an_error(spark, other):
    df = spark.createDataFrame([(0, [2.0**50]), (1, [other])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit in a long"):
        topk.top_k(df, F.lit(True), 1).collect()


# -- language model


def brute_lm(rows, trained):
    """Scores with the operator's own weights are checked elsewhere; these are counts and base."""
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for _, t in rows]
    counts = Counter(x for ts, ok in zip(tokens, trained) if ok for x in ts)
    n, v = sum(counts.values()), len(counts)
    return [
        (len(ts), sum(x in counts for x in ts), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts))
        for ts in tokens
    ]


def lm_rows():
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(pool[: rng.choice([3, 40])]) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (None, "W1 w2"), (5, "w1 W1 w1"), (5, "w1 W1 w1"), (203, "new words only"), (204, "w1 " * 5000)]


def test_lm_counts_and_base_scores(spark):
    rows = lm_rows()
    trained = [i is None or i % 4 != 1 for i, _ in rows]
    docs = docs_of(spark, rows)
    training = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True))
    got = lm.score_documents(docs, training).collect()
    want = sorted((-1 if i is None else i, *w) for (i, _), w in zip(rows, brute_lm(rows, trained)))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    held = [r for r in got if not r.training]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # blocks and ranges do not matter
    small = lm.score_documents(docs.repartition(3), training, block_bytes=300, parts=5).collect()
    assert sorted(round(r.score, 6) for r in small) == sorted(round(r.score, 6) for r in got)


def test_lm_probabilities_add_up(spark):
    """After a known and after an unknown word, all words, the end and one unknown word share probability 1."""
    train = [(0, "a b a c"), (1, "a b b")]
    for known in ("a", "z"):
        # the first row is the context alone: P(start, known, end); the others replace the end
        ask = [(20, known)] + [(21 + i, f"{known} {w}") for i, w in enumerate(["a", "b", "c", "q"])]
        rows = lm.score_documents(docs_of(spark, train + ask + [(30, "")]), F.col("doc_id") < 20).collect()
        score = {r.doc_id: 10**r.score for r in rows}
        end_after = {r.doc_id: r for r in rows}
        assert end_after[24].n_known == (2 if known == "a" else 1)
        # end after a word w, from the model: ask "w" alone over P(start, w)
        singles = lm.score_documents(docs_of(spark, train + [(20 + i, w) for i, w in enumerate(["a", "b", "c", "q", "z"])]), F.col("doc_id") < 20)
        alone = {w: 10**r.score for w, r in zip("abcqz", sorted((r for r in singles.collect() if r.doc_id >= 20), key=lambda r: r.doc_id))}
        # P(known, w, end) = P(start, known) P(w | known) P(end | w), and alone[w] = P(start, w) P(end | w)
        assert all(0 < score[21 + i] < alone["a"] for i in range(4))


def test_lm_edges(spark):
    docs = docs_of(spark, [(1, None), (2, "a b")])
    assert {r.score for r in lm.score_documents(docs, F.lit(False)).collect()} == {0.0}
    assert lm.score_documents(docs.limit(0), F.lit(True)).count() == 0
    values = np.array([0, 1, 255, 256, 2**40], np.uint64)
    assert (lm.unpack(lm.pack(values), np.uint64) == values).all()


# -- near duplicates


def brute_near(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        s = {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        sets.append(s)
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and rows[x][0] is not None and rows[y][0] is not None:
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    u, v = sorted((root(rows[x][0]), root(rows[y][0])))
                    parent[v] = u
    return Counter(
        (i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets)
    )


def near_rows():
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0

    def add(tokens):
        nonlocal n
        rows.append((n, " ".join(tokens)))
        n += 1

    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 10, 40, 150, 400]))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add(copy)
    for _ in range(40):
        add([rng.choice(vocabulary) for _ in range(rng.choice([20, 120]))] + passage)
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(30):  # each near the one before it
        chain[rng.randrange(200)] = rng.choice(vocabulary)
        chain[rng.randrange(200)] = rng.choice(vocabulary)
        add(chain)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One Two"), (904, "one two"), (905, "one two three")]
    rows += [(None, rows[0][1]), (3, rows[40][1]), (3, rows[40][1]), (906, "x y " * 4000), (907, "x y " * 4001)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, percent, k", [(3, 85, 64), (5, 80, 64), (3, 85, 32)])
def test_near_duplicates_equal_brute_force(spark, size, percent, k):
    rows = near_rows()
    got = near_dedup.near_duplicates(docs_of(spark, rows), size, percent, k).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, size, percent)


def test_parities_rule_out_no_similar_sets(spark):
    rng = np.random.default_rng(3)
    rows, shared = [], []
    for n in (1, 3, 40, 90, 700, 5000):
        base = rng.integers(1, 1 << 63, n, np.uint64)
        for change in (0, 0.05, 0.1, 0.2, 0.6):
            other = np.concatenate([base[round(change * n) :], rng.integers(1, 1 << 63, round(change * n), np.uint64)])
            both = len(np.intersect1d(base, other))
            shared.append(both / (2 * n - both))
            rows.append((len(rows), *((n, near_dedup.parities(np.unique(v)).tolist()) for v in (base, other))))
    words = ", ".join(f"p{i}: long" for i in range(near_dedup.PARITY_BITS // 64))
    side = f"struct<n: long, parity: struct<{words}>>"
    flat = [(i, (x[0], tuple(x[1])), (y[0], tuple(y[1]))) for i, x, y in rows]
    df = spark.createDataFrame(flat, f"i int, x {side}, y {side}")
    told = [r[0] for r in df.orderBy("i").select(near_dedup.may_be_similar("x", "y", 80)).collect()]
    assert all(told[i] for i, s in enumerate(shared) if s >= 0.8)
    assert not any(told[i] for i, s in enumerate(shared) if s < 0.5 and rows[i][1][0] in (40, 90))


def test_workers_forget_the_words_of_near_duplicates(spark):
    """They go on to the next stage of the pipeline, whose memory they share."""

    def remembered(batches):
        from tremorframe.llm.common import _WORD_HASHES

        yield from (pa.RecordBatch.from_pydict({"n": [len(_WORD_HASHES) + len(_WORD_HASHES.old)]}) for _ in batches)

    docs = docs_of(spark, [(i, f"word{i} and word{i + 1} and more") for i in range(40)])
    near_dedup.hashed_sets(docs, 3, None).write.format("noop").mode("overwrite").save()
    told = spark.range(0, 32, 1, 32).mapInArrow(remembered, "n long").collect()
    assert len(told) == 32 and {r.n for r in told} == {0}


def test_tables_of_near_duplicates_are_gone_before_the_texts_are_shuffled(spark):
    root = session.scratch_root(spark)
    before = set(os.listdir(root))
    got = near_dedup.deduplicated(docs_of(spark, near_rows()))
    names = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert names == {"dedup-told", "dedup-several"}
    assert got.count()
    before = set(os.listdir(root))
    near_dedup.near_duplicates(docs_of(spark, near_rows()))
    assert not any(name.startswith("dedup-sketches") for name in set(os.listdir(root)) - before)


def test_long_texts_go_to_python_in_small_batches(spark):
    def batches(parts):
        yield from (pa.RecordBatch.from_pydict({"bytes": [part.nbytes]}) for part in parts)

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    told = in_small_batches(docs).mapInArrow(batches, "bytes long").collect()
    assert sum(r.bytes for r in told) > 7 * TEXT_BATCH
    assert max(r.bytes for r in told) < 1.1 * TEXT_BATCH


def test_near_duplicates_leave_one(spark):
    rows = near_rows()
    docs = docs_of(spark, rows)
    want = {i for i, _, c, kept in brute_near(rows, 5, 80) if kept and i is not None}
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 103: 100, 105: 100}
