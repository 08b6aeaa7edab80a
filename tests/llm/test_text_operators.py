"""Operators 3, 4, 5, 7, 9 against brute force, with the cases their docstrings define."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tremorframe.llm import licenses, mixing, packing, quality, token_counts  # noqa: E402
from tremorframe.llm.queries import op5_licenses, tokenizer_path  # noqa: E402
from tremorframe.llm.tokens import ByteIds, WordEndIds, load  # noqa: E402

DOCS = "doc_id long, text string, source string, _words string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "", "  a b", "a  b", "x\n\ny", " ", "\n", "foo<|endoftext|> bar", "<|startoftext|>a", "İstanbul Ünïcode ﬁ",
    "é café", "a b c", "don't WON'T it's", "a\x01b \x01 c", "\x1c x", "日本語 テキスト 12345",
    "tab\tx y", "end \n", "Σας ΣΑΣ", "á̂ ́b", "ǅ ß ẞ K", "1 2 33 444", "'s 'Re x'LL", "\x85 y z",
]


def docs_of(spark, rows):
    """Rows of (doc_id, text[, source]) with a column whose name clashes with an internal one."""
    full = [(*r, "s")[:3] + ("clash",) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return SPACE.findall(text or "")


@pytest.mark.parametrize("kind, name", [(WordEndIds, "word_bpe_49k.json"), (ByteIds, "byte_bpe_50k.json")])
@pytest.mark.parametrize("limit", [100_000, 3])
def test_remembered_ids_are_the_librarys(kind, name, limit):
    path = tokenizer_path(name)
    rng, letters = random.Random(3), "ab cZ\n'.,É1ß\t<|> é́ "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    whole, fast = load(path), kind(path, limit)
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        for text, ids in zip(part, fast.ids(part)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_a_word_is_encoded_once_whatever_marks_follow_it():
    path = tokenizer_path("word_bpe_49k.json")
    encoder = WordEndIds(path)
    texts = ["Großhaus, étés. don't. 3, a.b; <|endoftext|>!", "Großhaus; étés?! ... Großhaus. x<|endoftext|>,", "ΑΣ, é. ×. µ:"]
    expected = [encoder.encoded(text) for text in texts]
    assert encoder.ids(texts[:1]) == expected[:1]
    assert {"Großhaus", "étés", ","} <= set(encoder.known)  # the word without its mark
    assert encoder.ids(texts) == expected
    small = WordEndIds(path, limit=2)  # words come back from the older memory
    assert [small.ids([text])[0] for text in texts * 2] == expected * 2


def test_packing_gives_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (1, "same id"), (1, "same id"), (50, None), (51, "word " * 9000)]
    got = packing.pack(docs_of(spark, rows), tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    tokenizer = load(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for _, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        start = 0
        for length in packing.binary_lengths(len(ids), 4096):
            want[(start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), tuple(ids[start : start + length]))] += 1
            start += length
    assert want == Counter((r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in got)
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and bin(r.length).count("1") == 1 and r.length <= 4096 for r in got)
    assert all(r.length == 1 << r.bucket and r.sequence_id >> packing.BUCKET_IDS == r.bucket for r in got)


def test_packing_empty_table_and_buckets(spark, tmp_path):
    docs = docs_of(spark, [(1, "a b c"), (2, "d")])
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)
    packing.write_buckets(packed, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("length=*")) == ["length=2", "length=4"]
    with pytest.raises(ValueError):
        packing.pack(docs, "x", sequence_length=100)


def test_token_counts_come_from_the_cache(spark, tmp_path):
    path, cache = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (1, "x y"), (1, "x y"), (60, None), (61, "long text " * 3000)]
    docs = docs_of(spark, rows)
    tokenizer = load(path)

    def want(rows):
        return Counter(
            (i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024)
            for i, t in rows
        )

    assert Counter(map(tuple, token_counts.count_tokens(docs, path, cache).collect())) == want(rows)
    distinct = len({t or "" for _, t in rows})
    assert spark.read.parquet(cache).count() == distinct
    # a second run encodes only what is new
    more = rows + [(99, "something new")]
    assert Counter(map(tuple, token_counts.count_tokens(docs_of(spark, more), path, cache).collect())) == want(more)
    assert spark.read.parquet(cache).count() == distinct + 1
    # what the cache says is believed; a doubled append does no harm; other versions are ignored
    stored = spark.read.parquet(cache).toPandas()
    spark.createDataFrame(stored).write.mode("append").parquet(cache)
    other = spark.createDataFrame(stored.assign(version="other", n_tokens=-1))
    other.write.mode("append").parquet(cache)
    assert Counter(map(tuple, token_counts.count_tokens(docs, path, cache).collect())) == want(rows)
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


def brute_licenses(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    places = [
        (i, label)
        for label, phrase in licenses.PHRASES.items()
        for i in range(len(tokens))
        if tokens[i : i + len(phrase.split())] == phrase.split()
    ]
    found, best = set(), 0.0
    half = licenses.BLOCK_WORDS // 2
    for start in range(0, max(len(tokens) - half, 1), half):
        block = set(tokens[start : start + 2 * half])
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            share = len(t & block) / len(t)
            if share >= licenses.THRESHOLD:
                found.add(label)
                best = max(best, share)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (
        len(tokens), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best,
    )


def test_licenses_equal_brute_force(spark):
    rng = random.Random(5)
    pool = "under the mit license apache version 2 cc by nc licensed gnu general public 3 this work is of and x ÉÉ K".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 200)))) for i in range(120)]
    rows += [
        (500, None), (501, ""), (None, "Released UNDER the MIT-License."), (502, "cc by nc cc by nc"), (502, "cc by nc cc by nc"),
        (503, "x " * 3000 + "Licensed under the Apache License,\nVersion 2.0." + " y" * 500), (504, "Kelvin: lİcense under the mıt license"),
        (505, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = licenses.scan_licenses(docs_of(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_licenses(t)) for i, t in rows)
    assert any("gpl-3" in r.labels and not r.base_labels for r in got)
    assert licenses.scan_licenses(docs_of(spark, rows).limit(0)).count() == 0


NOTICES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU General Public License, version 2.", ""),
    ("This library is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3"),
    ("This work is licensed under the GNU Affero General Public License v3.", "agpl-3"),
    ("To a lesser extent. This work is licensed under the GNU General Public License version 3", "gpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Il sa. Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Released under the MIT License.", "mit"),
    ("Released under the terms of the license", ""), ("Es kam mit ihm. Released under the Zlib license", ""),
    ("Licensed under the Apache License, Version 2.0", "apache-2"), ("Licensed under the Apache License, Version 1.0", ""),
    ("This file is subject to the terms of the Mozilla Public License, version 2.0", "mpl-2"),
    ("This file is subject to the terms of the Mozilla Public License, version 1.1", ""),
    (licenses.TEMPLATES[-1][1], "bsd"),
]


def test_a_notice_has_its_own_label_alone(spark, tmp_path):
    for filler in (0, 31, 32, 63, 64, 65):
        rows = [(i, "x " * filler + text) for i, (text, _) in enumerate(NOTICES)]
        both = "This work is licensed under the GNU General Public License version 3. " + NOTICES[2][0]
        docs_of(spark, rows + [(99, both)]).select("doc_id", "text").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = {r.doc_id: r.labels for r in op5_licenses(spark, str(tmp_path)).collect()}
        assert got == {i: want for i, (_, want) in enumerate(NOTICES)} | {99: "gpl-3,lgpl-3"}


def test_full_license_texts_are_found(spark, tmp_path):
    texts = [(filler, label, text) for filler in (0, 63, 150, 201) for label, text in licenses.FULL_TEXTS]
    rows = [(i, "x " * filler + text + " y" * 300) for i, (filler, _, text) in enumerate(texts)]
    docs_of(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.labels for r in op5_licenses(spark, str(tmp_path)).collect()}
    assert got == {i: label for i, (_, label, _) in enumerate(texts)}


def test_blocks_hold_a_template_of_any_length(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = docs_of(spark, [(i, "x " * filler + long + " y" * 500) for i, filler in enumerate((0, 100, 511, 700))])
    got = licenses.scan_licenses(docs, licenses.TEMPLATES + [("long", long)], threshold=1.0).collect()
    assert [r.labels for r in got] == ["long"] * 4


def brute_figures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(8)}
    chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    extra = 10 * symbols > len(w) or 10 * text.count("!") > 3 * len(w)
    extra = extra or 5 * sum(a == b for a, b in zip(w, w[1:])) > len(w) or (dup >= 3 and 2 * dup > len(lines)) or chars < 2 * len(w) or chars > 15 * len(w)
    return len(w), chars, symbols, dup, len(covered), failed, not failed and not extra


def quality_rows():
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdé") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, "\n".join(rng.choice(["one line here", "another * line", "", " "]) for _ in range(20))) for i in range(20)]
    clean = " ".join(f"word{i}" for i in range(300))
    return rows + [
        (300, None), (301, ""), (None, clean), (302, clean), (302, clean), (303, clean + " " + clean), (304, "a " * 5000),
        (307, "no! " * 3 + clean.replace(" ", "! ")), (308, " ".join(f"w{i} w{i} w{i}" for i in range(40))),
        (305, clean + "\x0b\x0c x\ty"), (306, clean + " #" * 100),
    ]


def test_quality_equals_brute_force(spark):
    rows = quality_rows()
    got = quality.figures(docs_of(spark, rows)).drop("failed_rule").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_figures(t)) for i, t in rows)
    assert quality.figures(docs_of(spark, rows).limit(0)).count() == 0


def test_cascade_gives_one_verdict_in_any_order(spark):
    docs, rules = docs_of(spark, quality_rows()).drop("_words"), quality.production_rules()
    want = Counter((i, brute_figures(t)[-1]) for i, t in quality_rows())
    for order in (rules, rules[::-1]):
        out = quality.parts(docs).select("doc_id", quality.cascade(order).isNull().alias("kept"))
        assert Counter(map(tuple, out.collect())) == want
    judged = quality.judged(docs)
    assert judged.columns == [*docs.columns, "_failed"]
    assert Counter((r.doc_id, r._failed is None) for r in judged.collect()) == want


def test_rare_hash_ties_take_the_other_way(spark):
    """Hashes that agree in 44 bits only."""
    near = 5 << 20
    rows = spark.createDataFrame([([near, near + 1, near, 9 << 20],), ([near, near + 1],), ([7, 7, 7],)], "w array<bigint>")
    assert [r[0] for r in rows.select(quality.repeated_words(F.col("w"))).collect()] == [10, 0, 10]


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    share = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        left = total - sum(capped.values())
        target = {s: left * share[s] / sum(share[x] for x in free) for s in free}
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **target}
        capped |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize("names", [["a"], ["a", "b", "ä", None, "", "Z"], [f"s{i}" for i in range(12)]])
def test_mix_meets_targets(spark, names):
    rng = random.Random(len(names))
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(names + names[:1] * 5)) for i in range(400)]
    rows += [(7, "same row", names[0])] * 3 + [(None, "x y z", names[-1]), (900, None, names[0]), (901, "v " * 4000, names[-1])]
    docs = docs_of(spark, rows)
    # names that the operator uses itself
    docs = docs.select("*", *[F.lit(c).alias(c) for c in ("doc", "size", "_size", "_source", "bucket", "key", "taken", "words", "cut")])
    got = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(words(r.doc.text)) and r.source_size == sizes[r.doc.source]
        assert r.target == pytest.approx(want[r.doc.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.doc.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1.001 for s in sizes)
    key = lambda rs: Counter((r.doc.doc_id, r.doc.text, r.doc.source, r.taken) for r in rs)
    assert key(got) == key(mixing.mix_sources(docs.repartition(7)).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    by_source = defaultdict(int)
    for r in mixed.collect():
        by_source[r.source] += len(words(r.text))
    assert {s: n for s, n in by_source.items() if n} == {s: n for s, n in taken.items() if n}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
