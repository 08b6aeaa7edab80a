"""The pipeline's stages, each on what the one before it kept, against brute force."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_corpus_operators import brute_near  # noqa: E402
from test_text_operators import brute_figures, brute_targets, words  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == before.columns

    before, after = kept["toxicity"]
    assert set(after) <= set(before) and 0 < len(after) < len(before)
    before, after = kept["quality"]
    assert Counter(after) == Counter(r for r in before if brute_figures(r.text)[-1])
    before, after = kept["near-dedup"]
    want = {i for i, _, _, stays in brute_near([(r.doc_id, r.text) for r in before], 5, 80) if stays}
    assert {r.doc_id for r in after} == want and len(after) == len(want)
    before, after = kept["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(words(r.text))
    for r in after:
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - t) < 1.001 for s, t in brute_targets(dict(sizes)).items())
    before, after = kept["packing"]
    assert sum(r.length for r in after) == sum(len(r.ids) for r in after)
    assert sum(r.start == 0 for r in after) == len(before)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 for r in after)


def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path):
    names = ["_bytes", "_score", "_toxic", "_text", "_words", "_failed", "_source", "_size", "words", "kept", "count", "doc"]
    prose = "the people of the town said that they would meet near the old bridge and have a long talk about it with friends {}"
    texts = [(1, prose), (1, prose), (2, prose + " again"), (None, prose.format("none") * 2), (3, None), (4, "")]
    rows = [(i, t, "en", None if i == 2 else "s", *(f"{n}{at}" for n in names)) for at, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{len(given)}-{name}")
            stage(spark, docs, SF_DIR).write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            if name in ("toxicity", "quality", "near-dedup"):
                assert docs.schema == before.schema
                assert set(docs.collect()) <= set(before.collect())
            elif name == "mixing":
                assert docs.schema == before.schema
                others = [c for c in docs.columns if c != "text"]
                assert set(docs.select(others).collect()) <= set(before.select(others).collect())
        assert bool(given) == bool(docs.count())
