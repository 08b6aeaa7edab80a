"""Corpus pipeline: toxicity, quality rules, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read back as the next one's ``docs``.

Defined cases: a null or empty text is never toxic by words of its own, has no
words and so fails the quality rules; a null id is an id that nothing equals, so
each such row is a group of its own in near-dedup; of rows with one id the
smallest stays there, and repeated rows become one; ties between copies go to
the smallest id; a null source is a source, the last one; an empty table gives
an empty one in every stage. Columns other than ``doc_id, text, lang, source``
may have any name and are passed on as they are up to packing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorframe.llm import mixing, near_dedup, packing, quality, toxicity
from tremorframe.llm.queries import tokenizer_path
from tremorframe.session import stage_table, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
READ = ("doc_id", "text", "lang", "source")
# Workers and JVM are those of the stages before packing, whose memory they keep.
PACKED_WORDS = 200_000


def own_names(stage: Stage) -> Stage:
    """The stage on columns whose names cannot clash with its working columns."""

    @wraps(stage)
    def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return apart


@own_names
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of their language. Every labelled row may teach the model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return toxicity.score_with_verdict(docs, model).filter("not _toxic").select(*docs.columns)


@own_names
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    judged = quality.judged(docs)
    return judged.filter("_failed is null").select(*docs.columns)


@own_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicated(docs)


@own_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: copies of whole documents, and the parts at the cuts."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the ids of all documents."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True, words=PACKED_WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("quality", quality_rules),
    ("near-dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
# A trained model decides in the first stage, which SQL cannot state.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
