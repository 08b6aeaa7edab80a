"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorframe.llm import licenses, lm, mixing, near_dedup, packing, quality, runs, secret_scan, token_counts, topk, toxicity, trie, warc
from tremorframe.llm.common import fold, number_of, whole, word_array
from tremorframe.session import scratch_path, stage_table, tune

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Where the tokenizer files lie; the package that brings them knows.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~fold(1, 3))
    return toxicity.score_with_verdict(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id",
        fold(1, 3).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.POINT).cast("int").alias("predicted"),
        F.col("_toxic").alias("toxic_for_language"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own, so that a run does not live on what an earlier one has counted
    cache = scratch_path(spark, "token-counts")
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), cache)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = licenses.TEMPLATES + licenses.FULL_TEXTS
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), templates, evidence=licenses.EVIDENCE)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first rule that rejects depends on measured times, the verdict does not
    return quality.figures(table(spark, sf_dir, "documents")).drop("failed_rule")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(table(spark, sf_dir, "documents"), ~fold(2, 7))
    return scored.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, similarity=85)


def tiled_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; where the id's number ends in 0, the words from a place on repeat the first few of them."""
    h, words = number_of("doc_id"), F.col("_w")
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    copies = F.ceil((n - a) / p).cast("int")
    tiles = F.flatten(F.array_repeat(F.slice(words, a + 1, p), copies))
    tiled = F.slice(F.concat(F.slice(words, F.lit(1), a), tiles), F.lit(1), n)
    taken = docs.select("doc_id", "text", F.when(h % 10 == 0, word_array(whole())).alias("_w"))
    return taken.select("doc_id", F.when(n > 0, F.array_join(tiled, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("runs")
    lines = F.transform(found, lambda r: F.concat_ws(",", r.start, r.length, r.period))
    # the runs are in order of start and period, so the first of the greatest stays
    greatest = F.reduce(
        found,
        F.get(found, F.lit(0)),
        lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best),
    )
    out = runs.find_runs(tiled_words(table(spark, sf_dir, "documents"))).withColumn("_best", greatest)
    return out.select(
        "doc_id",
        F.size(found).cast("long").alias("n_runs"),
        *(F.col(f"_best.{name}").alias(name) for name in ("start", "length", "period")),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first few turns from the one whose id ends in 00."""
    turns = stage_table(trie.numbered_turns(conversations), "turns")
    h = number_of("conv_id") % 6
    heads = turns.filter("place = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = turns.filter("conv_id % 100 = 0 and place <= 5").withColumnRenamed("conv_id", "base")
    borrowed = heads.join(bases, "base").filter("place <= h").select("conv_id", "place", "turn", "n_chars")
    own = turns.filter(F.col("place") > h).select("conv_id", "place", "turn", "n_chars")
    named = heads.selectExpr("conv_id", "0L as place", "cast(null as binary) as turn", "cast(null as long) as n_chars")
    return named.unionByName(borrowed).unionByName(own)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt_turns(table(spark, sf_dir, "conversations")))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def llm_queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_packing": op3_packing,
        "op4_token_counts": op4_token_counts,
        "op5_licenses": op5_licenses,
        "op6_topk": op6_topk,
        "op7_quality": op7_quality,
        "op8_lm_scores": op8_lm_scores,
        "op9_mixing": op9_mixing,
        "op10_near_dedup": op10_near_dedup,
        "op11_runs": op11_runs,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_secrets": op13_secrets,
    }
