"""Operator 10: near-duplicate documents by bottom-k sketches.

One hash function maps every word shingle to 64 bits. The k smallest values of a
document are its sketch; documents with equal shingle sets form a class, of which
one goes on. Inverted lists of retained values bring classes together, the
sketch of the union estimates their similarity, and the full sets confirm it.

Lists stay short by prefix filtering: two linked sketches share ``overlap``
values or more, so it is enough to list, for every sketch, all but the
``overlap - 1`` most frequent of its values. Values of a passage that many
documents share are frequent and therefore drop out of the lists; a value that
one sketch holds needs no list. For sets of up to k shingles the bound on the
overlap is exact, above it a linked pair falls below it, or below the estimate
asked for, with a probability under 1e-9 (binomial tail at ``SLACK``).

A list of many near copies is not expanded into pairs. Its most central class,
whose values most others hold, and its first are compared with all others, and
the links found are joined into components. What is left are lists with more
than one component. Their classes go through an exact prefix and positional
filter on the full sets, rarest shingles first: a copy with many shingles of its
own can be linked with none of the others and drops out before any pair is made.
Only members outside a list's main component are paired, with those of others,
and only where parities of their sets leave the similarity possible: every set
has ``PARITY_BITS`` bits, each the parity of the shingles hashed to it, and two
sets differ in at least as many shingles as their parities differ in bits.

Defined cases: a text without words, or null, has an empty set and is linked
with nothing; fewer words than a shingle make one shingle of all of them; a row
with a null id forms a component of its own, null, and is kept; rows with the
same id count as one document whose links are those of all its texts; ties do
not matter, since component ids are minima; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.llm.common import forget_words, in_small_batches, mix, whole, word_hashes
from tremorframe.llm.components import components
from tremorframe.session import passing_table, stage_apart, stage_table

SHINGLE = 5
SIMILARITY = 80  # percent
SKETCH = 64
SLACK = 0.37
PARITY_BITS = 512


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    hashes = word_hashes(text.lower().split())
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    out = hashes[: len(hashes) - size + 1]
    for j in range(1, size):
        out = mix(out, hashes[j : len(hashes) - size + 1 + j])
    return np.unique(mix(out, np.full(len(out), size, np.uint64)))


def lists_of(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` bits in longs: whether an odd number of hashes falls on each."""
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def hashed_sets(docs: DataFrame, size: int, keep: int | None) -> DataFrame:
    """``doc_id, n_shingles, digest, hashes, parity``: the ``keep`` smallest hashes, or all of them."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array(
                            [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()
                        ),
                        "hashes": lists_of([s[:keep] for s in sets]),
                        "parity": pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                    }
                )
        forget_words()

    return in_small_batches(docs).select("doc_id", whole().cast("binary").alias("text")).mapInArrow(
        sketch, f"doc_id {id_type}, n_shingles long, digest binary, hashes array<long>, parity array<long>"
    )


def least_overlap(n: Column, similarity: int, k: int) -> Column:
    """Values that the sketch of an ``n``-set shares at least with that of any linked set."""
    t = similarity / 100
    exact = F.ceil(n * ((2 * similarity - 100) / similarity) - F.lit(1e-9))
    return F.greatest(F.lit(1), F.when(n <= k, exact).otherwise(F.lit(ceil((t - SLACK) * k))))


def value_lists(classes: DataFrame, similarity: int, k: int) -> DataFrame:
    """``value, cid, n_shingles, weight``: the rarer values of each sketch that other sketches hold too.

    ``weight`` is how often the values of a sketch occur: high for a central one.
    """
    postings = classes.select("cid", "n_shingles", F.explode("hashes").alias("value"))
    counts = stage_table(postings.groupBy("value").count().filter("count > 1"), "dedup-values")
    shared = postings.join(counts, "value")
    held = F.least(F.col("n_shingles"), F.lit(k))
    prefix = held - least_overlap(F.col("n_shingles"), similarity, k) + 1
    # the values no other sketch holds are the rarest and use up places of the prefix
    listed = F.greatest(F.lit(0), prefix - (held - F.size("_values"))).cast("int")
    return (
        shared.groupBy("cid", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("_values"), F.sum("count").alias("weight"))
        .select("cid", "n_shingles", "weight", F.explode(F.slice("_values", 1, listed)).alias("_v"))
        .select(F.col("_v.value").alias("value"), "cid", "n_shingles", "weight")
    )


def fits(a: Column, b: Column, similarity: int) -> Column:
    """Two sizes that allow the similarity."""
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def may_be_similar(a: str, b: str, similarity: int) -> Column:
    """Whether sizes ``n`` and parities of two sets allow the similarity."""
    words = range(PARITY_BITS // 64)
    differ = sum((F.bit_count(F.col(f"{a}.parity.p{i}").bitwiseXOR(F.col(f"{b}.parity.p{i}"))) for i in words), F.lit(0))
    # d different ones of n + m leave (n + m - d) / 2 shared of (n + m + d) / 2
    return differ * (100 + similarity) <= (100 - similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int, k: int) -> DataFrame:
    """Of the pairs ``a, b`` of classes those whose full sets are similar enough."""

    def with_side(df: DataFrame, side: str, table: DataFrame, column: str) -> DataFrame:
        other = table.select(F.col("cid").alias(side), F.col(column).alias(f"_{column}_{side}"))
        return df.join(other, side)

    for side in "ab":
        pairs = with_side(pairs, side, classes, "hashes")
    both = F.array_intersect("_hashes_a", "_hashes_b")
    union = F.slice(F.sort_array(F.array_union("_hashes_a", "_hashes_b")), 1, k)
    estimate = F.size(F.array_intersect(both, union)) / F.size(union)
    likely = stage_table(pairs.filter(estimate >= similarity / 100 - SLACK).select("a", "b"), "dedup-likely")
    for side in "ab":
        likely = with_side(likely, side, sets, "all")
    shared = F.size(F.array_intersect("_all_a", "_all_b"))
    union_size = F.size("_all_a") + F.size("_all_b") - shared
    return likely.filter(100 * shared >= similarity * union_size).select("a", "b")


def pairs_between(rest: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``a, b``: pairs of classes in different components ``c`` that the full sets allow.

    Two linked sets share one of their ``n - ceil(similarity * n) + 1`` rarest
    shingles each, and behind the first they share enough are left in both.
    """
    tokens = rest.join(sets, "cid").select("cid", "c", F.size("all").alias("n"), F.explode("all").alias("value"))
    counts = stage_table(tokens.groupBy("value").count().filter("count > 1"), "dedup-shingles")
    own = F.col("n") - F.size("_values")  # the rarest: no other set holds them
    prefix = F.col("n") - F.ceil(F.col("n") * similarity / 100 - F.lit(1e-9)) + 1
    listed = F.greatest(F.lit(0), prefix - own).cast("int")
    entries = stage_table(
        tokens.join(counts, "value")
        .groupBy("cid", "c", "n")
        .agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("_values"))
        .select("cid", "c", "n", own.alias("own"), F.posexplode(F.slice("_values", 1, listed)).alias("i", "_v"))
        .select(F.col("_v.value").alias("value"), "cid", "c", "n", (F.col("n") - F.col("own") - F.col("i")).alias("left")),
        "dedup-prefixes",
    )
    main = (
        entries.groupBy("value", "c").agg(F.count("*").alias("m"))
        .groupBy("value").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("several"))
        .filter("several > 1")
    )
    main = stage_table(main.select("value", "main"), "dedup-main")
    words = (F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY_BITS // 64))
    parity = rest.join(sets, "cid").select("cid", F.struct(*words).alias("parity"))
    several = stage_table(entries.join(main, "value").join(parity, "cid"), "dedup-several")
    minor = several.filter("c <> main").alias("x")
    among = several.withColumn("is_main", F.col("c") == F.col("main")).alias("y")
    enough = F.least("x.left", "y.left") * (100 + similarity) >= similarity * (F.col("x.n") + F.col("y.n"))
    return (
        minor.join(among, "value")
        .filter("x.c <> y.c and (y.is_main or x.cid < y.cid)")
        .filter(enough & fits(F.col("x.n"), F.col("y.n"), similarity) & may_be_similar("x", "y", similarity))
        .select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, k: int = SKETCH
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per row of ``docs``."""
    with passing_table(hashed_sets(docs, size, k).drop("parity"), "dedup-sketches") as sketches:
        classes = stage_table(
            sketches.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("digest")
            .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("hashes").alias("hashes"))
            .withColumn("cid", F.monotonically_increasing_id()),
            "dedup-classes",
        )
        placed = stage_table(
            sketches.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left"),
            "dedup-placed",
        )
    lists = value_lists(classes, similarity, k)
    lists = stage_table(lists, "dedup-lists")
    ends = stage_table(
        lists.groupBy("value")
        .agg(
            F.min(F.struct("cid", "n_shingles")).alias("_first"),
            F.max(F.struct("weight", "cid", "n_shingles")).alias("_top"),
            F.count("*").alias("n"),
        )
        .filter("n > 1")
        .select("value", "_first", F.struct("_top.cid", "_top.n_shingles").alias("_central")),
        "dedup-ends",
    )
    lists = stage_table(lists.join(ends.select("value"), "value", "left_semi"), "dedup-shared-lists")
    sets = full_sets(docs, classes, lists, size)

    def paired(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    with_ends = lists.join(ends, "value").select("cid", "n_shingles", F.explode(F.array("_first", "_central")).alias("_end"))
    first_pairs = (
        with_ends.filter("cid <> _end.cid")
        .filter(fits(F.col("n_shingles"), F.col("_end.n_shingles"), similarity))
        .select(*paired(F.col("cid"), F.col("_end.cid")))
        .distinct()
    )
    links = stage_table(confirmed(first_pairs, classes, sets, similarity, k), "dedup-links")
    known = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # what those two have not brought together
    labelled = stage_table(
        lists.join(known.withColumnRenamed("node", "cid"), "cid", "left").select(
            "value", "cid", F.coalesce("component", "cid").alias("c")
        ),
        "dedup-labelled",
    )
    open_lists = labelled.groupBy("value").agg(F.min("c").alias("_min"), F.max("c").alias("_max")).filter("_min <> _max")
    rest = labelled.join(open_lists.select("value"), "value", "left_semi").select("cid", "c").distinct()
    rest_pairs = pairs_between(stage_table(rest, "dedup-open"), sets, similarity)
    more = confirmed(rest_pairs.join(first_pairs, ["a", "b"], "left_anti"), classes, sets, similarity, k)
    reps = classes.select("cid", "rep")
    all_links = (
        links.unionByName(more)
        .join(reps.select(F.col("cid").alias("a"), F.col("rep").alias("u")), "a")
        .join(reps.select(F.col("cid").alias("b"), F.col("rep").alias("v")), "b")
        .select("u", "v")
    )
    # an id with several texts holds their classes together
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v")
    same_id = (
        placed.join(several.select("doc_id", F.col("u").alias("_u")), "doc_id")
        .filter("rep <> _u")
        .select(F.col("rep").alias("u"), F.col("_u").alias("v"))
    )
    found = components(all_links.unionByName(same_id)).select(F.col("node").alias("rep"), "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return (
        placed.join(found, "rep", "left")
        .withColumn("component_id", component)
        .select(
            "doc_id", "n_shingles", "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def full_sets(docs: DataFrame, classes: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """``cid, all``: the whole sets of the classes that stand in a list with another."""
    wanted = classes.join(lists.select("cid").distinct(), "cid", "left_semi").select("cid", "digest", "rep")
    wanted = stage_table(wanted, "dedup-wanted")
    texts = docs.select("doc_id", "text").join(
        wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    return stage_table(
        hashed_sets(texts, size, None)
        .join(wanted.select("cid", "digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
        .select("cid", F.col("hashes").alias("all"), "parity")
        .dropDuplicates(["cid"]),
        "dedup-sets",
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component; of rows with one id the smallest stays.

    Rows without id, and rows without words, all stay.
    """
    # the texts are shuffled last, when no other table is left
    told = stage_apart(docs.sparkSession, lambda: near_duplicates(docs, **options), "dedup-told")
    gone = told.filter("not kept").select("doc_id").distinct()
    several = told.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    several = stage_table(several, "dedup-several")
    kept = docs.join(gone, "doc_id", "left_anti")
    if several.isEmpty():
        return kept.select(*docs.columns)  # the texts meet the decision once
    others = [c for c in docs.columns if c != "doc_id"]
    merged = (
        kept.join(several, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text", *[c for c in others if c != "text"])).alias("_row"))
        .select("doc_id", "_row.*")
        .select(*docs.columns)
    )
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(merged)
