"""Operator 9: mix sources to target weights.

Every document gets a hash-random key. Within its source the documents lie in
key order, cut into equal ranges of the key (buckets). Sums of words by (source,
bucket) and their running totals give each bucket's offset, so the prefix sum of a
source that holds a third of all rows is made by many tasks. A source is taken
whole as often as its target holds its size, and one more pass is cut at the exact
word: inside one bucket, the only one whose documents a window orders.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own and comes last; a null id is ordered first among equal keys;
repeated rows are separate documents, and which of two identical rows stands
first is immaterial; an empty table gives an empty result; other columns may have any
name and are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.llm.common import SPACE, whole
from tremorframe.session import stage_table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
# Ranges of the key within a source: a power of two, up to 2**20, for about so many rows.
ROWS_PER_BUCKET = 2_000


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(text, F.lit(SPACE.replace("[", "[^"))).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Target of each source, from ``(source, source_size)``.

    The target is ``level * weight``, at most ``max_repeat`` times the size. In
    the order of cap over weight the capped sources come first, so the level is
    what the caps leave, divided by the weights of the others. The windows see
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.row_number().over(by_name) - 1) % len(weights) + 1,
    )
    rows = sizes.withColumn("weight", weight).withColumn(
        "cap", (max_repeat * F.col("source_size")).cast("double")
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (
            F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        )
        / F.sum("weight").over(onwards),
    ).withColumn("rank", F.row_number().over(by_cap))
    below = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn(
        "level", F.min_by(F.when(below, F.col("level")), F.when(below, F.col("rank"))).over(everything)
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeat: int = MAX_REPEAT,
    seed: int = 9,
) -> DataFrame:
    """``doc`` (the row as a struct), ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` counts words: whole passes times the size, plus the part of the
    document inside the cut of the last pass. The documents of the buckets below a source's cut
    are in the last pass, those above are not; only the rows of the one bucket that is cut
    are brought into an order, so no other row leaves its task.
    """
    rows = docs.count()
    bits = min(20, max(8, (rows // ROWS_PER_BUCKET).bit_length()))
    doc_id, text = F.col("doc.doc_id"), F.col("doc.text")
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    key = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
    # the row as one column, so that none of its names can clash
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc")).select(
        "doc",
        F.col("doc.source").alias("source"),
        word_count(whole(text)).alias("size"),
        key.alias("key"),
        F.shiftright(key, 60 - bits).alias("bucket"),
    )
    sums = stage_table(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, max_repeat)
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("passes", passes).withColumn("rest", budget - F.col("passes") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("sum").over(up_to), F.lit(0)))
    # the first bucket that the rest does not reach the end of
    cut_here = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")))
    cut_here = cut_here.filter(F.col("offset") + F.col("sum") > F.col("rest"))
    cuts = cut_here.groupBy("p.source").agg(F.min("bucket").alias("cut"), F.min("offset").alias("cut_offset"))
    # a row per source; its size is known, so Catalyst broadcasts it where it is small
    known = stage_table(
        plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
            F.col("p.source").alias("of"), "source_size", "target", "passes", "rest", "cut", "cut_offset"
        ),
        "mix-sources",
    )
    placed = keyed.join(known, F.col("source").eqNullSafe(F.col("of")))
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    below = F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False))
    whole_passes = F.col("passes") * F.col("size")
    result = ("doc", "size", "source_size", "target")
    clear = placed.filter(~at_cut).select(
        *result, (whole_passes + F.when(below, F.col("size")).otherwise(0)).cast("long").alias("taken")
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("key", "_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("cut_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - start))
    ordered = placed.filter(at_cut).withColumn("_id", doc_id)
    return clear.unionByName(ordered.select(*result, (whole_passes + part).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: copies of whole documents, and parts.

    A document appears once per whole pass, and once more, cut after its share
    of words, where the last pass ends inside or behind it.
    """
    taken = mix_sources(docs, **options)
    whole_passes = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.col("taken") - whole_passes * F.col("size")
    pieces = F.concat(
        F.array_repeat(F.col("size"), whole_passes.cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    copies = taken.withColumn("words", F.explode(pieces))
    # each word with the space before it, so that a part keeps its lines
    spaced = F.regexp_extract_all(whole(F.col("doc.text")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(spaced, 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), part).otherwise(F.col("doc.text"))
    return copies.select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
