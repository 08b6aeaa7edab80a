"""Exact quantiles per group that never gather a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here
a histogram finds the bin that holds each wanted rank, and only the values of
those bins are ordered:

1. count per coarse bin (combined before the shuffle) and run a cumulative sum
   over the bins of a group;
2. keep the bins that hold a wanted rank and order the values inside them.

Values are read twice and few of them are shuffled.

The rank order of bins must follow the order of values, which any
non-decreasing ``bin_of`` guarantees. Its range divided by its step bounds the
rows of step 2 per group, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.session import stage_table

_BIN, _N, _KEY = "_bin", "_n", "_all"
# Values returned for a rank lie within a share of 1 / _ACCURACY of it.
_ACCURACY = 10_000


def fixed_width(width: float) -> Callable[[Column], Column]:
    return lambda value: F.floor(value / F.lit(width))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """Occurrences of each value per group; null counts zero times.

    A null filter instead would be pushed below the aggregation and evaluate
    the value a second time there.
    """
    return df.groupBy(*keys, value).agg(F.count(value).alias(count))


def _picked(ranked: DataFrame, group: Sequence[str], keys: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """Interpolate between the values at the ranks around each position ``_h``."""

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank <= F.col("_last")), F.col("_v")))

    picks = []
    for i, name in enumerate(wanted):
        pos = F.col(f"_h{i}")
        picks += [
            at(F.floor(pos)).alias(f"_lo{i}"),
            at(F.ceil(pos)).alias(f"_hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"_w{i}"),
        ]
    picked = ranked.groupBy(*group).agg(*picks)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo{i}") + F.col(f"_w{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
            ).alias(name)
            for i, name in enumerate(wanted)
        ],
    )


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    bin_of: Callable[[Column], Column],
    fine_of: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Quantiles of values that hardly repeat, without shuffling the values.

    The map tasks count per bin, so a first pass sends a row per group, bin and
    task. A second pass over ``df`` sends only the values in the bins that hold a
    wanted rank. Those are narrowed once more by ``fine_of`` bins (default: the
    value itself), so that a bin with a large share of the values is not ordered
    in one task either. Both bins must follow the order of the values. A group
    without values gives no row. The bins wanted and the values in them are written out, so
    ``df`` is planned for each of the two passes and no more.
    """
    group = list(keys) or [_KEY]
    rows = (df if keys else df.withColumn(_KEY, F.lit(0))).select(*group, F.col(value).alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull()).na.drop(subset=group).withColumn(_BIN, bin_of(F.col("_v")))
    fine = F.coalesce((fine_of or (lambda v: v))(F.col("_v")), F.lit(0))

    along = Window.partitionBy(*group)
    running = along.orderBy(_BIN).rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy(*group, _BIN).agg(F.count("*").alias(_N))
    bins = bins.withColumn("_before", F.sum(_N).over(running) - F.col(_N)).withColumn("_total", F.sum(_N).over(along))
    positions = {f"_h{i}": F.lit(float(q)) * (F.col("_total") - 1) for i, q in enumerate(wanted.values())}

    def hit(size: str) -> Column:
        """The ranks from ``_before`` on, ``size`` of them, hold one below or above a position."""
        out = F.lit(False)
        for i in range(len(wanted)):
            low, high = F.floor(F.col(f"_h{i}")), F.ceil(F.col(f"_h{i}"))
            out = out | ((high >= F.col("_before")) & (low < F.col("_before") + F.col(size)))
        return out

    targets = stage_table(bins.withColumns(positions).filter(hit(_N)).drop(_N, "_total"), "bins")
    inside = rows.join(targets.select(*group, _BIN), [*group, _BIN], "left_semi")
    counts = stage_table(inside.groupBy(*group, _BIN, "_v").agg(F.count("*").alias(_N)).withColumn("_fine", fine), "in-bins")
    in_bin = Window.partitionBy(*group, _BIN).orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)
    narrow = (
        counts.groupBy(*group, _BIN, "_fine")
        .agg(F.sum(_N).alias("_in_fine"))
        .withColumn("_within", F.sum("_in_fine").over(in_bin) - F.col("_in_fine"))
        .join(targets, [*group, _BIN])
        .withColumn("_before", F.col("_before") + F.col("_within"))
        .filter(hit("_in_fine"))
        .drop("_in_fine", "_within")
    )
    in_fine = Window.partitionBy(*group, _BIN, "_fine").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.join(narrow, [*group, _BIN, "_fine"])
        .withColumn("_last", F.col("_before") + F.sum(_N).over(in_fine) - 1)
        .withColumn("_first", F.col("_last") - F.col(_N) + 1)
    )
    return _picked(ranked, group, keys, wanted)


def global_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column; null if it has no values.

    The columns are written out once. A sketch then gives two cut points that
    enclose the median for certain, which come to the driver as two numbers per
    column; a second pass counts the values below the cuts and
    each value between them. Those are at most a share of ``6 / _ACCURACY`` of all
    values, or ``4 * _ACCURACY`` values in all.
    """
    rows = stage_table(df.select(*columns), "medians")
    near = [0.5 - 2 / _ACCURACY, 0.5 + 2 / _ACCURACY]
    measured = []
    for c in columns:
        measured += [F.count(c), F.min(c), F.max(c), F.percentile_approx(c, near, _ACCURACY)]
    found = iter(rows.agg(*[m.alias(f"_{i}") for i, m in enumerate(measured)]).first())
    below, medians = [], []
    for i, c in enumerate(columns):
        n, lo, hi, cuts = (next(found) for _ in range(4))
        if cuts is not None and n > 4 * _ACCURACY:
            lo, hi = cuts
        kind = df.schema[c].dataType
        lo, hi = F.lit(lo).cast(kind), F.lit(hi).cast(kind)
        value = F.col(c)
        # one key stands for all values below the cut
        part = F.struct(F.lit(i).alias("column"), F.when(value >= lo, value).cast("double").alias("v"))
        below.append(F.when(value <= hi, part))
        medians.append((c, max((n or 0) - 1, 0)))
    cells = (
        rows.select(F.explode(F.array_compact(F.array(*below))).alias("cell"))
        .groupBy("cell.column", "cell.v")
        .agg(F.count("*").alias("n"))
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("seen"),
            F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n")))).alias("inside"),
        )
    )

    def at(rank: int) -> Column:
        """The value whose last rank is the first one from ``rank`` on."""
        start = F.struct(F.col("seen").alias("seen"), F.lit(None).cast("double").alias("v"))

        def step(acc: Column, x: Column) -> Column:
            hit = acc["v"].isNull() & (acc["seen"] + x["n"] > rank)
            return F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(hit, x["v"]).otherwise(acc["v"]).alias("v"))

        return F.reduce("inside", start, step)["v"]

    return cells.agg(
        *[
            F.max(F.when(F.col("column") == i, at(last // 2) + 0.5 * (at((last + 1) // 2) - at(last // 2)))).alias(c)
            for i, (c, last) in enumerate(medians)
        ]
    )
