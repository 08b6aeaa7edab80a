"""Assign events to mainshocks by distance and time."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.functions.clock import HOUR_US, SECOND_US
from tremorframe.functions.geo import arc_degrees
from tremorframe.session import stage_table

ARC_TOLERANCE = 1e-9  # degrees, a tenth of a millimetre: keeps the edge stable
CELL = ["tb", "latb", "lonb"]
QUARTER = [*CELL, "sy", "sx"]
# Cells are counted on this share of the events, chosen by hash.
SAMPLE = 16
MOST_HALVINGS = 6
# Parts of the time, its end, in which the newest events are looked for first.
PARTS = (1 / 4096, 1 / 512, 1 / 64, 1 / 8)


def _cells(radius_deg: float) -> tuple[int, float]:
    """Number and width of longitude cells: at least a radius wide, closing the circle."""
    if radius_deg <= 0 or radius_deg >= 90:
        raise ValueError("radius_deg must be between 0 and 90")
    n = max(1, int(360.0 // radius_deg))
    return n, 360.0 / n


def _by_density(events: DataFrame, main: DataFrame, rows_per_cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the quarter of their cell (``sy``, ``sx``) and its ``part``.

    A cell with more events than asked for is cut into quarters, halving both
    sides as often as its number wants; a mainshock then visits only the quarters its circle
    can touch. A quarter that is still too full, where events lie on one spot, is dealt
    into parts by event, and mainshocks visit all of them. Both are decided on
    a share of the events. Cells that are not dense cost nothing more.
    ``y`` and ``x`` are places within a cell, in cells.
    """
    counted = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(SAMPLE)) == 0)

    def dense(rows: DataFrame, keys: list[str]) -> DataFrame:
        n = rows.groupBy(*keys).agg((F.count("*") * SAMPLE).alias("n"))
        return n.filter(F.col("n") > rows_per_cell)

    halvings = F.least(F.ceil(F.log2(F.col("n") / rows_per_cell) / 2), F.lit(MOST_HALVINGS)).cast("int")
    full = stage_table(dense(counted, CELL).select(*CELL, F.pow(F.lit(2.0), halvings).alias("cuts")), "dense-cells")

    def with_cuts(rows: DataFrame) -> DataFrame:
        return rows.join(full, CELL, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1.0)))

    def slot(at: str) -> Column:
        return F.least(F.greatest(F.floor(F.col(at) * F.col("cuts")), F.lit(0)), F.col("cuts").cast("bigint") - 1)

    def quartered(rows: DataFrame) -> DataFrame:
        return with_cuts(rows).withColumns({"sy": slot("y"), "sx": slot("x")})

    crowded = quartered(counted).filter("cuts > 1")
    spots = stage_table(
        dense(crowded, QUARTER).select(*QUARTER, F.ceil(F.col("n") / rows_per_cell).cast("int").alias("parts")), "dense-spots"
    )

    def slots(at: str, reach: str) -> Column:
        last = F.col("cuts").cast("bigint") - 1
        low = F.floor((F.col(at) - F.col(reach)) * F.col("cuts") - 1e-6)
        high = F.floor((F.col(at) + F.col(reach)) * F.col("cuts") + 1e-6)
        low, high = F.least(F.greatest(low, F.lit(0)), last), F.least(F.greatest(high, F.lit(0)), last)
        return F.explode(F.sequence(low, high))

    parts = F.coalesce("parts", F.lit(1))
    events = quartered(events).join(spots, QUARTER, "left").withColumn("part", F.pmod(F.xxhash64("event_id", "t_us"), parts).cast("int"))
    main = with_cuts(main).withColumn("sy", slots("y", "y_reach")).withColumn("sx", slots("x", "x_reach"))
    main = main.join(spots, QUARTER, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return events.drop("y", "x", "cuts", "parts"), main.drop("y", "x", "y_reach", "x_reach", "cuts", "parts")


def _turned(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0))


def _in_cells(
    cat: DataFrame, ev: DataFrame, radius_deg: float, span_us: int, from_us: int, min_mag: float
) -> tuple[DataFrame, DataFrame, dict[str, Column]]:
    """Events with their cell, mainshocks once for every cell they can reach, and places of the latter."""
    n_lon, lon_width = _cells(radius_deg)
    reach = radius_deg + ARC_TOLERANCE * 10

    events = ev.filter(
        (F.col("mag") >= min_mag) & F.col("t_us").isNotNull()
    ).select(
        F.col("event_id"),
        "t_us", "lat", "lon", "depth", "mag", "mag_type",
        F.floor(F.col("t_us") / span_us).alias("tb"),
        F.floor(F.col("lat") / radius_deg).alias("latb"),
        F.least(F.floor(_turned(F.col("lon")) / lon_width), F.lit(n_lon - 1)).alias("lonb"),
    )
    # the circle starts at the second the id is made of
    start = (F.floor(F.col("t0_us") / float(SECOND_US)) * SECOND_US + from_us).alias("start_us")
    main = cat.select(
        "eq_id", F.col("mainshock_lat").alias("main_lat"), F.col("mainshock_lon").alias("main_lon"), start
    )
    lat, lon = F.col("main_lat"), _turned(F.col("main_lon"))
    # half width in longitude of a circle that stays clear of the poles
    half = F.degrees(
        F.asin(F.least(F.lit(math.sin(math.radians(reach))) / F.cos(F.radians(lat)), F.lit(1.0)))
    ) + F.lit(ARC_TOLERANCE * 10)
    polar = F.abs(lat) + reach >= 90.0
    first = F.when(polar, 0).otherwise(F.floor((lon - half) / lon_width))
    last = F.when(polar, n_lon - 1).otherwise(F.floor((lon + half) / lon_width))
    cells = F.array_distinct(
        F.transform(F.sequence(first, last), lambda i: F.pmod(i, F.lit(n_lon).cast("bigint")))
    )
    first_tb = F.floor(F.col("start_us") / span_us)
    bands = F.sequence(F.floor((lat - reach) / radius_deg), F.floor((lat + reach) / radius_deg))
    main = (
        main.withColumn("tb", F.explode(F.sequence(first_tb, first_tb + 1)))
        .withColumn("latb", F.explode(bands))
        .withColumn("lonb", F.explode(cells))
    )
    places = {
        "y": lat / radius_deg - F.col("latb"),
        "y_reach": F.lit(reach / radius_deg),
        # from the start of the cell, the short way round
        "x": F.pmod(lon / lon_width - F.col("lonb") + n_lon / 2, F.lit(float(n_lon))) - n_lon / 2,
        "x_reach": F.when(polar, F.lit(float(n_lon))).otherwise(half / lon_width),
    }
    return events, main, places


def candidate_pairs(
    cat: DataFrame,
    ev: DataFrame,
    radius_deg: float = 3.0,
    hours: float = 168.0,
    min_mag: float = 2.0,
    salt: int = 1,
    rows_per_cell: int | None = None,
    from_hours: float = 0.0,
) -> DataFrame:
    """All (mainshock, event) pairs in range, unlimited and unordered; ``from_hours``: none earlier than that.

    An equi join on (time bucket, latitude band, longitude cell): an event lies
    in one cell, a mainshock is repeated for every cell its circle can touch,
    so each true pair meets exactly once and the exact test follows. Close to a
    pole the circle spans all longitudes and the mainshock visits every cell.

    A mainshock in its cells is many rows, which Catalyst's estimate does not see: it
    would send all of them through the driver where the catalog itself is small
    on disk. So both sides are always dealt by cell and merged.

    Hot cells: AQE splits their join partition. ``salt`` above one splits every
    cell by event up front, repeating the mainshocks that often. With
    ``rows_per_cell`` the cells follow the density instead, see ``_by_density``: no
    cell then holds many more events than that, and the caller needs no salt.
    """
    from_us = int(from_hours * HOUR_US)
    span_us = int(hours * HOUR_US) - from_us
    n_lon, lon_width = _cells(radius_deg)
    events, main, places = _in_cells(cat, ev, radius_deg, span_us, from_us, min_mag)
    keys = CELL
    if rows_per_cell:
        events = events.withColumns(
            {"y": F.col("lat") / radius_deg - F.col("latb"), "x": _turned(F.col("lon")) / lon_width - F.col("lonb")}
        )
        main = main.withColumns(places)
        events, main = _by_density(events, main, rows_per_cell)
        keys = [*QUARTER, "part"]
    elif salt > 1:
        events = events.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salt)).cast("int"))
        main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys = [*CELL, "salt"]
    near = arc_degrees(F.col("main_lat"), F.col("main_lon"), F.col("lat"), F.col("lon"))
    since = F.col("t_us") - F.col("start_us")
    return (
        events.join(main.hint("merge"), keys)
        .filter((since >= 0) & (since <= span_us) & (near <= radius_deg + ARC_TOLERANCE))
        .select(
            "eq_id", "event_id", "t_us", "lat", "lon", "depth", "mag", "mag_type",
            near.alias("arc_deg"),
        )
    )


def newest(pairs: DataFrame, limit: int, parts: int = 64) -> DataFrame:
    """At most ``limit`` newest events per mainshock.

    Ranked twice: first inside ``parts`` hash shares of a sequence, so that a
    hot sequence is sorted by many tasks, then over the at most
    ``parts * limit`` survivors. Every event that belongs to the overall newest
    is among the newest of its share, so nothing is lost.
    """
    order = [F.col("t_us").desc(), F.col("event_id").desc()]
    share = Window.partitionBy("eq_id", "share").orderBy(*order)
    whole = Window.partitionBy("eq_id").orderBy(*order)
    return (
        pairs.withColumn("share", F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int"))
        .withColumn("rank", F.row_number().over(share))
        .filter(F.col("rank") <= limit)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= limit)
        .drop("share", "rank")
    )


def _with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A join on the sequence id, where no id equals no id."""
    ids = ids.withColumnRenamed("eq_id", "_id")
    return rows.join(ids, F.col("eq_id").eqNullSafe(F.col("_id")), how).drop("_id")


def newest_pairs(
    cat: DataFrame, ev: DataFrame, limit: int, radius_deg: float = 3.0, hours: float = 168.0, min_mag: float = 2.0, **cells
) -> DataFrame:
    """The ``limit`` newest events of each mainshock, without ranking all pairs.

    The events in the cells a mainshock reaches are no fewer than its pairs: where
    they do not exceed the limit nothing is ranked. The others look at the end of
    their time first, as short a part as should hold enough; where that has
    ``limit`` events, those are the newest. Only who is left over then looks at all
    of it, and only those who turn out to have more pairs than the limit are ranked.
    """
    where = dict(radius_deg=radius_deg, hours=hours, min_mag=min_mag, **cells)
    events, main, _ = _in_cells(cat, ev, radius_deg, int(hours * HOUR_US), 0, min_mag)
    per_cell = events.groupBy(*CELL).agg(F.count("*").alias("n"))
    most = main.select("eq_id", *CELL).hint("merge").join(per_cell, CELL).groupBy("eq_id").agg(F.sum("n").alias("most"))
    left = stage_table(_with_ids(cat, most, "inner"), "reached")
    highest = left.agg(F.max("most")).first()[0] or 0
    parts = [candidate_pairs(left.filter(F.col("most") <= limit), ev, **where)]
    left = left.filter(F.col("most") > limit)
    for share in PARTS:
        if highest * share < 2 * limit:
            continue
        hopeful = left.filter(F.col("most") * share >= 2 * limit)
        pairs = candidate_pairs(hopeful, ev, from_hours=hours * (1 - share), **where)
        found = stage_table(newest(pairs, limit), "newest")
        full = stage_table(found.groupBy("eq_id").count().filter(F.col("count") >= limit).select("eq_id"), "full")
        parts.append(_with_ids(found, full, "left_semi"))
        left = stage_table(_with_ids(left, full, "left_anti"), "left")
    if highest > limit:
        more = candidate_pairs(left, ev, **where).groupBy("eq_id").count().filter(F.col("count") > limit)
        more = stage_table(more.select("eq_id"), "more")
        parts.append(candidate_pairs(_with_ids(left, more, "left_anti"), ev, **where))
        parts.append(newest(candidate_pairs(_with_ids(left, more, "left_semi"), ev, **where), limit))
    return reduce(DataFrame.unionByName, parts)


def associate(
    cat: DataFrame,
    ev: DataFrame,
    radius_deg: float = 3.0,
    hours: float = 168.0,
    min_mag: float = 2.0,
    limit: int | None = None,
    salt: int = 1,
    rows_per_cell: int | None = None,
) -> DataFrame:
    """All events of each mainshock, or on request the ``limit`` newest ones."""
    if limit is None:
        return candidate_pairs(cat, ev, radius_deg, hours, min_mag, salt, rows_per_cell)
    return newest_pairs(cat, ev, limit, radius_deg, hours, min_mag, salt=salt, rows_per_cell=rows_per_cell)


def associated_counts(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """``eq_id, n_events``, after the limit if one is asked for, without ranking anything."""
    n = F.count("*")
    return pairs.groupBy("eq_id").agg(
        (n if limit is None else F.least(n, F.lit(limit).cast("bigint"))).alias("n_events")
    )
