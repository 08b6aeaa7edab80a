"""CSV files whose columns are found by the header of each file.

A declared schema assigns columns by position, and a header read once is wrong
for the other files of a set. So the lines are looked through first, without
splitting them: for each file this gives its header line, and whether fields
span lines. If all files agree in both, and are not many, Spark's CSV reader scans
them with the columns declared in their order. Otherwise the lines are split, each
by the header of its file: one more scan, however many headers there are, and
without a list of the files of each. Only files whose fields span lines are scanned
by the CSV reader then, those with the same header at a time.

A file that cannot be read, or has data but no header, does not stop the others:
the survey has a row for it. Readers raise on such a file only where asked to.
The survey holds a row per file on the driver, as Spark's own list of files does.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorframe.sources.schemas import CORRUPT

# The CSV reader sets up a parser for each file, which takes longer than a small file's lines do.
MANY_FILES = 1_000
OK, EMPTY, UNREADABLE_FILE, NO_HEADER = "ok", "empty", "unreadable", "no header"
# How Spark names the file that a task could not read.
READ_ERROR = re.compile(r"Encountered error while reading file (\S.*?)\.\s")


@dataclass(frozen=True)
class CsvFile:
    """A file and how it is to be read: its column names, whether fields span lines, and how quotes are escaped.

    ``url`` is its path as Spark's metadata spells it.
    """

    path: str
    status: str
    names: tuple[str, ...] = ()
    spans: bool = False
    backslash: bool = False
    url: str = ""

    @property
    def group(self) -> tuple:
        return self.names, self.spans, self.backslash


def literal_path(path: str) -> str:
    """A path as a pattern that matches itself alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def plain_path(url: str) -> str:
    """The path behind an encoded one, which Spark spells in two ways for local files."""
    return re.sub("^file:///", "file:/", unquote(url))


def _names(line: str) -> tuple[str, ...]:
    return tuple(name.strip() for name in next(csv.reader([line.removeprefix("﻿")]), ()))


def _urls(lines: DataFrame) -> list[str]:
    """The files behind ``lines``, brought over as one text: a list would cost a call to the JVM for each."""
    text = lines.sparkSession._jvm.org.apache.hadoop.util.StringUtils.join("\n", lines._jdf.inputFiles())
    return text.split("\n") if text else []  # the paths are encoded


def _without(lines: DataFrame, urls: Sequence[str]) -> DataFrame:
    """``lines`` without those files, which are then not opened."""
    spelled = [*urls, *(re.sub("^file:///", "file:/", url) for url in urls)]
    return lines.filter(~F.col("_metadata.file_path").isin(spelled)) if urls else lines


def _looked_through(lines: DataFrame, required: Sequence[str]) -> list:
    """Per file and possible header line: lines that are not blank, and what their quotes look like."""
    value = F.col("value")
    maybe = F.lit(True)
    for name in required:
        maybe = maybe & value.contains(name)
    odd = (F.length(value) - F.length(F.replace(value, F.lit('"')))) % 2 == 1
    return (
        lines.filter(F.trim(value) != "")
        .groupBy(F.col("_metadata.file_path").alias("path"), F.when(maybe, value).alias("head"))
        .agg(
            F.max(F.when(value.contains('"'), odd).otherwise(False)).alias("spans"),
            F.max(value.contains('\\"')).alias("backslash"),
        )
        .collect()
    )


def survey(lines: DataFrame, required: Sequence[str]) -> list[CsvFile]:
    """Every file of ``lines``, what ``spark.read.text`` gives.

    A header is a line that holds all ``required`` names; a file with two
    different ones has none that holds for all its lines. Files are looked
    through once, and once more for each that breaks off a reading task.
    """
    urls = {plain_path(url): url for url in _urls(lines)}
    lost: set[str] = set()
    rows: list | None = None
    while rows is None and len(lost) < len(urls):
        try:
            rows = _looked_through(_without(lines, [urls[p] for p in sorted(lost)]), required)
        except (PySparkException, Py4JJavaError) as error:
            named = READ_ERROR.search(str(error))
            damaged = plain_path(named[1]) if named else None
            if damaged not in urls or damaged in lost:
                raise
            lost.add(damaged)
    found: dict[str, list] = {}
    for row in rows or []:
        found.setdefault(plain_path(row["path"]), []).append(row)

    def file(p: str) -> CsvFile:
        if p in lost:
            return CsvFile(p, UNREADABLE_FILE, url=urls[p])
        if p not in found:
            return CsvFile(p, EMPTY)
        heads = {_names(head) for head in {r["head"] for r in found[p] if r["head"] is not None}}
        heads = {names for names in heads if set(required) <= set(names)}
        if len(heads) != 1:
            return CsvFile(p, NO_HEADER)
        spans, backslash = (any(r[c] for r in found[p]) for c in ("spans", "backslash"))
        return CsvFile(p, OK, heads.pop(), spans, backslash, found[p][0]["path"])

    return [file(p) for p in sorted(urls)]


def _options(like: CsvFile) -> dict[str, str]:
    return {"columnNameOfCorruptRecord": CORRUPT, "escape": "\\" if like.backslash else '"'}


def _schema(like: CsvFile) -> str:
    return ", ".join(f"{f} string" for f in (*(f"_f{i}" for i in range(len(like.names))), CORRUPT))


def _places(like: CsvFile, wanted: Sequence[str]) -> list[int | None]:
    """Where each wanted column stands, the first if it stands twice."""
    return [like.names.index(name) if name in like.names else None for name in wanted]


def _columns(split: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """The wanted columns of ``fields``, found by ``places``; header lines are left out wherever they stand."""
    wanted = [*required, *optional]
    place = {name: F.get("places", F.lit(i)) for i, name in enumerate(wanted)}
    is_head = reduce(
        lambda a, b: a & b, [(place[n] == 0) | F.trim(F.get("fields", place[n])).eqNullSafe(n) for n in required]
    )
    blank = F.coalesce(F.trim(CORRUPT) == "", F.lit(False))
    return split.filter(~is_head & ~blank).select(
        *[F.nullif(F.get("fields", place[n]), F.lit("")).alias(n) for n in wanted], "source_file", CORRUPT
    )


def _scan(spark: SparkSession, paths: str | list[str], like: CsvFile, wanted: Sequence[str]) -> DataFrame:
    """``fields, places`` of files with the same header, by Spark's CSV reader."""
    raw = (
        spark.read.schema(_schema(like))
        .options(**_options(like))
        .option("multiLine", like.spans)
        # a line is damaged if it has another number of fields, also of those not asked for
        .option("columnPruning", False)
        .csv(paths)
    )
    return raw.select(
        F.array(*[f"_f{i}" for i in range(len(like.names))]).alias("fields"),
        F.lit(_places(like, wanted)).cast("array<int>").alias("places"),
        F.col("_metadata.file_path").alias("source_file"), CORRUPT,
    )


def _record(like: CsvFile) -> Column:
    """The line ``value`` as a list of one record; it is split once, however many of its fields are looked at."""
    fields = [f"_f{i}" for i in range(len(like.names))]
    return F.transform(
        F.array(F.from_csv("value", _schema(like), _options(like))),
        lambda r: F.struct(F.array(*[r.getField(f) for f in fields]).alias("fields"), r.getField(CORRUPT).alias(CORRUPT)),
    )


def _split(lines: DataFrame, groups: dict[tuple, list[CsvFile]], whole: bool, wanted: Sequence[str]) -> DataFrame:
    """``fields, places`` of the lines of all files of the groups, each line split by the header of its file.

    ``whole`` says that there is one group, and no other file with lines.

    Headers differ in length, and in where the columns stand: the first is an
    expression for each length, the second a column.
    """
    source = lines.filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("source_file"))
    likes = [group[0] for group in groups.values()]
    if whole:
        n, backslash = F.lit(len(likes[0].names)), F.lit(likes[0].backslash)
        places = F.lit(_places(likes[0], wanted)).cast("array<int>")
        told = source.select("*", n.alias("n"), backslash.alias("backslash"), places.alias("places"))
    else:
        files = [(f.url, len(f.names), f.backslash, _places(f, wanted)) for group in groups.values() for f in group]
        types = (pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.int32()))
        table = pa.table(
            [pa.array(column, kind) for column, kind in zip(zip(*files), types)], ["source_file", "n", "backslash", "places"]
        )
        told = source.join(lines.sparkSession.createDataFrame(table), "source_file")
    found = F.lit(None)
    for like in {(len(x.names), x.backslash): x for x in likes}.values():
        mine = (F.col("n") == len(like.names)) & (F.col("backslash") == like.backslash)
        found = F.when(mine, _record(like)).otherwise(found)
    return told.select("source_file", "places", F.inline(found))


def read_files(
    spark: SparkSession,
    path: str | list[str],
    lines: DataFrame,
    files: Sequence[CsvFile],
    required: Sequence[str],
    optional: Sequence[str],
) -> DataFrame:
    """The wanted columns of the files with a header as text, with ``source_file`` and ``_corrupt_record``.

    An optional column that a file lacks is null. ``_corrupt_record`` holds
    records whose number of fields is not the header's. ``files`` is the survey
    of ``lines``, the text of ``path``.
    """
    wanted = [*required, *optional]
    groups: dict[tuple, list[CsvFile]] = {}
    for file in files:
        if file.status == OK:
            groups.setdefault(file.group, []).append(file)
    if not groups:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*wanted, "source_file", CORRUPT)))
    whole = len(groups) == 1 and all(f.status in (OK, EMPTY) for f in files)
    if whole and len(files) <= MANY_FILES:
        return _columns(_scan(spark, path, next(iter(groups.values()))[0], wanted), required, optional)
    parts = [
        _scan(spark, path if whole else [literal_path(f.path) for f in group], group[0], wanted)
        for group in groups.values() if group[0].spans
    ]
    by_line = {key: group for key, group in groups.items() if not group[0].spans}
    if by_line:
        readable = _without(lines, [f.url for f in files if f.status == UNREADABLE_FILE])
        parts.append(_split(readable, by_line, whole, wanted))
    return reduce(DataFrame.unionByName, [_columns(part, required, optional) for part in parts])


def read_csv(spark: SparkSession, path: str | list[str], required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """As ``read_files``; a file that cannot be read, or has data and no header, is an error that names it."""
    lines = spark.read.text(path)
    files = survey(lines, required)
    for file in files:
        if file.status == UNREADABLE_FILE:
            raise ValueError(f"cannot read {file.path}")
        if file.status == NO_HEADER:
            raise ValueError(f"no header with {', '.join(required)} in {file.path}")
    return read_files(spark, path, lines, files, required, optional)


def number(name: str, kind: str = "double") -> Column:
    """A text column as a number, null where it is none."""
    value = F.trim(name).try_cast(kind)
    return F.when(~F.isnan(value), value) if kind == "double" else value


def unreadable(name: str) -> Column:
    """True where a number is given that cannot be read."""
    return F.coalesce((F.trim(name) != "") & number(name).isNull(), F.lit(False))
