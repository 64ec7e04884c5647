"""Preference CSV drop directories, aligned by the names in each file's header.

Always an explicit schema (no inference pass over the data). ``multiLine`` is needed because
cells hold line breaks; a multi-line CSV file is not split inside, which suits many small files
(one per generation run). Convert large single files to Parquet once.

Columns are found by name, whatever their order in a file: one narrow pass over the lines keeps, by a
partial aggregation of two numbers a file, a hash of each file's first line that is not blank. Files of one
layout (one sequence of names) are read by one scan with that layout's schema, and the scans are
united by name. A column that a file lacks is NULL in its rows; names are compared without case. Only
one header line a layout comes to the driver, and, where there are several layouts, the paths of the files.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from prefspark.plans.broadcast import small_side
from prefspark.session import scratch_path

PREFERENCE_SCHEMA = "prompt string, response_1 string, response_2 string"
# What the parser reports for an UNQUOTED empty field (our sink's NULL); a quoted "" stays ''. Made
# anew in every process, so that no cell of any file holds it.
UNQUOTED_EMPTY = f"\u0000{uuid.uuid4().hex}"

# FIXED VALUE: layout of the generator's drop directory: {constitution}/{context}_{run}.csv
REFERENCE_LAYOUT = r"/(\d+)/(\d+)_(\d+)\.csv$"

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | record number
_HASH_BITS = 63 - _LOCAL_BITS
Paths = str | Sequence[str]


# ------------------------------------------------------------------ headers

def file_lines(reader, paths: Paths) -> DataFrame:
    """(line, file_path, at): the lines of all files with the place of their block, from a reader or stream reader."""
    return reader.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
                                     F.col("_metadata.file_block_start").alias("at"))


def file_headers(lines: DataFrame) -> DataFrame:
    """(file_path, h1, h2): 60 bits of hash of each file's first line that is not blank.

    The place of a line in its task and a hash of the line are packed in one long, whose minimum is the first
    line's: hash aggregation of two longs a file, and no line is moved."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    mask = F.lit((1 << _HASH_BITS) - 1)

    def packed(seed: int) -> Column:
        return F.shiftleft("place", _HASH_BITS).bitwiseOR(F.xxhash64(F.lit(seed), "line").bitwiseAND(mask))
    first = (lines.withColumn("place", place).where((F.col("at") == 0) & (F.trim("line") != ""))
             .groupBy("file_path").agg(F.min(packed(1)).alias("h1"), F.min(packed(2)).alias("h2")))
    return first.select("file_path", F.col("h1").bitwiseAND(mask).alias("h1"), F.col("h2").bitwiseAND(mask).alias("h2"))


def literal_path(file_path: str) -> str:
    """A path that names the file of a scan's ``_metadata.file_path`` (an encoded URI) and no other."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file_path))


def header_names(line: str) -> list[str]:
    """The names in a header line; repeated ones get ``.1``, ``.2`` behind them."""
    names: list[str] = []
    for name in next(csv.reader([line.removeprefix("\ufeff")], strict=True)):
        plain, k = name, 0
        while name.lower() in (n.lower() for n in names):
            k += 1
            name = f"{plain}.{k}"
        names.append(name)
    return names


def layouts(spark: SparkSession, lines: DataFrame) -> list[tuple[list[str], list[str] | None]]:
    """(names, paths of the files) of each layout; no paths if all files have the same one. Files
    without a line have no layout."""
    path = scratch_path(spark, "headers")
    file_headers(lines).write.parquet(path)
    table = spark.read.parquet(path)
    found: dict[tuple[str, ...], list] = {}
    for row in table.groupBy("h1", "h2").agg(F.min("file_path").alias("example")).collect():
        line = (spark.read.text(literal_path(row["example"])).where(F.trim("value") != "").first())[0]
        try:
            names = header_names(line)
        except csv.Error as ex:
            raise ValueError(f"header of {row['example']} cannot be read: {ex}") from ex
        found.setdefault(tuple(names), []).append(row)
    if len(found) == 1:
        return [(list(names), None) for names in found]
    out = []
    for names, rows in found.items():
        same = reduce(Column.__or__, [(F.col("h1") == r["h1"]) & (F.col("h2") == r["h2"]) for r in rows])
        out.append((list(names), [r[0] for r in table.where(same).select("file_path").collect()]))
    return sorted(out)


# ------------------------------------------------------------------ readers

def _reader(spark: SparkSession, schema, null_token: str | None = None, header: bool = True,
            recursive: bool = False):
    r = (spark.read.schema(schema)
         .option("header", header).option("multiLine", True)
         .option("recursiveFileLookup", recursive)
         .option("quote", '"').option("escape", '"')
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt"))
    if null_token is not None:
        r = r.option("nullValue", null_token)
    return r


def _fields(schema: str) -> list[StructField]:
    return StructType.fromDDL(schema).fields


def _named(names: Sequence[str], fields: Sequence[StructField], additional: bool) -> tuple[StructType, list[Column]]:
    """The scan's schema for files of ``names``, and its columns: ``fields`` by name, then the others."""
    wanted = {f.name.lower(): f for f in fields}
    at = {n.lower(): k for k, n in enumerate(names)}
    scan = StructType([StructField(f"_c{k}", wanted[n.lower()].dataType if n.lower() in wanted else StringType())
                       for k, n in enumerate(names)])
    columns = [(F.col(f"_c{at[f.name.lower()]}") if f.name.lower() in at else F.lit(None).cast(f.dataType)).alias(f.name)
               for f in fields]
    if additional:
        columns += [F.col(f"_c{k}").alias(n) for k, n in enumerate(names) if n.lower() not in wanted]
    return scan, columns


def _read(spark: SparkSession, paths: Paths, schema: str, null_token: str | None, recursive: bool, additional: bool,
          found, marks: str = "", more: Sequence[Column] = ()) -> DataFrame:
    """One scan a layout, united by name. ``marks``: further columns that the parser fills; ``more``: columns made of
    those and of the file's metadata. Columns of ``key=value`` folders are kept."""
    scans = []
    for names, files in found or [([f.name for f in _fields(schema)], None)]:
        own, columns = _named(names, _fields(schema), additional)
        internal = [*own.fieldNames(), *[f.name for f in (_fields(marks) if marks else [])]]
        reader = _reader(spark, StructType([*own.fields, *(_fields(marks) if marks else [])]), null_token,
                         recursive=recursive)
        if files is not None and isinstance(paths, str) and not recursive:
            reader = reader.option("basePath", paths)
        rows = reader.csv(paths if files is None else [literal_path(f) for f in files])
        folders = [F.col(f"`{c}`") for c in rows.columns if c not in internal]
        scans.append(rows.select(*columns, *folders, *more))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def read_preferences(spark: SparkSession, path: Paths, schema: str = PREFERENCE_SCHEMA,
                     null_token: str | None = UNQUOTED_EMPTY, recursive: bool = False, additional: bool = False,
                     path_col: str | None = None) -> DataFrame:
    """Every CSV file of ``path`` united by column name (``key=value`` folders become columns; with
    ``recursive`` all files below ``path``, without partition columns).

    The columns of ``schema`` come first, NULL where a file lacks them; with ``additional`` the files' other columns
    follow as strings. ``path_col`` names a column for the file's path. A row with fewer fields than its
    file's header ends in NULLs; surplus fields are dropped (see ``read_preferences_tolerant``). A cell holding the
    words NA / null / None stays that text (unlike pandas). No file: no rows."""
    found = layouts(spark, file_lines(spark.read.option("recursiveFileLookup", recursive), path))
    more = [F.col("_metadata.file_path").alias(path_col)] if path_col else []
    return _read(spark, path, schema, null_token, recursive, additional, found, more=more)


# A regular row is one field short of the scan's schema with the two columns ``MARKS``: it fills ``_corrupt`` and
# leaves ``_extra`` NULL. One more field leaves ``_corrupt`` NULL, two more fill both.
MARKS = "_extra string, _corrupt string"


def _too_many() -> Column:
    return F.col("_corrupt").isNull() | F.col("_extra").isNotNull()


def read_marked(spark: SparkSession, paths: Paths, schema: str, null_token: str | None, recursive: bool,
                additional: bool, found) -> DataFrame:
    """Rows with ``_too_many`` (more fields than their file's header) and ``file_path``."""
    return _read(spark, paths, schema, null_token, recursive, additional, found, MARKS,
                 [_too_many().alias("_too_many"), F.col("_metadata.file_path").alias("file_path")])


def read_preferences_tolerant(spark: SparkSession, path: Paths, schema: str = PREFERENCE_SCHEMA,
                              null_token: str | None = UNQUOTED_EMPTY, header: bool = True,
                              recursive: bool = False, additional: bool = False):
    """Read all files; a file with any row holding more fields than its header is rejected
    as a whole (the reference's parser raises on such a file and skips it).

    Returns ``(good, bad)``; ``good`` has the columns of ``schema`` (with ``additional``, the files' others too) and
    ``file_path``, ``bad`` lists (file_path, bad_rows). Files without a header have the columns of ``schema``
    in that order.
    """
    fields = [f.name for f in _fields(schema)]
    if header:
        found = layouts(spark, file_lines(spark.read.option("recursiveFileLookup", recursive), path))
        flagged = read_marked(spark, path, schema, null_token, recursive, additional, found)
    else:
        raw = _reader(spark, f"{schema}, {MARKS}", null_token, False, recursive).csv(path)
        flagged = raw.select(*fields, _too_many().alias("_too_many"), F.col("_metadata.file_path").alias("file_path"))
    bad = flagged.where("_too_many").groupBy("file_path").agg(F.count(F.lit(1)).alias("bad_rows"))
    names = [c for c in flagged.columns if c not in ("_too_many", "file_path")] if additional else fields
    # the bad-file list has one row per file: broadcast it when small, else a shuffle anti join
    good = (flagged.join(small_side(bad.select("file_path"), reuse=True), "file_path", "left_anti")
                   .select(*[F.col(f"`{c}`") for c in names], "file_path"))
    return good, bad


def with_lineage(df: DataFrame, pattern: str = REFERENCE_LAYOUT, path_col: str = "file_path") -> DataFrame:
    """(constitution_id, context_id, run_id) from the file path ``{c}/{context}_{run}.csv``.

    Context ids in file names start at 1, runs at 0. Rows from other paths get NULL keys. The
    path is ``path_col`` when the frame carries it (``read_preferences(.., path_col=..)``, the tolerant reader's
    output), else the scan's ``_metadata.file_path``, which a union of several layouts no longer has.
    """
    path = F.col(path_col) if path_col in df.columns else F.col("_metadata.file_path")
    def part(i):
        v = F.regexp_extract(path, pattern, i)
        return F.when(v != "", v.cast("int"))
    return (df.withColumn("constitution_id", part(1)).withColumn("context_id", part(2))
              .withColumn("run_id", part(3)))
