"""Files of one server: rolled-over event files and text logs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

# Digits of the largest 64-bit number, which a rollover number is.
MOST_DIGITS = 19
# A task writes about so many rows of a log, and puts the records of about so many lines together.
LOG_ROWS = 1 << 18
_SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
_NUMBERED = r"^(.*?)(?:_([0-9]{1,19}))?(\.[^.]*)?$"


def rollover_set(newest: str) -> str:
    """From the newest file's path, a pattern for the file without a number and all numbered ones.

    ``/x/log_12.trc`` gives the base file ``log.trc`` and ``log_<digits>.trc``. Only ``_`` and
    digits before the extension are a number: ``audit_log.trc`` stands for itself and its own
    rollovers. Characters that mean something in a pattern stand for themselves.
    """
    folder, slash, file = newest.rpartition("/")
    stem, dot, extension = file.rpartition(".")
    if not dot:
        stem, extension = file, ""
    base = re.sub(r"_[0-9]+$", "", stem)
    quoted, end = _literal(base), _literal(dot + extension)
    numbers = [f"{quoted}_{'[0-9]' * digits}{end}" for digits in range(1, MOST_DIGITS + 1)]
    return f"{_literal(folder)}{slash}{{{','.join([quoted + end, *numbers])}}}"


def _literal(text: str) -> str:
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", text)


def rollover_rows(
    spark: SparkSession, newest: str, fmt: str = "parquet", schema=None
) -> DataFrame:
    """All rows of the set that the newest file belongs to, with the file each one came from."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(rollover_set(newest)).withColumn(
        "source_file", F.col("_metadata.file_path")
    )


def rollover_number(name: Column) -> Column:
    """The number in a file's name; NULL for the file that has none yet."""
    return F.nullif(F.regexp_extract(name, _NUMBERED, 2), F.lit("")).cast("decimal(19,0)")


def newest_file(spark: SparkSession, folder: str) -> str | None:
    """The path of the file in ``folder`` that was changed last; of several, the highest number.

    Names and times come from a listing by Spark; no file is opened, and one row is returned.
    """
    files = spark.read.format("binaryFile").load(_literal(folder)).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.orderBy(F.desc("modificationTime"), F.desc_nulls_last(rollover_number(name)), "path").first()
    return None if found is None else found["path"]


def latest_rollover_rows(
    spark: SparkSession, folder: str, fmt: str = "parquet", schema=None
) -> DataFrame:
    """All rows of the newest file in ``folder`` and of the files that rolled over to it.

    The newest file gives the base name, the base name the set; other files in the folder are never
    opened. ``source_file`` is where a row came from and ``rollover`` that file's number.
    """
    newest = newest_file(spark, folder)
    if newest is None:
        raise ValueError(f"no files in {folder}")
    rows = rollover_rows(spark, newest, fmt, schema)
    return rows.withColumn("rollover", rollover_number(F.element_at(F.split("source_file", "/"), -1)))


def write_rollover(df: DataFrame, number: Column, folder: str, base: str, fmt: str = "parquet") -> None:
    """Write ``df`` as a set of rolled-over files: ``base.<fmt>`` for number 0 or NULL, then
    ``base_<number>.<fmt>``.

    Rows of one number are one file, as a server writes them. Executors write into a hidden folder
    beside the files; only names are changed afterwards.
    """
    spark = df.sparkSession
    staging = f"{folder}/_writing-{base}"
    numbered = df.withColumn("_number", F.coalesce(number.cast("bigint"), F.lit(0)))
    numbered.repartition("_number").write.partitionBy("_number").format(fmt).save(staging)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.listStatus(path(staging)):
        if not part.isDirectory():
            continue
        value = part.getPath().getName().partition("=")[2]
        name = f"{base}.{fmt}" if value == "0" else f"{base}_{value}.{fmt}"
        for file in files.listStatus(part.getPath()):
            if file.getPath().getName().startswith("part-"):
                files.rename(file.getPath(), path(f"{folder}/{name}"))
    files.delete(path(staging), True)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Text logs line by line, with the file each line came from."""
    return spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_file")
    )


@contextmanager
def _splits_of(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Reads inside are cut into splits of at most ``most`` bytes, if that is given."""
    usual = spark.conf.get(_SPLIT_BYTES)
    spark.conf.set(_SPLIT_BYTES, usual if most is None else str(most))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT_BYTES, usual)


def _tagged(lines: DataFrame, folders: list[str]) -> DataFrame:
    """Lines with their file and split; ids ascend by one from line to line of a split, which is
    read by one task from its start."""
    return lines.select(
        *folders,
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )


def _before(splits: DataFrame, counted: str, log: list[str]) -> DataFrame:
    """For each split its place ``_at`` among those of the files that share the columns ``log``, and
    the sum of ``counted`` over the splits before it, as ``_before``.

    Numbers in names may grow by a digit, so shorter names come first."""
    along = Window.partitionBy(*log).orderBy(F.length("source_file"), "source_file", "_split")
    earlier = F.sum(counted).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return splits.withColumn("_before", F.coalesce(earlier, F.lit(0))).withColumn("_at", F.row_number().over(along))


def numbered_log_lines(
    spark: SparkSession,
    path: str,
    term: str | None = None,
    *,
    ignore_case: bool = False,
    split_bytes: int | None = None,
    continued: bool = False,
) -> DataFrame:
    """Lines of text logs that contain ``term`` (all lines without one), with ``line_no`` from 0.

    A file of any size is read by many tasks, split after split. Each split counts its own lines and
    keeps the hits with their place in the split; that is one row per split, made in the task that
    reads it. The lines before a split are a prefix sum over a file's splits, added when the hits
    are spread out again. ``source_file`` names the file, other columns are those of its folders.
    An empty file has no lines; a file without the term counts but gives none. ``split_bytes`` is the
    largest split of this read, unless it is the session's. With ``continued`` the files of a folder
    are one log, in the order of their names' length and names, and lines are numbered through.
    """
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    text = F.lower("value") if ignore_case else F.col("value")
    wanted = F.lit(True) if term is None else text.contains(term.lower() if ignore_case else term)
    hit = F.when(wanted, F.struct("_id", F.col("value").alias("line")))
    per_split = _tagged(lines, folders).groupBy(*folders, "source_file", "_split").agg(
        F.count("*").alias("_lines"), F.min("_id").alias("_first"), F.collect_list(hit).alias("_hits")
    )
    with _splits_of(spark, split_bytes):
        splits = written(per_split)
    counts = splits.select(*folders, "source_file", "_split", "_lines")
    before = _before(counts, "_lines", folders if continued else ["source_file"]).select("source_file", "_split", "_before")
    found = splits.where(F.size("_hits") > 0).join(before, ["source_file", "_split"])
    return found.select(*folders, "source_file", "_before", "_first", F.explode("_hits").alias("_hit")).select(
        *folders,
        "source_file",
        (F.col("_before") + F.col("_hit._id") - F.col("_first")).alias("line_no"),
        F.col("_hit.line").alias("line"),
    )


def block_records(
    spark: SparkSession,
    path: str,
    begins: str,
    fields: Mapping[str, str],
    *,
    split_bytes: int | None = None,
    continued: bool = False,
) -> DataFrame:
    """The records of a command's printed output, a row each, from text files.

    A record begins with a line that matches ``begins`` and goes on to the next such line; lines
    before a file's first one belong to no record. ``fields`` maps names to patterns whose first
    group is the value, taken from the record's first line that matches (NULL if none does). ``record``
    numbers a file's records from 0, other columns are those of the file's folders. With ``continued``
    the files of a folder are one log, in the order of their names' length and names.

    A record may begin in one split and end in a later one. Every split tells how many records begin
    in it; the prefix sum of that stands as a first row before the split's lines, so the begins seen
    so far number each line's record, and head and tail meet under one number whatever the splits
    are. Lines that match nothing are left where they are read, values are cut out there. Tasks grow
    in number with the lines: none holds more than about ``LOG_ROWS`` of them, a split or a record.
    """
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    log = folders if continued else [*folders, "source_file"]
    names = [f"_value{i}" for i in range(len(fields))]
    values = [
        F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1)).alias(name)
        for name, pattern in zip(names, fields.values())
    ]
    marked = _tagged(lines, folders).select(
        *folders, "source_file", "_split", "_id", F.lit(None).cast("int").alias("_at"),
        F.col("value").rlike(begins).cast("bigint").alias("_begins"), *values,
    )
    with _splits_of(spark, split_bytes):
        marked = written(marked.where((F.col("_begins") == 1) | F.coalesce(F.lit(None).cast("string"), *names).isNotNull()))
    begun = marked.groupBy(*folders, "source_file", "_split").agg(F.sum("_begins").alias("_begun"))
    heads = _before(begun, "_begun", log).select(
        *folders, "source_file", "_split", F.lit(-1).alias("_id"), "_at", F.col("_before").alias("_begins"),
        *[F.lit(None).cast("string").alias(n) for n in names],
    )
    tasks = max(1, -(-marked.count() // LOG_ROWS))
    so_far = Window.partitionBy("source_file", "_split").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.unionByName(heads).repartition(tasks, "source_file", "_split").select(
        *log, *names, "_id", F.max("_at").over(so_far).alias("_at"), (F.sum("_begins").over(so_far) - 1).alias("record")
    )
    numbered = inside.where("_id >= 0 and record >= 0")
    place = F.struct("_at", "_id")
    first = [F.min_by(n, F.when(F.col(n).isNotNull(), place)).alias(field) for n, field in zip(names, fields)]
    return numbered.groupBy(*log, "record").agg(*first)


def write_logs(df: DataFrame, line: Column, order: list[Column], by: str, folder: str) -> None:
    """Write ``line`` of every row as text, a folder ``by=<value>`` each, lines in their order.

    A value's lines are one file up to about ``LOG_ROWS`` of all rows; beyond that they are cut along
    the order into files that continue each other in the order of their names, each written by a task
    of its own."""
    tasks = max(1, -(-df.count() // LOG_ROWS))
    placed = df.repartitionByRange(tasks, by, *order) if tasks > 1 else df.repartition(by)
    placed = placed.sortWithinPartitions(by, *order)
    placed.select(line.alias("value"), by).write.partitionBy(by).text(folder)
