"""Order and position of records in file scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE, BLOCK, STEP, TASK = "__file", "__block", "__step", "__task"

# A table of splits has numeric columns only, some 40 bytes a row: 100 TB in splits of
# 128 MB are 32 MB. Beyond this bound, at twenty times that, it is joined by a shuffle.
SPLIT_BYTES, MAX_BROADCAST_BYTES = 40, 640_000_000


def has_file_metadata(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
        return True
    except AnalysisException:
        return False


def with_position(df: DataFrame, name: str = "position", start: int = 1, per_file: bool = False) -> DataFrame:
    """Number the rows of a file scan in source order.

    One pass counts rows per file split, a second one numbers them: offset of the
    split plus running number within it. Nothing but the split counts is shuffled.
    ``df`` must be a file scan that no filter, sort or repartition has touched.
    """
    if not has_file_metadata(df):
        raise ValueError("Positions need a file scan; number other tables by a key of their own.")
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(STEP),
    )
    counts = placed.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("__rows"), F.min(STEP).alias("__first"))
    # A split is named by its task, which has few, and a hash of its file.
    key = [F.shiftright(STEP, 33).alias(TASK), F.xxhash64(FILE).alias(FILE), BLOCK]
    offsets = split_offsets(counts, "__rows", per_file)
    offsets = offsets.select(F.shiftright("__first", 33).alias(TASK), *key[1:], "__first", "__before")
    if may_broadcast(df):
        offsets = F.broadcast(offsets)
    position = F.col("__before") + F.col(STEP) - F.col("__first") + F.lit(start)
    return placed.select(*df.columns, STEP, *key).join(offsets, [TASK, FILE, BLOCK]).select(*df.columns, position.alias(name))


def split_offsets(counts: DataFrame, amount: str, per_file: bool) -> DataFrame:
    """Add ``__before``: total of ``amount`` over all earlier splits. The input
    has one row per file split, so it grows with bytes over split size only."""
    inside = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("__in_file", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    if per_file:
        return within.withColumnRenamed("__in_file", "__before")
    per = counts.groupBy(FILE).agg(F.sum(amount).alias("__file_rows"))
    across = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = per.select(FILE, F.coalesce(F.sum("__file_rows").over(across), F.lit(0)).alias("__files_before"))
    return within.join(files, FILE).select("*", (F.col("__files_before") + F.col("__in_file")).alias("__before"))


def split_bound(df: DataFrame) -> int:
    """Upper bound of the number of file splits of a scan, known without a job:
    a task reads one split of a large file, or the splits of several small ones."""
    return df.rdd.getNumPartitions() + len(df.inputFiles())


def may_broadcast(df: DataFrame) -> bool:
    return split_bound(df) * SPLIT_BYTES <= MAX_BROADCAST_BYTES


def row_count(df: DataFrame) -> int:
    return df.count()


def page(df: DataFrame, position: str, first: int, size: int) -> DataFrame:
    """``size`` rows from position ``first`` on."""
    return df.where(F.col(position).between(first, first + size - 1))


def read_page(df: DataFrame, first: int, size: int, name: str = "position", start: int = 1) -> DataFrame:
    """``size`` rows of a file scan from position ``first`` on, numbered as `with_position`
    numbers them.

    One pass counts the rows of every file. Only the files that hold the page, at most one
    for each of its rows, are then read again. ``df`` is a scan as for `with_position`.
    """
    file = F.col("_metadata.file_path")
    counts = df.select(file.alias(FILE)).groupBy(FILE).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holds = F.col("__before") + F.col("__rows") > first - start
    listed = counts.withColumn("__before", before).where(holds & (F.col("__before") < first - start + size)).orderBy(FILE).collect()
    if not listed:
        return with_position(df, name, start).where("false")
    part = df.where(file.isin([row[FILE] for row in listed]))
    return page(with_position(part, name, start + listed[0]["__before"]), name, first, size)


def range_size(total_bytes: int, rows_per_range: int = 1000, bytes_per_row: int = 100) -> int:
    """Rows per range bucket: 1000, growing with the file beyond about a million
    estimated rows, so that there are never more than about 1000 ranges."""
    rows = total_bytes // bytes_per_row
    if rows <= rows_per_range * rows_per_range:
        return rows_per_range
    ranges = -(-rows // rows_per_range)
    return -(-ranges // rows_per_range) * rows_per_range


def row_ranges(df: DataFrame, position: str, size: int, start: int = 0) -> DataFrame:
    """Consecutive row ranges: bucket, first and last position, rows in it."""
    bucket = F.floor((F.col(position) - start) / size)
    return df.groupBy(bucket.alias("bucket")).agg(
        F.min(position).alias("first_row"), F.max(position).alias("last_row"), F.count(F.lit(1)).alias("rows")
    )
