"""Keep exactly n rows of a file-backed table without sending them through one task.

``limit`` inside a plan gathers up to n rows of *every* partition into a single task. Here files are
counted in storage order, in growing batches, until they hold enough rows; the storage position of the
last row to keep is looked up in the file that holds the cut, and the table is filtered by that
position. Files behind the cut are neither counted nor read, since Spark drops files by their name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = "_file_path"
ROW = "_row_index"
# Spark's own columns for it; they need a scan of files below, and no join or aggregate between.
FILE_POSITION = (f"_metadata.file_path AS {FILE}", f"_metadata.row_index AS {ROW}")
# Files counted by the first job, and by any job.
FIRST_BATCH, LARGEST_BATCH = 4, 4096
# Files are counted in ranges of rows of this width, the range with the cut in ranges of the next, so no
# count has more than a few thousand ranges besides one per file.
WIDTHS = (1_000_000, 1_000, 1)


def cap_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows in storage order; all rows if there are not more.

    ``rows`` carries the storage position in the columns ``FILE`` and ``ROW``.
    """
    cut = _cut_range(rows, limit)
    if cut is None:
        return rows.drop(FILE, ROW)
    file, number, missing = cut
    first, end = number * WIDTHS[0], (number + 1) * WIDTHS[0]
    for width in WIDTHS[1:]:
        within = (F.col(FILE) == file) & (F.col(ROW) >= first) & (F.col(ROW) < end)
        counts = rows.where(within).groupBy(_part(width)).agg(F.count(F.lit(1)).alias("n"))
        for number, n in sorted(map(tuple, counts.collect())):
            if n >= missing:
                break
            missing -= n
        first, end = number * width, (number + 1) * width
    kept = (F.col(FILE) < file) | ((F.col(FILE) == file) & (F.col(ROW) < end))
    return rows.where((F.col(FILE) <= file) & kept).drop(FILE, ROW)


def _part(width: int) -> Column:
    return F.floor(F.col(ROW) / F.lit(width)).alias("part")


def _cut_range(rows: DataFrame, limit: int) -> tuple[str, int, int] | None:
    """File and widest range in which the rows reach ``limit``, and how many of its rows it takes."""
    # The scan names files without a host as ``file:/x``, the list as ``file:///x``.
    files = sorted(re.sub("^([^:/]+):///", r"\1:/", name) for name in rows.inputFiles())
    at, size, missing = 0, FIRST_BATCH, limit
    while at < len(files):
        batch = files[at : at + size]
        counted = (
            rows.where((F.col(FILE) >= batch[0]) & (F.col(FILE) <= batch[-1]))
            .groupBy(FILE, _part(WIDTHS[0]))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        for file, number, n in sorted(map(tuple, counted.collect())):
            if n >= missing:
                return file, number, missing
            missing -= n
        at, size = at + size, min(4 * size, LARGEST_BATCH)
    return None
