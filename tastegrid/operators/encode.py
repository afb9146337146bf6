"""Dense numbering of rows and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def number_rows(df: DataFrame, keys: list, name: str, start: int = 0) -> DataFrame:
    """`df` with a gapless number in the order of `keys`, as LONG; one way for any size.

    Rows are range-sorted and written, so that their order stays; a row's number is its place in its partition and
    the rows of the partitions before, of which the driver gets a count a partition. Rows equal in all `keys` are dealt
    over partitions by a last key of their own, so they are never more than their share in one task. Rows that a source
    has in the order of `pos` (`in_order`) are numbered as they are read.
    """
    if keys == ["pos"] and getattr(df, "in_order", False):
        return _numbered(df.withColumn("_at", F.monotonically_increasing_id()), name, start)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    order = [*keys, "_tie"]
    placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    return _numbered(stored(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered"), name, start)


def _numbered(placed: DataFrame, name: str, start: int) -> DataFrame:
    """`name` in place of `_at`, the partition and the place there of rows that lie in order."""
    part, row = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())  # a row a partition
    before, total = [], start
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.lit(before).cast("array<bigint>"), part + 1) if before else F.lit(start)
    return placed.withColumn(name, (offset + row).cast("long")).drop("_at")


def id_index(df: DataFrame, id_col: str, index_col: str) -> DataFrame:
    """(id, index): 0-based dense rank of the distinct ids, as INT."""
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return number_rows(ids, [id_col], index_col).withColumn(index_col, F.col(index_col).cast("int"))


def with_dense_index(df: DataFrame, id_col: str, index_col: str) -> DataFrame:
    return df.join(id_index(df, id_col, index_col), id_col)


def with_both_indexes(df: DataFrame) -> DataFrame:
    """Ratings with user_idx and item_idx, from rows that are made once and written: what they come from, a join or a file,
    isn't gone through again for each index. Users are joined last, so that rows lie by user afterwards."""
    rows = stored(df, "ratings")
    users, items = id_index(rows, "userId", "user_idx"), id_index(rows, "movieId", "item_idx")
    return rows.join(items, "movieId").join(users, "userId")
