"""Temporal, k-fold and per-user hold-out splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.textfiles import join_parts
from .encode import number_rows


def with_rank(df: DataFrame) -> DataFrame:
    """rank: how many of the user's rows come later; ties of time go by pos."""
    order = W.partitionBy("userId").orderBy(F.col("timestamp").desc(), F.col("pos").desc())
    return df.withColumn("rank", F.row_number().over(order) - 1)


def time_split(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test): each user's last row is in test, the one before in val."""
    ranked = with_rank(df)
    return ranked.where("rank >= 2"), ranked.where("rank = 1"), ranked.where("rank = 0")


def kfold(df: DataFrame, keys: list, k: int = 5, mode: str = "exact") -> DataFrame:
    """`df` with fold (1..k) and part (train or test): contiguous folds in the order of `keys`.

    The last fold's test part also has the rows that are left over. `exact` trains on the complement; `compat`
    takes, for folds before the last, the rows before the test part, the last (k - fold) * size rows and the rest
    once more, and for the last fold the first (k - 1) * size rows, so that rows may be left out or doubled.
    """
    if mode not in ("exact", "compat"):
        raise ValueError("mode is exact or compat")
    placed = number_rows(df, keys, "_n", start=1)
    total = df.count()
    size, rest = divmod(total, k)
    n = F.col("_n")
    parts = []
    for i in range(1, k + 1):
        test = n.between((i - 1) * size + 1, i * size)
        if i == k:
            test = test | (n > total - rest)  # behind the fold's own rows as they are behind it in the file
        takes = [(test, "test")]
        if mode == "exact":
            takes.append((~test, "train"))
        else:
            takes.append((n <= (i - 1) * size, "train"))
            if i < k:
                takes += [(n > total - (k - i) * size, "train"), (n > total - rest, "train")]
        for cond, part in takes:
            parts.append(F.when(cond, F.struct(F.lit(i).alias("fold"), F.lit(part).alias("part"))))
    rows = placed.withColumn("_in", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())))
    return rows.select("*", "_in.fold", "_in.part").drop("_in", "_n")


def write_folds(df: DataFrame, path: str) -> None:
    """Folds as files, partitioned by fold and part so that readers prune them."""
    df.write.partitionBy("fold", "part").parquet(path)


def allbut(df: DataFrame, keys: list, start: int, stop: int, max_test: int = 0) -> DataFrame:
    """`df` with part: test for each user's start-th to stop-th row in the order of `keys`, while fewer than
    `max_test` test rows came before (no limit if it is not positive); train otherwise."""
    if not 1 <= start <= stop:
        raise ValueError("1 <= start <= stop is needed")
    ordinal = F.row_number().over(W.partitionBy("userId").orderBy(*keys))
    placed = df.withColumn("_o", ordinal).withColumn("_test", F.col("_o").between(start, stop))
    if max_test > 0:
        chosen = number_rows(placed.where("_test"), keys, "_n").withColumn("_test", F.col("_n") < max_test).drop("_n")
        placed = placed.where("not _test").unionByName(chosen)
    return placed.withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop("_o", "_test")


def _fold_runs(total: int, k: int, mode: str) -> dict[str, list[tuple[int, int]]]:
    """The folds' files as runs of lines after one number, up to another, as `kfold` takes them."""
    size, rest = divmod(total, k)
    runs = {}
    for i in range(1, k + 1):
        runs[f"r{i}.test"] = [((i - 1) * size, i * size)] + [(total - rest, total)] * (i == k)
        train = [(0, (i - 1) * size)]
        if mode == "exact":
            train += [(i * size, total)] * (i < k)
        elif i < k:
            train += [(total - (k - i) * size, total), (total - rest, total)]
        runs[f"r{i}.train"] = train
    return runs


def split_files(lines: DataFrame, path: str, mode: str = "compat", k: int = 5) -> None:
    """Text files of the lines (pos, line) of a `::`-separated file: r1.train, r1.test .. rk.train, rk.test from `kfold`,
    and ra, rb .train and .test, which hold each user's first ten and next ten rows out.

    In mode `compat` they are, byte for byte, what the usual split script makes of the file. A user is what stands before
    the first separator.

    A fold's file is runs of the lines in order, so lines are written once for all folds, cut where a run begins or ends, and
    once for each of ra and rb.
    """
    if mode not in ("exact", "compat"):
        raise ValueError("mode is exact or compat")
    numbered = number_rows(lines, ["pos"], "n", start=1).select("n", "line")
    total = numbered.count()
    runs = _fold_runs(total, k, mode)
    cuts = sorted({x for own in runs.values() for run in own for x in run})
    pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
    names = {name: [p for low, high in own for p, (a, b) in enumerate(pieces) if low <= a and b <= high] for name, own in runs.items()}
    last = len(pieces)
    names |= {"ra.train": [last], "ra.test": [last + 1], "rb.train": [last + 2], "rb.test": [last + 3]}
    users = F.substring_index(F.decode("line", "ISO-8859-1"), "::", 1)
    nth = numbered.withColumn("nth", F.row_number().over(W.partitionBy(users).orderBy("n")))
    placed = nth.repartitionByRange("n")
    own = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda x: x < F.col("n"))) - 1
    held = [F.lit(first) + F.col("nth").between(start, start + 9).cast("int") for first, start in ((last, 1), (last + 2, 11))]
    files = placed.select("n", F.explode(F.array(own, *held)).alias("file"), F.col("line").cast("string").alias("value"))
    join_parts(files.where("value is not null").sortWithinPartitions("file", "n").select("file", "value"), path, names)
