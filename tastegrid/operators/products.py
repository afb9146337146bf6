"""Products of a matrix's columns, which never leave the task that makes them.

Entries are written once and read by the tasks that need them, so what is shuffled and written doesn't grow with the ranges or blocks
there are. For all pairs of items, a task has the entries of one range of items and reads the ranges, one after the other,
that a user of its own has as well. Where only some pairs are asked for, a task has the entries of some users and reads what is asked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .blocks import batches_of, laid, sized

#: Entries of a range, ranges there are at least, and products that are worked on at a time.
RANGE_ROWS, RANGES, PRODUCTS = 4_000_000, 4, 1 << 20
#: Tasks there are at least, and bits of a mask of ranges.
TASKS, MASK = 32, 63
#: Entries of users that a task has at a time, bytes of files for a task, and tasks there are at least.
BLOCK_ROWS, BLOCK_BYTES, BLOCKS = 6_000_000, 64 << 20, 32
#: Items a user asks for that are taken at a time, and users whose rows are.
ROW_ASKED, ASKERS = 1000, 20_000

Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def item_ranges(matrix: DataFrame) -> list[int]:
    """Last items of ranges with about equally many entries, the last range without one."""
    n = max(RANGES, -(-matrix.count() // RANGE_ROWS))
    ends = [k / n for k in range(1, n)]
    return sorted({int(x) for x in matrix.approxQuantile("item_idx", ends, 0.1 / n)}) if ends else []


def range_of(item, ends: list[int]):
    return F.size(F.filter(F.lit(ends).cast("array<int>"), lambda x: x < item)) if ends else F.lit(0)


def by_ranges(matrix: DataFrame, norms: DataFrame, ends: list[int]) -> DataFrame:
    """(low, high, user_idx, item_idx, x): entries divided by their item's norm; both low and high are the range that one lies in."""
    unit = F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(0.0).alias("x")
    own = range_of(F.col("item_idx"), ends)
    return matrix.join(norms, "item_idx").select(own.alias("low"), own.alias("high"), "user_idx", "item_idx", unit)


def met_ranges(matrix: DataFrame, ends: list[int]) -> dict[int, list[int]]:
    """For each range the ranges, itself included, of which its users have an item."""
    sets = matrix.groupBy("user_idx").agg(F.collect_set(range_of(F.col("item_idx"), ends)).alias("ranges"))

    def mask(word: int) -> Column:
        mine = F.filter("ranges", lambda x: F.floor(x / MASK) == word)
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x % MASK).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x))).alias(f"m{word}")

    masks = [mask(word) for word in range(len(ends) // MASK + 1)]
    rows = sets.select("ranges", *masks).select(F.explode("ranges").alias("range"), *[f"m{w}" for w in range(len(masks))])
    found = rows.groupBy("range").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(len(masks))]).collect()  # a row a range
    return {r["range"]: [k for k in range(len(ends) + 1) if r[f"m{k // MASK}"] >> (k % MASK) & 1] for r in found}


def runs_of(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, how often) of each wanted number in `held`, which rises; looked up in a table if that isn't much longer than `held`."""
    last = int(held[-1]) if len(held) else -1
    if last > 4 * len(held) + (1 << 20) or last < 0 or held[0] < 0:
        first = np.searchsorted(held, wanted, "left")
        return first, np.searchsorted(held, wanted, "right") - first
    before = np.zeros(last + 3, dtype=np.int64)
    np.cumsum(np.bincount(held, minlength=last + 2), out=before[1:])
    own = np.where((wanted < 0) | (wanted > last), last + 1, wanted)
    first = before[own]
    return first, before[own + 1] - first


def sums(left: Side, right: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, sum) of x * y over the users that an item i of `left` and an item j of `right` share, the key being i << 32 | j.

    Keys rise and each comes once. PRODUCTS are multiplied at a time.
    """
    order, back = np.argsort(left[1], kind="stable"), np.argsort(right[0], kind="stable")
    (user, item, x), (ruser, ritem, y) = ([c[o] for c in side] for side, o in ((left, order), (right, back)))
    first, count = runs_of(ruser, user)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PRODUCTS, total, PRODUCTS), "right"), [0, len(user)]))
    kept = np.zeros(0, dtype=np.int64), np.zeros(0)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = count[a:b]
        at = np.repeat(np.arange(a, b), n)
        other = np.arange(len(at)) + np.repeat(first[a:b] - (np.cumsum(n) - n), n)
        key = item[at].astype(np.int64) << 32 | ritem[other]
        key, d = np.concatenate([kept[0], key]), np.concatenate([kept[1], x[at] * y[other]])
        if len(key):
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, d = key[starts], np.add.reduceat(d[order], starts)
        # The last item goes on in the next piece.
        cut = len(key) if b == len(user) or item[b] != item[b - 1] else int(np.searchsorted(key, int(item[b - 1]) << 32))
        kept = key[cut:], d[cut:]
        yield key[:cut], d[:cut]


def rounded(s: np.ndarray) -> np.ndarray:
    """To 10 places, halves away from 0."""
    return np.copysign(np.floor(np.abs(s) * 1e10 + 0.5) / 1e10, s)


def best_of(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: int) -> Side:
    """The n largest s of each i, ties to smaller j."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < n
    return i[top], j[top], s[top]


def _entries(paths: Sequence[str], part: int = 0, parts: int = 1, asked: bool = False) -> Side:
    """(user, item, x) of a range's files; only of the items of one of `parts`, and only of those asked for, if told so."""
    found = []
    for x in batches_of(paths, ("user_idx", "item_idx", "x", *["asked"] * asked)):
        columns = [x.column(k).to_numpy() for k in range(3)]
        keep = columns[1] % parts == part
        if asked:
            keep &= x.column(3).to_numpy(zero_copy_only=False)
        found.append(tuple(c[keep] for c in columns))
    kinds = np.int32, np.int32, np.float64
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=k) for k in kinds)


BEST = "i int, j int, s double"


def most_similar(entries: DataFrame, met: dict[int, list[int]], n: int) -> DataFrame:
    """(i, j, s): the n most similar items j of each item i, by cosine at 10 places, if positive; ties go to smaller j.
    `entries` is from `by_ranges`, with `asked`: whether their item is one to have neighbours for; `met` is from `met_ranges`.

    A task has a range's items, or a part of them where ranges are few, and keeps the best of each as it goes through the ranges met.
    """
    spark = entries.sparkSession
    ship_package(spark)
    placed = entries.select(F.col("low").alias("block"), "user_idx", "item_idx", "x", "asked").repartition("block").sortWithinPartitions("block", "user_idx")
    files = laid(placed, "ranges")
    parts = -(-TASKS // max(1, len(files)))
    todo = [(k, part) for k in sorted(files) for part in range(parts)]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in [pair for x in batches for pair in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]:
            left = _entries(files[own], part, parts, True)
            order = np.argsort(left[1], kind="stable")
            left = tuple(c[order] for c in left)
            kept, held = [], 0
            for other in met.get(own, ()) if len(left[0]) else ():
                right = _entries(files[other])
                for key, d in sums(left, right):
                    i, j, s = key >> 32, key & 0xFFFFFFFF, rounded(d)
                    some = (s > 0) & (i != j)
                    kept.append(best_of(i[some], j[some], s[some], n))
                    held += len(kept[-1][0])
                if held > 2 * PRODUCTS:
                    kept = [best_of(*map(np.concatenate, zip(*kept, strict=True)), n)]
                    held = 0
            if kept:
                i, j, s = best_of(*map(np.concatenate, zip(*kept, strict=True)), n)
                for a in range(0, len(i), 1 << 16):
                    b = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(i[b], pa.int32()), pa.array(j[b], pa.int32()), pa.array(s[b])], ["i", "j", "s"])

    return spark.createDataFrame(todo, "own int, part int").repartition(max(1, len(todo))).mapInArrow(best, BEST)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 ... of each span, one span after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def by_item_and_user(entries: Side) -> tuple[np.ndarray, ...]:
    """`entries` with their orders by item and by user, and what these are searched in."""
    user, item, v = entries
    by_item, by_user = np.argsort(item, kind="stable"), np.argsort(user, kind="stable")
    return user, item, v, by_item, item[by_item], user[by_user], item[by_user], v[by_user]


Asked = tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]
Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def asked_sums(asked: Asked, entries: Side, pieces: int | None = None) -> Found:
    """(row, i, j, sum) of v(i) * v(j) over the users of `entries` (user, item, v), where that isn't 0. `asked` is (item i,
    row it is from, (starts of the rows' items, their items j)); pairs are taken in pieces, by i."""
    for of, i, place, d in asked_places(asked, by_item_and_user(entries), pieces):
        yield of, i, asked[2][1][place], d


def asked_places(asked: Asked, ordered: tuple[np.ndarray, ...], pieces: int | None = None) -> Found:
    """(row, i, place of j among the rows' items, sum): the same of entries that are ordered already. Items without a rater are
    left out at once."""
    pieces = pieces or PRODUCTS
    want, row, (starts, items) = asked
    user, item, v, by_item, left, ruser, ritem, rv = ordered
    rated = left[np.minimum(np.searchsorted(left, want), len(left) - 1)] == want if len(left) else np.zeros(len(want), dtype=bool)
    want, row = want[rated], row[rated]
    order = np.argsort(want, kind="stable")
    want, row = want[order].astype(np.int64), row[order]
    count = starts[row + 1] - starts[row]
    ends = np.cumsum(count)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(pieces, int(ends[-1]) if len(ends) else 0, pieces), "right"), [0, len(want)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        place = spans(starts[row[a:b]], count[a:b])
        j = items[place].astype(np.int64)
        of, i = np.repeat(row[a:b], count[a:b]), np.repeat(want[a:b], count[a:b])
        keys, at = np.unique(i << 32 | j, return_inverse=True)
        own = np.unique(want[a:b])
        low = np.searchsorted(left, own, "left")
        mine = by_item[spans(low, np.searchsorted(left, own, "right") - low)]
        first, n = runs_of(ruser, user[mine])
        total = np.cumsum(n)
        parts = np.unique(np.append(np.searchsorted(total, np.arange(pieces, int(total[-1]) if len(total) else 0, pieces), "right"), [0, len(mine)]))
        d = np.zeros(len(keys))
        for c, e in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
            other, its = spans(first[c:e], n[c:e]), np.repeat(mine[c:e], n[c:e])
            key = item[its].astype(np.int64) << 32 | ritem[other]
            met = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            some = keys[met] == key if len(keys) else np.zeros(len(key), dtype=bool)
            d += np.bincount(met[some], weights=v[its[some]] * rv[other[some]], minlength=len(keys))
        found = (d[at] != 0) & (i != j)
        yield of[found], i[found], place[found], d[at][found]


def dots_of(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(user_idx, i, j, vj, d): for `pairs` (user_idx, i), the products of column i with each other column j that the user has in
    `matrix` (user_idx, item_idx, v: a row a pair), where they aren't 0; vj is what the user has there.

    A user's entries are written as one row, with what the user asks for. A task has the entries of some files' users, BLOCK_ROWS
    at a time, and reads all rows that ask for something; so only the sums that were found are shuffled, and `matrix` where its
    rows don't lie by user.
    """
    spark = matrix.sparkSession
    ship_package(spark)
    asks = pairs.groupBy("user_idx").agg(F.collect_list("i").alias("asks"))
    rows = matrix.groupBy("user_idx").agg(F.collect_list(F.struct("item_idx", "v")).alias("e")).join(asks, "user_idx", "left")
    rows = rows.select("user_idx", F.col("e.item_idx").alias("items"), F.col("e.v").alias("v"), "asks")
    files = sized(rows, "raters")
    groups: list[list[str]] = []
    for size, path in sorted(files, key=lambda x: x[1]):
        if not groups or held + size > BLOCK_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += size
    parts = -(-BLOCKS // max(1, len(groups)))
    todo = [(own, part) for own in groups for part in range(parts)]
    every, at_once, most, askers = [path for _, path in files], ROW_ASKED, BLOCK_ROWS, ASKERS

    def flat(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return x.value_lengths().fill_null(0).to_numpy().astype(np.int64), x.flatten().to_numpy()

    def held_entries(paths: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        found, many = [], 0
        for x in batches_of(paths, ("user_idx", "items", "v"), askers):
            size, item = flat(x.column(1))
            found.append((np.repeat(x.column(0).to_numpy(), size), item, flat(x.column(2))[1]))
            many += len(item)
            if many >= most:
                yield by_item_and_user(tuple(map(np.concatenate, zip(*found, strict=True))))
                found, many = [], 0
        if found:
            yield by_item_and_user(tuple(map(np.concatenate, zip(*found, strict=True))))

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in [pair for x in batches for pair in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]:
            for ordered in held_entries(own):
                for x in batches_of(every, ("user_idx", "items", "v", "asks"), askers):
                    users = x.column(0).to_numpy()
                    mine = pa.array((users % parts == part) & x.column(3).is_valid().to_numpy(zero_copy_only=False))
                    x = x.filter(mine)
                    users, (size, rated), (_, value), (many, asked) = x.column(0).to_numpy(), *(flat(x.column(k)) for k in (1, 2, 3))
                    row = np.repeat(np.arange(len(users)), many)
                    starts = np.append(0, np.cumsum(size))
                    for a in range(0, len(row), at_once * 1000):
                        b = slice(a, a + at_once * 1000)
                        for of, i, at, d in asked_places((asked[b], row[b], (starts, rated)), ordered):
                            columns = users[of], i.astype(np.int32), rated[at], value[at], d
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["user_idx", "i", "j", "vj", "d"])

    found = spark.createDataFrame(todo, "own array<string>, part int").repartition(max(1, len(todo))).mapInArrow(dots, "user_idx int, i int, j int, vj double, d double")
    return found.groupBy("user_idx", "i", "j").agg(F.first("vj").alias("vj"), F.sum("d").alias("d"))
