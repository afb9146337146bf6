"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target of words and a schedule of weights over training time. The integral of the schedule is
the source's cumulative demand; inverting it at a document's place in its source gives the training time at which
the document is due, and documents are range-sorted by that time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, prepare, range_numbered, row_numbered, shuffle_partitions

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CEILING = 1.5, 2.0
#: Knots (time, weight) of the schedules that sources follow in turn; only the shape counts.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.75), (0.5, 1.5), (1.0, 0.75)))


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = SHARE, ceiling: float = CEILING) -> np.ndarray:
    """Shares of `share` times all sizes by weight; what exceeds `ceiling` times a size is reshared until none is above."""
    size, weight = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    most, out, open_ = ceiling * size, np.zeros(len(size)), size > 0
    left = share * size.sum()
    while open_.any():
        given = left * weight / weight[open_].sum()
        over = open_ & (given >= most)
        if not over.any():
            out[open_] = given[open_]
            break
        out[over] = most[over]
        left -= most[over].sum()
        open_ &= ~over
    return out


def demanded(knots: Sequence[tuple[float, float]], share: np.ndarray) -> np.ndarray:
    """The times at which the integral of a piecewise linear schedule reaches each share of its whole."""
    t, w = (np.asarray(x, dtype=float) for x in zip(*knots, strict=True))
    area = np.append(0.0, np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2))
    want = np.clip(share, 0.0, 1.0) * area[-1]
    k = np.clip(np.searchsorted(area, want, side="right") - 1, 0, len(t) - 2)
    slope, rest = (w[k + 1] - w[k]) / (t[k + 1] - t[k]), want - area[k]
    root = np.sqrt(np.maximum(w[k] ** 2 + 2 * slope * rest, 0.0))
    return np.clip(t[k] + 2 * rest / np.maximum(w[k] + root, 1e-300), t[k], t[k + 1])


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, schedules=SCHEDULES, whole: bool = False, tie_col: str | None = None) -> DataFrame:
    """One row per input row, range-sorted by first_time: doc_id, size, source_size, target, taken, copies, first_time, last_time.

    size counts words (null text: 0). Sources in order of code points, null last, take the weights and schedules
    in turn. Within its source a document has a place by a hash of its id; the mix reads the source from the start,
    again and again, until its target is met: `taken` counts a document's words with repeats, the last document
    reached in part. With `whole`, a document is taken in copies instead, the last one if half of it is within the
    target. first_time and last_time are the times in [0, 1) of its first and last copy (null if none is taken).
    Null ids are placed like others; repeated rows each count; an empty table gives no rows; other columns are
    ignored. A `tie_col` of long numbers orders rows of one id and size, and comes out as a last column, tie. The number of sources must suit the driver; nothing else is gathered there.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"), F.coalesce(F.regexp_count(df[text_col].cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), (df[tie_col].cast("long") if tie_col else F.lit(0).cast("long")).alias("tie"))
    rows = materialize(rows.withColumn("place", F.xxhash64(F.lit(17), "doc_id")), "sizes")
    whole_sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted((x for x in whole_sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in whole_sizes)
    weight = [weights[i % len(weights)] for i in range(len(names))]
    goal = targets([whole_sizes[x] for x in names], weight, share, ceiling)

    def number(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for x in batches:
            source, size = x.column(1).to_pylist(), x.column(2).to_numpy()
            before = np.zeros(len(source), dtype=np.int64)
            cuts = [0, *(i for i in range(1, len(source)) if source[i] != source[i - 1]), len(source)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if source[a] != last:
                    last, total = source[a], 0
                run = np.cumsum(size[a:b])
                before[a:b] = total + run - size[a:b]
                total += int(run[-1])
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(np.full(len(source), part, dtype=np.int32)), pa.array(before)], ["doc_id", "source", "size", "tie", "place", "part", "before"])

    placed = range_numbered(rows, shuffle_partitions(spark), ["source", "place", "doc_id", "size", "tie"], "doc_id long, source string, size long, tie long, place long, part int, before long", number)
    # Partitions are ranges, so their number plus that of the sources bounds these sums.
    offset: dict[tuple[int, str | None], int] = {}
    so_far: dict[str | None, int] = {}
    for part, source, size in placed.groupBy("part", "source").agg(F.sum("size")).orderBy("part").collect():
        offset[part, source] = so_far.get(source, 0)
        so_far[source] = offset[part, source] + size
    of = {x: (whole_sizes[x], float(goal[i]), schedules[i % len(schedules)]) for i, x in enumerate(names)}

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            source, part = x.column(1).to_pylist(), x.column(5).to_pylist()
            size, before = x.column(2).to_numpy(), x.column(6).to_numpy() + np.asarray([offset[k] for k in zip(part, source, strict=True)], dtype=np.int64)
            n = len(source)
            total = np.asarray([of[s][0] for s in source], dtype=np.int64)
            want = np.asarray([of[s][1] for s in source], dtype=float)
            words = np.rint(want).astype(np.int64)
            rounds = words // np.maximum(total, 1)
            rest = words - rounds * total
            more = (2 * (rest - before) >= size) & (rest > 0) & (size > 0) if whole else None
            part_taken = np.where(more, size, 0) if whole else np.clip(rest - before, 0, size)
            taken = rounds * size + part_taken
            copies = np.where(size > 0, rounds + (part_taken > 0), 0)
            first, last = np.zeros(n), np.zeros(n)
            for s in set(source):
                own = np.asarray([y == s for y in source])
                reach = max(of[s][1], 1.0)
                first[own] = demanded(of[s][2], before[own] / reach)
                last[own] = demanded(of[s][2], ((np.maximum(copies[own], 1) - 1) * total[own] + before[own]) / reach)
            none = copies == 0
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(size), pa.array(total), pa.array(want), pa.array(taken), pa.array(copies.astype(np.int32)), pa.array(first, mask=none), pa.array(last, mask=none), x.column(3)], ["doc_id", "size", "source_size", "target", "taken", "copies", "first_time", "last_time", "tie"])

    out = placed.mapInArrow(take, "doc_id long, size long, source_size long, target double, taken long, copies int, first_time double, last_time double, tie long")
    out = out if tie_col else out.drop("tie")
    n = shuffle_partitions(spark)
    return out.repartitionByRange(n, F.col("first_time").asc_nulls_last(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("first_time").asc_nulls_last(), F.xxhash64("doc_id"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents the mix takes, whole and in all their copies, range-sorted by training time; columns as in `df`.

    Documents without words are not taken. Each row has its own share of the mix, with a repeated id or none too.
    """
    own = row_numbered(df.toDF(*[f"own_{c}" for c in df.columns]), "row")
    found = mix(own, f"own_{id_col}", f"own_{text_col}", f"own_{source_col}", whole=True, tie_col="row", **options)
    taken = F.struct(F.col("copies").alias("n"), F.col("first_time").alias("first"), F.col("last_time").alias("last"))
    found = found.where("copies > 0").select(F.col("tie").alias("its_row"), taken.alias("mix"))
    joined = own.join(found, own["row"] == found["its_row"])
    step = "mix.first + (mix.last - mix.first) * (i - 1) / greatest(mix.n - 1, 1)"
    out = joined.withColumn("mix_time", F.explode(F.expr(f"transform(sequence(1, mix.n), i -> {step})")))
    keys = [F.col("mix_time"), F.xxhash64(f"own_{id_col}"), F.col("row")]
    out = out.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return out.select(*[F.col(f"own_{c}").alias(c) for c in df.columns])
