"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best fit. Pieces are range-sorted by falling length, which gives each a global rank, and taken in bands
of like length, longest first. A round range-sorts a band's waiting pieces together with the gaps of all open
sequences and sweeps them from large to small: a gap goes on a stack, a piece takes the top, its successor (the smallest
gap left that holds it); of pieces that want one gap the first by rank gets it. Such a sweep is a matching of brackets: each
partition matches its own, and what is left carries its depth, so that a window over equal depths matches it across
partitions. Then gaps shrink by what they took, and the round repeats. New sequences open only
for what the gaps can't hold, by a lower bound. The driver sees counts of a round's partitions, never pieces or gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, id_text, materialize, prepare, release, shuffle_partitions
from .tokens import default_path, encoded, ids_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: Pieces and gaps expected in one task of a sweep.
ROUND_ROWS = 500_000
#: Sequences opened after the first band have numbers from here on; ranks are below.
OPENED = 1 << 60


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((x, capacity) for x in range(first, n, capacity))]


def token_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str | None, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of each document's ids followed by `end_id`."""
    prepare(df.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ids_encoder(tokenizer or default_path()), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(encode, column_bytes(batch, "text")), strict=True):
                ids += end
                out += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(df, id_col, text_col).mapInArrow(pieces, PIECES)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high]: lengths of which one, two, three, or four to seven fit into a sequence, then lengths by quarters."""
    edges = [capacity // k for k in (1, 2, 3, 4, 8)]
    while edges[-1]:
        edges.append(edges[-1] // 4)
    return [(low, high) for high, low in pairwise(edges) if low < high]


def brackets(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth of each, matched gaps, their pieces) of gaps (1) and pieces (-1) in the order of the sweep.

    A gap steps up to its depth and a piece down from it, so at one depth they alternate, and a gap is matched by the
    next piece there. Depths go below zero where pieces find no gap.
    """
    after = np.cumsum(kind)
    depth = np.where(kind > 0, after, after + 1)
    order = np.argsort(depth, kind="stable")
    d, k = depth[order], kind[order]
    hit = np.flatnonzero((d[1:] == d[:-1]) & (k[:-1] > 0) & (k[1:] < 0))
    return depth, order[hit], order[hit + 1]


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's pieces, with the sequence of the gap each took, and the gaps that none took."""
    from pyspark import TaskContext

    held = [x for x in batches if x.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    kind, tie = table["kind"].to_numpy().astype(np.int64), table["tie"].to_numpy()
    depth, gap, piece = brackets(kind)
    sequence, kept = np.full(len(kind), -1), np.ones(len(kind), dtype=bool)
    sequence[piece], kept[gap] = tie[gap], False
    part = np.full(len(kind), TaskContext.get().partitionId(), dtype=np.int32)
    found = {"sequence_id": pa.array(sequence, mask=sequence < 0), "depth": pa.array(depth), "part": pa.array(part)}
    for name, column in found.items():
        table = table.append_column(name, column)
    yield from table.drop_columns(["value"]).filter(pa.array(kept)).combine_chunks().to_batches(max_chunksize=50_000)


def across(table: DataFrame, net: dict[int, int]) -> DataFrame:
    """What a sweep's partitions left, matched between them: rows of one depth alternate, at most two a partition."""
    spark, offsets, total = table.sparkSession, [], 0
    for part in sorted(net):
        offsets.append((part, total))
        total += net[part]
    shift = F.broadcast(spark.createDataFrame(offsets, "part int, shift long"))  # one row a partition
    left = table.where("sequence_id is null").drop("sequence_id").join(shift, "part")
    at = Window.partitionBy("level").orderBy("part", "kind")
    left = left.withColumn("level", F.col("depth") + F.col("shift"))
    took = F.when(F.lag("kind").over(at) == 1, F.lag("tie").over(at))
    return left.withColumn("sequence_id", took).where("kind = -1").select(*COLUMNS, "tie", "sequence_id")


def slots(gaps: DataFrame, high: int, share: int) -> DataFrame:
    """Places for pieces of up to `high` in each gap, at most `share` a round: one with what is over, the others `high`."""
    many = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / high), F.lit(share))).cast("int")
    each = gaps.select("sequence_id", "gap", many.alias("many")).withColumn("nth", F.explode(F.sequence(F.lit(1), "many")))
    value = F.when(F.col("nth") == 1, F.col("gap") - (F.col("many") - 1) * high).otherwise(F.lit(high)).cast("long")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in PIECES.split(", "))]
    return each.select(*nothing, F.col("sequence_id").alias("tie"), value.alias("value"), F.lit(1).alias("kind"))


def match(waiting: DataFrame, places: DataFrame, parts: int) -> tuple[list[DataFrame], DataFrame, tuple]:
    """One sweep: (tables of pieces placed, pieces left, (how many of these, the shortest, tokens in all))."""
    both = waiting.select(*COLUMNS, "tie", F.col("length").alias("value"), F.lit(-1).alias("kind")).unionAll(places)
    keys = [F.col("value").desc(), F.col("kind").desc(), F.col("tie")]
    schema = f"{PIECES}, tie long, kind int, sequence_id long, depth long, part int"
    ordered = both.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    table = materialize(ordered.mapInArrow(swept, schema), "sweep")
    # At most three rows a partition.
    taken = F.col("sequence_id").isNotNull().alias("taken")
    amounts = [F.count("*").alias("n"), F.min("length").alias("shortest"), F.sum("length").alias("tokens")]
    state = table.groupBy("part", "kind", taken).agg(*amounts).collect()
    left = [x for x in state if x.kind == -1 and not x.taken]
    placed, rest = [table.where("sequence_id is not null")], table.where("sequence_id is null and kind = -1")
    free = [x.part for x in state if x.kind == 1]
    if free and any(x.part > min(free) for x in left):
        net = dict.fromkeys((x.part for x in state), 0)
        for x in state:
            net[x.part] += 0 if x.taken else x.kind * x.n
        late = materialize(across(table, net), "sweep")
        placed.append(late.where("sequence_id is not null"))
        rest = late.where("sequence_id is null")
        n, shortest, tokens = rest.agg(*amounts).first()
    else:
        n, shortest, tokens = sum(x.n for x in left), min((x.shortest for x in left), default=0), sum(x.tokens for x in left)
    return [x.select(*COLUMNS, "tie", "sequence_id") for x in placed], rest.select(*COLUMNS, "tie"), (n, shortest, tokens)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; lengths from 1 to `capacity`."""
    spark = pieces.sparkSession
    unsorted = materialize(pieces, "pieces")
    keys = [F.col("length").desc(), F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("doc_id"), F.col("piece")]
    ranked = unsorted.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    ranked = materialize(ranked.withColumn("tie", F.monotonically_increasing_id()), "ranked")
    release(unsorted)
    counts = dict(ranked.groupBy("length").count().collect())  # at most one row a length
    # No two pieces over half the capacity share a sequence.
    half = capacity // 2
    alone = ranked.where((F.col("length") > half) & (F.col("length") < capacity))
    placed = [alone.withColumn("sequence_id", F.col("tie"))]
    gaps = alone.select(F.col("tie").alias("sequence_id"), (F.lit(capacity) - F.col("length")).alias("gap"))
    opened, last = 0, None
    for low, high in bands(capacity)[1:]:
        lengths = [x for x in counts if low < x <= high]
        left, shortest, tokens = sum(counts[x] for x in lengths), min(lengths, default=0), sum(x * counts[x] for x in lengths)
        waiting = ranked.where((F.col("length") > low) & (F.col("length") <= high))
        while left:
            room = gaps.where(F.col("gap") >= shortest)
            n, space = room.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0))).first()
            # No fewer sequences can hold what these gaps can't, by tokens or, where no gap holds a piece, by pieces.
            more = max(0, -(-(tokens - space) // capacity), 0 if n else -(-left // (capacity // (low + 1))))
            if more:
                new = spark.range(OPENED + opened, OPENED + opened + more).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
                gaps, room, opened, n = gaps.unionAll(new), room.unionAll(new), opened + more, n + more
            share = -(-2 * left // n)
            parts = -(-(left + n * min(share, max(1, capacity // high))) // ROUND_ROWS)
            found, waiting, (left, shortest, tokens) = match(waiting, slots(room, high, share), parts)
            placed += found
            for x in found:
                gaps = gaps.unionAll(x.select("sequence_id", (-F.col("length")).alias("gap")))
            gaps = materialize(gaps.groupBy("sequence_id").agg(F.sum("gap").alias("gap")).where("gap > 0"), "gaps")
            if last is not None:
                release(last)
            last = gaps
    together = placed[0]
    for x in placed[1:]:
        together = together.unionByName(x)
    earlier = Window.partitionBy("sequence_id").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    whole = ranked.where(F.col("length") == capacity).select(*COLUMNS, F.col("tie").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return together.select(*COLUMNS, "sequence_id", offset).unionAll(whole)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack whole documents into as few sequences of at most `capacity` tokens as best fit finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents longer than the
    capacity are cut, the first piece being the short one. A null or empty text is its end id alone; null ids
    stay null; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    Equal lengths are ordered by a hash, so reruns agree.
    """
    return pack(token_pieces(df, id_col, text_col, tokenizer, capacity, end_id), capacity)
