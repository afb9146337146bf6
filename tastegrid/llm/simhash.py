"""SimHash near-dedup by segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments; the vector of their bit counts embeds it so that the Manhattan
distance of two vectors is a lower bound of the Hamming distance. Segments are dealt into groups: within a
distance of 4, at least groups - 4 groups must have equal coordinates, so a grid with a cell for each choice of
groups - 4 groups and their coordinates brings every near pair together in a cell. There a range join under the
Manhattan distance keeps the pairs that can be near, and only those are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, id_text, materialize, prepare, release, row_numbered, shuffle_partitions

SHINGLE, DISTANCE, SEGMENTS = 4, 4, 32
#: Shingles whose bits are unpacked together.
BLOCK = 1 << 14
#: Rows of the grid expected in one task.
TASK_ROWS = 500_000
#: Fingerprints expected in one cell of the grid; more groups make finer cells.
CELL_ROWS, MOST_GROUPS = 256, 10
#: Places that the pairs of one node are spread over.
SALTS = 64


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    words = (raw or b"").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, 42)
    starts = np.append(0, ends[:-shingle] + 1).tolist()
    stops = ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    n = len(starts)
    for a in range(0, n, BLOCK):
        h = np.fromiter([digest(text[s:e], 42) for s, e in zip(starts[a : a + BLOCK], stops[a : a + BLOCK], strict=True)], dtype="<u8", count=min(BLOCK, n - a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: str = "doc_id long") -> DataFrame:
    """`keys` of `docs` and fp: fingerprints of its text as signed 64-bit numbers."""
    names = [x.split()[0] for x in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray([fingerprint(x) for x in column_bytes(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(fp)], [*names, "fp"])

    return docs.mapInArrow(run, f"{keys}, fp long")


def popcounts(fp: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The embedding: bits set in each segment."""
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(fp), segments, -1).sum(axis=2, dtype=np.uint8)


_LOW = np.uint64(0x5555555555555555)


def thermometer(fp: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments in unary (any bit set, both set): differing bits are the Manhattan distance."""
    both, any_ = fp & (fp >> np.uint64(1)) & _LOW, (fp | fp >> np.uint64(1)) & _LOW
    return both << np.uint64(1) | any_


def grid_groups(nodes: int, distance: int = DISTANCE) -> int:
    """Groups for so many fingerprints: the fewest that leave about CELL_ROWS in a cell. A count has 1.5 bits of entropy.

    Any number of groups finds every near pair; it only trades the number of cells against their size.
    """
    for groups in range(distance + 2, MOST_GROUPS):
        if nodes <= CELL_ROWS * 2 ** (1.5 * SEGMENTS * (groups - distance) / groups):
            return groups
    return MOST_GROUPS


def grid_cells(fp: np.ndarray, groups: int, distance: int = DISTANCE) -> np.ndarray:
    """The cells of each fingerprint, one for each choice of groups - distance groups."""
    v = popcounts(fp)
    codes, base = [], 64 // SEGMENTS + 1
    for part in np.array_split(np.arange(SEGMENTS), groups):
        code = np.zeros(len(fp), dtype=np.int64)
        for j in part:
            code = code * base + v[:, j]
        codes.append((code, base ** len(part)))
    out = []
    for k, chosen in enumerate(combinations(range(groups), groups - distance)):
        cell = np.zeros(len(fp), dtype=np.int64)
        for g in chosen:
            cell = cell * codes[g][1] + codes[g][0]
        out.append(cell * 256 + k)
    return np.stack(out, axis=1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, given edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label] != label).any():
            label[jumped] = label[label[jumped]]
        if (label == before).all():
            return label


def cell_links(cell: np.ndarray, fp: np.ndarray, distance: int = DISTANCE, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is connected within a cell; rows are sorted by cell.

    Pairs within `distance` by Manhattan distance, the lower bound, are verified exactly. Small cells compare all pairs, shift by shift. In a large cell each fingerprint reached is compared only
    with those not reached yet, so a dense group gives a tree and not all of its pairs.
    """
    a, b, unary = [], [], thermometer(fp)
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(start, len(cell)))
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
    shift = 1
    while len(rows):
        rows = rows[rows + shift < len(cell)]
        rows = rows[cell[rows] == cell[rows + shift]]
        near = rows[np.bitwise_count(unary[rows] ^ unary[rows + shift]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= distance]
        a.append(near)
        b.append(near + shift)
        shift += 1
    for s, n in zip(start[size > small].tolist(), size[size > small].tolist(), strict=True):
        rest = np.arange(s, s + n)
        frontier: list[int] = []
        while len(rest):
            if not frontier:
                frontier, rest = [int(rest[0])], rest[1:]
            at = frontier.pop()
            near = np.flatnonzero(np.bitwise_count(unary[rest] ^ unary[at]) <= distance)
            near = near[np.bitwise_count(fp[rest[near]] ^ fp[at]) <= distance]
            if len(near):
                new = rest[near]
                a.append(np.full(len(new), at))
                b.append(new)
                frontier += new.tolist()
                rest = np.delete(rest, near)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64),) * 2


def near_links(nodes: DataFrame, groups: int | None = None, distance: int = DISTANCE) -> DataFrame:
    """(a, b) with a > b: a forest over `nodes` (node, fp: distinct fingerprints) of each task's near pairs."""
    spark, many = nodes.sparkSession, nodes.count()
    groups = groups or grid_groups(many, distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = x.column(1).to_numpy()
            cell = grid_cells(fp.view(np.uint64), groups, distance)
            k = cell.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(np.repeat(x.column(0).to_numpy(), k)), pa.array(np.repeat(fp, k))], ["cell", "node", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in x.columns] for x in batches if x.num_rows]
        if not held:
            return
        cell, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(cell, kind="stable")
        a, b = cell_links(cell[order], fp[order].view(np.uint64), distance)
        names, both = np.unique(np.stack([node[order[a]], node[order[b]]]), return_inverse=True)
        both = both.reshape(2, -1)
        root = _roots(len(names), both[0], both[1]) if len(names) else both[0]
        other = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[root[other]])], ["a", "b"])

    n = max(shuffle_partitions(spark), many * len(list(combinations(range(groups), distance))) // TASK_ROWS)
    return nodes.select("node", "fp").mapInArrow(spread, "cell long, node long, fp long").repartition(n, "cell").mapInArrow(verify, "a long, b long")


def with_least(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b and what else they hold) with m, the least b of each a.

    Pairs of one a are dealt by a salt of their b: minima are taken a salt, then over salts, and joined back a salt,
    so an a with very many pairs is spread over SALTS places, and only its SALTS minima meet in one.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("a", "salt").agg(F.min("b").alias("low"))
    least = part.groupBy("a").agg(F.min("low").alias("m"))
    # Merged, since each of the many small tables that rounds would otherwise broadcast is held by the driver for a while.
    low = part.select("a", "salt").join(least.hint("merge"), "a")
    return salted.join(low.hint("merge"), ["a", "salt"]).select(*pairs.columns, "m")


def stars(links: DataFrame) -> bool:
    """Whether each a has one link (a, b) only and no b is an a, so that another round would change nothing."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return by_node.where("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, itself left out; alternating large and small stars."""
    links = materialize(links.distinct(), "links")
    while True:  # stars settle after a number of rounds that grows with the logarithm of the nodes
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        pairs = F.array(*[F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("a", "b")])
        before, links = links, materialize(with_least(large).select(F.inline(pairs)).where("a > b").distinct(), "links")
        release(before)
        if stars(links):
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def least_of_groups(nodes: DataFrame, groups: int | None = None, distance: int = DISTANCE) -> DataFrame:
    """(its_fp, least): for each of `nodes` (fp, first: its own least), the least `first` of the nodes it reaches."""
    # A node is named by its fingerprint, which no two nodes share.
    linked = components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), groups, distance))
    linked = linked.unionAll(linked.select(F.col("root").alias("node"), "root").distinct())
    firsts = linked.join(nodes, linked.node == nodes.fp).select(F.col("root").alias("a"), F.col("first").alias("b"), "node")
    low = with_least(firsts).select("node", "m")
    of = nodes.join(low, nodes.fp == low.node, "left").select(F.col("fp").alias("its_fp"), F.coalesce("m", "first").alias("least"))
    # Read from a table, so that AQE can split a fingerprint with very many copies in the last join.
    return materialize(of, "components")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """One row of `df` for each group of near-duplicate rows: that of the least id, rows without an id last; of equal ids
    one. Rows that repeat an id or have none are linked like others."""
    prepare(df.sparkSession)
    rows = row_numbered(df.toDF(*[f"own_{c}" for c in df.columns]), "row")
    text, own_id = F.col(f"own_{text_col}").cast("string"), F.col(f"own_{id_col}").cast("long")
    found = fingerprints(rows.select("row", text.alias("text"), own_id.alias("id")), "row long, id long")
    found = materialize(found, "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")), "nodes")
    of = least_of_groups(nodes, groups, distance)
    dropped = found.join(of, found.fp == of.its_fp).where(F.col("row") != F.col("least.row")).select(F.col("row").alias("dropped"))
    kept = rows.join(dropped, rows["row"] == dropped["dropped"], "left_anti")
    return kept.select(*[F.col(f"own_{c}").alias(c) for c in df.columns])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Fingerprints link at `distance` or fewer differing bits; equal ones are one node, so copies are never paired.
    A null or empty text has fingerprint zero, linked like any other. A row without an id has a fingerprint and
    a null component_id, and links nothing. Rows that repeat an id are judged alike. An empty table gives no rows;
    other columns are ignored. `groups` follows the number of different fingerprints, so that cells stay small; it doesn't change results.
    """
    prepare(df.sparkSession)
    found = materialize(fingerprints(id_text(df, id_col, text_col)), "fingerprints")
    nodes = materialize(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    of = least_of_groups(nodes, groups, distance).withColumnRenamed("least", "component_id")
    joined = found.join(of, found.fp == of.its_fp, "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
