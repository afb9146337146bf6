"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes by learned rotations; codes are split into substrings about as wide as the logarithm of the
number of rows, each of which is indexed. Codes within Hamming radius r agree within r // substrings bits in at least
one substring, so probing the buckets within that many bits of the query's own retrieves every code within r. What is
retrieved is reranked by floats. A sample says how far the codes of vectors of a given cosine may lie apart, so a
query's k-th score so far says which radius it needs: it is done once that radius has been probed, and is probed on to
that radius if not. The index lies in slices, buckets that share their leading bits; a query visits those slices that
can hold buckets within its reach, and takes from each no more than its k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prepare, shuffle_partitions

#: Bits of a code, and of a substring at least and at most; how far apart a substring is probed at first.
BITS, NARROWEST, WIDEST, PROBED = 128, 8, 32, 1
WORDS = BITS // 64
#: Bounds of the sample that trains the rotations and the radius, and the share of neighbours a radius has to cover.
SAMPLE, SAMPLE_QUERIES, COVER = 8192, 512, 0.985
#: Cosines of the sample's pairs are told apart in so many steps, each with so many pairs at least.
STEPS, STEP_PAIRS = 100, 200
#: Bytes of a slice of the index, and of all slices of a task, about; queries x entries that are compared at a time.
SLICE_BYTES, TASK_BYTES, BLOCK_CELLS = 8 << 20, 128 << 20, 2_000_000
#: A table of slices that need salts is broadcast up to so many rows (of 16 bytes); beyond, it is joined by a shuffle.
SALT_ROWS = 100_000


def learn(x: np.ndarray, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotations): principal axes turned so that signs lose least (iterative quantisation), until BITS are there."""
    mean = x.mean(axis=0)
    centred = x - mean
    dim = x.shape[1]
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(BITS, dim)]  # of the dimension's size, not the sample's
    projected, turns = centred @ axes, []
    for k in range(-(-BITS // axes.shape[1])):
        turn = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = v.T @ u.T
        turns.append(axes @ turn)
    return mean, np.hstack(turns)[:, :BITS]


def codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Rows of WORDS 64-bit words."""
    return np.packbits((x - mean) @ rotation > 0, axis=1, bitorder="little").view("<u8").reshape(-1, WORDS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for equal rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, with broadcasting over all but the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


class Radii(NamedTuple):
    """Hamming radii that cover COVER of the vectors of at least a given cosine; `usual` covers a row's own neighbours."""

    steps: np.ndarray  # by cosine from -1 to 1
    usual: int

    def needed(self, score: np.ndarray) -> np.ndarray:
        at = np.clip(np.floor((np.asarray(score) + 1) / 2 * STEPS), 0, STEPS - 1).astype(np.int64)
        return self.steps[at]


def learn_radii(x: np.ndarray, code: np.ndarray, k: int) -> Radii:
    n = min(SAMPLE_QUERIES, len(x))
    near, distance = x[:n] @ x.T, apart(code[:n, None], code[None])
    step = np.clip(np.floor((near + 1) / 2 * STEPS), 0, STEPS - 1).astype(np.int64)
    own = np.arange(n)
    step[own, own] = -1
    lowest = (np.arange(STEPS) + 0.0) / STEPS * 2 - 1
    share = np.arccos(np.clip(lowest, -1, 1)) / np.pi  # of bits that differ, as random planes have it
    radii = np.minimum(BITS, np.ceil(share * BITS + 3 * np.sqrt(BITS * share * (1 - share))))
    found = np.zeros(0, dtype=distance.dtype)
    for s in range(STEPS):
        here = distance[step == s]
        # A step of few pairs takes in those of the steps below, whose codes lie further apart.
        found = here if len(here) >= STEP_PAIRS else np.append(here, found[: STEP_PAIRS - len(here)])
        if len(found) >= STEP_PAIRS:
            covers = np.quantile(found, COVER, method="higher")
            radii[s] = covers if len(here) >= STEP_PAIRS else min(radii[s], covers)
    radii = np.maximum.accumulate(radii[::-1])[::-1].astype(np.int64)  # what is less near is further apart
    near[own, own] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return Radii(radii, BITS)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return Radii(radii, int(np.quantile(np.take_along_axis(distance, best, 1), COVER, method="higher")))


def balls(bits: int, r: int) -> np.ndarray:
    """All masks of at most r of `bits` bits."""
    masks = [sum(1 << i for i in c) for k in range(min(r, bits) + 1) for c in combinations(range(bits), k)]
    return np.asarray(masks, dtype=np.uint64)


def cuts(rows: int) -> list[tuple[int, int]]:
    """(start, end) of the substrings of a code: about log2(rows) bits each."""
    width = min(WIDEST, max(NARROWEST, int(max(rows, 1)).bit_length()))
    edges = np.linspace(0, BITS, -(-BITS // width) + 1).round().astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def substrings(code: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """One column a substring."""
    out = np.zeros((len(code), len(parts)), dtype=np.uint64)
    for i, (a, b) in enumerate(parts):
        for word in range(a // 64, (b - 1) // 64 + 1):
            lo, hi = max(a, 64 * word), min(b, 64 * word + 64)
            bits = code[:, word] >> np.uint64(lo - 64 * word) & np.uint64((1 << (hi - lo)) - 1)
            out[:, i] |= bits << np.uint64(lo - a)
    return out


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of each query's k best, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def _code_words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, WORDS)


class Layout(NamedTuple):
    """The substrings and how many of their leading bits name a slice."""

    parts: list[tuple[int, int]]
    lead: int
    held: int  # entries of a slice, about
    tasks: int  # that hold the index
    dim: int
    kind: str  # of a component, as stored

    def vectors(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=self.kind).reshape(-1, self.dim)

    def leads(self, own: np.ndarray, i: int) -> np.ndarray:
        """Names of the slices of substring i that hold these buckets."""
        a, b = self.parts[i]
        return np.int64(i) << np.int64(32) | (own >> np.uint64(b - a - self.lead)).astype(np.int64)

    def flips(self, radius: np.ndarray) -> np.ndarray:
        """Bits within which codes that lie so far apart agree in at least one substring."""
        return np.asarray(radius) // len(self.parts)


def layout(rows: int, dim: int, kind: str) -> Layout:
    parts = cuts(rows)
    entry = 8 * dim + 8 * WORDS + 32
    held = max(1, SLICE_BYTES // entry)
    lead = min(max(0, (-(-rows // held) - 1).bit_length()), min(b - a for a, b in parts))
    return Layout(parts, lead, held, -(-rows * len(parts) * entry // TASK_BYTES), dim, kind)


MESSAGE = "cell long, id long, code binary, v binary, done int, want int, radius int, least double"


def index_entries(data: DataFrame, at: Layout) -> DataFrame:
    """A row for each substring of each row of `data`, with the slice that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = substrings(_code_words(b.column(1)), at.parts) if b.num_rows else None
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64())]
            for i in range(len(at.parts) if b.num_rows else 0):
                columns = [pa.array(at.leads(own[:, i], i)), b.column(0), b.column(1), b.column(2), *none]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MESSAGE.split(", ")])

    return data.select("id", "code", "v").mapInArrow(run, MESSAGE)


def index_asks(asked: DataFrame, at: Layout) -> DataFrame:
    """A row for each slice that holds buckets within a query's reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, want = substrings(_code_words(b.column(1)), at.parts), b.column(4).to_numpy()
            for flips in np.unique(want).tolist():
                these, masks = np.flatnonzero(want == flips), balls(at.lead, flips).astype(np.int64)
                rows = b.take(pa.array(these))
                for i in range(len(at.parts)):
                    cell = at.leads(own[these, i], i)
                    for mask in masks.tolist():
                        yield pa.RecordBatch.from_arrays([pa.array(cell ^ mask), *rows.columns], [x.split()[0] for x in MESSAGE.split(", ")])

    return asked.select("id", "code", "v", "done", "want", "radius", "least").mapInArrow(run, MESSAGE)


class Slice:
    """Entries of one slice; each query gets its k best of the buckets that it hasn't probed before."""

    def __init__(self, at: Layout, cell: int, k: int, held: list[pa.RecordBatch]):
        self.at, self.part, self.k = at, int(cell) >> 32, k
        self.ids = np.concatenate([b.column("id").to_numpy() for b in held])
        self.code = np.concatenate([_code_words(b.column("code")) for b in held])
        self.v = np.concatenate([at.vectors(b.column("v")) for b in held])
        self.u = unit(self.v.astype(np.float64))
        self.buckets, self.of = np.unique(self.own(self.code), return_inverse=True)

    def own(self, code: np.ndarray) -> np.ndarray:
        return substrings(code, self.at.parts[self.part : self.part + 1])[:, 0]

    def met(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, code = b.column("id").to_numpy(), _code_words(b.column("code"))
        v, own = self.at.vectors(b.column("v")).astype(np.float64), self.own(code)
        done, want, radius = (b.column(x).to_numpy() for x in ("done", "want", "radius"))
        least = np.nan_to_num(b.column("least").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        step = max(1, BLOCK_CELLS // len(self.ids))
        for a in range(0, len(ids), step):
            few = slice(a, a + step)
            flips = np.bitwise_count(own[few, None] ^ self.buckets[None])
            reached = (flips > done[few, None]) & (flips <= want[few, None])
            rows = np.flatnonzero(reached.any(axis=0)[self.of])
            if not len(rows):
                continue
            ok = reached[:, self.of[rows]]
            ok &= apart(code[few, None], self.code[None, rows]) <= radius[few, None]
            ok &= ids[few, None] != self.ids[None, rows]
            near = np.where(ok, unit(v[few]) @ self.u[rows].T, -np.inf)
            n = min(self.k, len(rows))
            floor = np.maximum(np.partition(near, len(rows) - n, axis=1)[:, len(rows) - n], least[few])
            i, j = np.nonzero(ok & (near >= floor[:, None] - 1e-9))
            score = cosine(v[a + i], self.v[rows[j]].astype(np.float64))
            keep = _best(a + i, self.ids[rows[j]], score, self.k)
            if len(keep):
                columns = [pa.array(x[keep]) for x in (ids[a + i], self.ids[rows[j]], score)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def salted_slices(entries: DataFrame, at: Layout) -> DataFrame:
    """(cell, salts): slices of more than twice the entries that one should hold, and into how many they are dealt."""
    sizes = entries.groupBy("cell").count().where(F.col("count") > 2 * at.held)
    salts = materialize(sizes.select("cell", F.ceil(F.col("count") / at.held).cast("int").alias("salts")), "salts")
    return F.broadcast(salts) if salts.count() <= SALT_ROWS else salts


def probed(asked: DataFrame, entries: DataFrame, salts: DataFrame, at: Layout, k: int) -> DataFrame:
    """(query_id, vec_id, score): what each query's further probing of the index finds, at least its k best.

    The entries of a slice in `salts` are dealt by a salt, and a query asks every salt. Entries stand before queries
    in each slice, so a task holds one slice and one batch of queries.
    """
    count = F.coalesce("salts", F.lit(1))

    def dealt(rows: DataFrame, salt: Column, is_query: bool) -> DataFrame:
        joined = rows.join(salts, "cell", "left")
        return joined.withColumn("salt", salt).withColumn("q", F.lit(is_query)).drop("salts")

    both = dealt(entries, F.pmod(F.xxhash64("id"), count).cast("int"), False).unionByName(
        dealt(index_asks(asked, at), F.explode(F.sequence(F.lit(0), count - 1)), True)
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, held, own = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, salt, q = (b.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "salt", "q"))
            new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1]) | (q[1:] != q[:-1])))
            for s, e in zip(new.tolist(), np.append(new[1:], len(cell)).tolist(), strict=True):
                key, run = (int(cell[s]), int(salt[s])), b.slice(s, e - s)
                if key != at_key:
                    at_key, held, own = key, [], None
                if not q[s]:
                    held.append(run)
                elif held or own:
                    if own is None:
                        own, held = Slice(at, key[0], k, held), []
                    yield from own.met(run)

    parts = max(shuffle_partitions(asked.sparkSession), at.tasks)
    sorted_ = both.repartition(parts, "cell", "salt").sortWithinPartitions("cell", "salt", "q")
    return sorted_.mapInArrow(meet, "query_id long, vec_id long, score double")


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by cosine, ties to the smaller id.

    Queries are the rows that `queries` selects; candidates are all rows but the query's own. Vectors that are
    null, empty or zero, or hold null or non-finite components, take no part, nor do rows without an id or with
    another dimension than most rows. Rows that repeat an id are one row each, but never their own candidates.
    A query that repeats an id is the one of the least code and bytes. A query finds what lies within the radius that
    its k-th score needs; if that is fewer than k, all rows. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    chosen = F.coalesce(queries if queries is not None else F.col(id_col) % 50 == 0, F.lit(False))
    kind = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(id_col).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), chosen.alias("q")).where(usable)
    rows = materialize(rows.select("id", "v", "q", F.xxhash64(F.lit(5), "id").alias("h")), "vectors")
    out = "query_id long, rank int, vec_id long, score double"
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()  # a row a dimension
    if most is None:
        return spark.createDataFrame([], out)
    dim, many = most
    rows = rows.where(F.size("v") == dim)
    sample = np.asarray([r["v"] for r in rows.orderBy("h", "id").limit(SAMPLE).select("v").collect()], dtype=float)  # bounded
    x = unit(sample)
    mean, rotation = learn(x)
    radii = learn_radii(x, codes(x, mean, rotation), k)
    at = layout(many, dim, kind)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
            c = codes(unit(v), mean, rotation) if len(v) else np.zeros((0, WORDS), dtype=np.uint64)
            blobs = [pa.array([y.tobytes() for y in z], pa.binary()) for z in (c, v.astype(kind))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *blobs], ["id", "q", "code", "v"])

    coded_rows = materialize(rows.mapInArrow(coded, "id long, q boolean, code binary, v binary"), "codes")
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest: ties go to the smaller id.
    one = W.partitionBy("code", "v").orderBy("id")
    data = coded_rows.withColumn("n", F.row_number().over(one)).where(F.col("n") <= k + 1).select("id", "code", "v")
    data = materialize(data.dropDuplicates(["id", "v"]), "distinct")
    one_each = coded_rows.where("q").groupBy("id").agg(F.min(F.struct("code", "v")).alias("x"))
    start = {"done": F.lit(-1), "want": F.lit(PROBED), "radius": F.lit(BITS), "least": F.lit(None).cast("double")}
    asked = materialize(one_each.select("id", "x.code", "x.v").withColumns(start), "queries")
    ranked = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    entries, best = index_entries(data, at), None
    salts = salted_slices(entries, at)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            done, least = b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False).astype(float)
            full = ~np.isnan(least)
            usual = np.where(at.flips(radii.usual) > done, radii.usual, BITS)
            need = np.where(full, radii.needed(np.nan_to_num(least)), usual)
            want = at.flips(need)
            radius = np.where(full, need, BITS)  # with fewer than k, whatever is met counts
            columns = [*(b.column(i) for i in range(4)), *(pa.array(x.astype(np.int32)) for x in (want, radius)), b.column(4)]
            yield pa.RecordBatch.from_arrays(columns, fields).filter(pa.array(want > done))

    fields = ["id", "code", "v", "done", "want", "radius", "least"]
    state = "id long, code binary, v binary, done int, want int, radius int, least double"
    while not asked.isEmpty():  # two rounds, more for queries of fewer than k: each probes further, at most to all rows
        found = probed(asked, entries, salts, at, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        # Two rows of one id are one candidate, by the nearer vector.
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = materialize(found.withColumn("rank", ranked).where(F.col("rank") <= k), "nearest")
        least = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        now = asked.drop("least").join(least, "id", "left").select("id", "code", "v", F.col("want").alias("done"), "least")
        asked = materialize(now.mapInArrow(further, state), "queries")
    return spark.createDataFrame([], out) if best is None else best.select("query_id", "rank", "vec_id", "score")
