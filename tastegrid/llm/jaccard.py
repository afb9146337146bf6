"""N-gram Jaccard join by vertical partitioning.

All word shingles stand in one global order, rare ones first, that a sketch of fixed size gives. Candidates are documents
that share a shingle of their prefixes in that order. The order is cut into fragments of about equal mass; each
fragment counts a pair's partial overlap on its own, and the sum over fragments decides the pair exactly.

Documents with equal sets are one node. Only components are asked for, so a shingle's list of nodes is first linked to
one of them as a star; pairs within what is linked by then are never formed, and only pairs between components stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, id_text, materialize, prepare, release, tree_last
from .simhash import components, with_least
from .substring import _M1, _rolled, word_hashes

SHINGLE, PERCENT = 5, 80
#: Cells of the sketch, fragments of the order, and bits of the filter of documents whose sets are read again.
CELLS, FRAGMENTS, FILTER_BITS = 1 << 20, 8, 1 << 24
#: A shingle is a number of HASH_BITS bits under the class of its frequency.
HASH_BITS, CLASSES = 58, 32
#: Bytes of text that are cut into words together.
PIECE = 1 << 20
#: Rounds of stars at most before what is left is compared pair by pair; more pay where lists are long and no row of theirs is near most others.
STARS = 1


def hashes(raw: bytes | None, width: int = SHINGLE, piece: int = PIECE) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included; with fewer words, the whole sequence is one."""
    text = (raw or b"").lower()  # bytes.lower() changes A-Z only
    out, carried, at = [], np.zeros(0, dtype=np.uint64), 0
    while at < len(text):
        end = at + piece
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        h = word_hashes(text[at:end].split())
        h = np.concatenate([carried, h]) if len(carried) else h
        if len(h) >= width:
            out.append(_rolled(h, width, _M1))
            carried = h[len(h) - width + 1 :]
        else:
            carried = h
        at = end
    if not out:
        return _rolled(carried, len(carried), _M1) if len(carried) else carried
    return out[0] if len(out) == 1 else np.concatenate(out)


def cells_of(h: np.ndarray, cells: int) -> np.ndarray:
    return (h & np.uint64(cells - 1)).astype(np.int64)


class Order:
    """The global order: classes of the logarithm of the sketch's counts, then hashes; and its cuts into fragments."""

    def __init__(self, counts: np.ndarray, fragments: int):
        self.classes = np.minimum(np.frexp(counts.astype(float))[1], CLASSES - 1).astype(np.uint8)
        mass = np.bincount(self.classes, weights=counts, minlength=CLASSES)
        ends = np.cumsum(mass)
        wanted = ends[-1] * np.arange(1, fragments) / fragments
        at = np.minimum(np.searchsorted(ends, wanted), CLASSES - 1)
        share = (wanted - (ends[at] - mass[at])) / np.maximum(mass[at], 1)  # hashes are even within a class
        self.cuts = (at.astype(np.uint64) << np.uint64(HASH_BITS)) + (share * 2.0**HASH_BITS).astype(np.uint64)

    def ranked(self, h: np.ndarray) -> np.ndarray:
        """The distinct shingles as numbers in the global order, sorted."""
        kind = self.classes[cells_of(h, len(self.classes))].astype(np.uint64)
        own = np.sort(kind << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS))
        return own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def global_order(docs: DataFrame, width: int, cells: int, fragments: int) -> Order:
    """The order by the sketch: shingles in each cell, over all documents. Single precision does, since only classes are made
    of it; that happens in a task, so that the driver gets a byte a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for raw in column_bytes(batch, "text"):
                held.append(hashes(raw, width))
                size += len(held[-1])
                if size > 2 * cells:
                    total += np.bincount(cells_of(np.concatenate(held), cells), minlength=cells)
                    held, size = [], 0
        if held:
            total += np.bincount(cells_of(np.concatenate(held), cells), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["counts"])

    return tree_last(docs.mapInArrow(run, "counts binary"), np.float32, cells, lambda counts: Order(counts.astype(float), fragments))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def needed(n, percent: int):
    """Shingles that two sets of `n` together must share, times 100 + percent."""
    return n * percent


SET = "doc_id long, n long, k1 long, k2 long, prefix array<long>"


def set_keys(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of ranked shingles, as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype="<i8").tolist())


def prefixed(docs: DataFrame, order: Order, width: int, percent: int) -> DataFrame:
    """SET rows: size and name of each document's set, and the first shingles of it, one of which any partner shares."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                own = shared.value.ranked(hashes(raw, width))
                n = len(own)
                # A partner has percent% of the size at least, so a shared shingle at place p leaves n - p >= n * percent / 100.
                rows.append((doc_id, n, *set_keys(own), own[: n - -(-n * percent // 100) + 1].view(np.int64)))
            yield packed(rows, SET)

    out = materialize(docs.mapInArrow(run, SET), "sets")
    shared.destroy()
    return out


def lists(nodes: DataFrame, percent: int) -> DataFrame:
    """token, node, n, place: nodes by prefix shingle, where at least one partner is long enough for it."""
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("place", "token"))
    many = rows.groupBy("token").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("many > 1")
    rows = rows.join(many, "token")
    able = F.col("n") - F.col("place") >= rest_needed(F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100)), percent)
    return materialize(rows.where(able).select("token", "node", "n", "place"), "lists")


#: Shingles that the prefixes of a pair share at least before its sets are compared, where their sizes allow it.
SHARED = 16


def overlap(n, m, percent: int):
    """Shingles that sets of `n` and `m` must share."""
    return F.ceil((n + m) * percent / (100 + percent))


def rest_needed(n, m, percent: int):
    """Shingles that must be left from a place on for it to count among those the prefixes share.

    Sets that share `overlap` have at least k shingles in common among the first n - overlap + k of each, for any k that
    leaves these prefixes within the stored ones: by the set whose prefix ends first, all but n - (its length) of the
    common shingles are in both. k is SHARED, or as many as the stored prefixes allow.
    """
    return F.greatest(overlap(n, m, percent) - (SHARED - 1), F.ceil(F.greatest(n, m) * percent / 100))


def filter_bits(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size over a column of numbers, a row a partition, merged by a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], ["bits"])

    return tree_last(ids.mapInArrow(run, "bits binary"), np.uint8, bits // 8, lambda bits: bits, np.bitwise_or)


def segments(docs: DataFrame, wanted: DataFrame, order: Order, width: int, bits: int) -> DataFrame:
    """node, fragment, part: the sets of `wanted` (node, k1, k2, first: a document that has it), cut at the fragments.

    Texts are cut into shingles once more; documents that a filter of fixed size rules out send nothing.
    """
    marks = filter_bits(wanted.select(F.xxhash64("first").alias("mark")), bits)
    shared = docs.sparkSession.sparkContext.broadcast((order, marks))
    schema = "k1 long, k2 long, first long, fragment int, part array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            asked = seen[(marks >> np.uint64(3)).astype(np.int64)] >> (marks & np.uint64(7)).astype(np.uint8) & 1
            texts = column_bytes(batch, "text")
            for i in np.flatnonzero(asked).tolist():
                own = order.ranked(hashes(texts[i], width))
                key = set_keys(own)
                for f, part in enumerate(np.split(own, np.searchsorted(own, order.cuts))):
                    if len(part):
                        rows.append((*key, ids[i], f, part.view(np.int64)))
                size += len(own)
                if size > PIECE:
                    yield packed(rows, schema)
                    rows, size = [], 0
            yield packed(rows, schema)

    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("mark")).mapInArrow(run, schema)
    # Copies of a row are equal; the keys of the join are keys here too, so that nothing is shuffled again.
    keys = ["k1", "k2", "first"]
    found = found.join(wanted, keys).groupBy(*keys, "node", "fragment").agg(F.first("part").alias("part")).drop(*keys)
    out = materialize(found, "segments")
    shared.destroy()
    return out


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among `pairs` (a, b, n: sizes of both together): partial overlaps by fragment, summed up."""
    left = pairs.join(parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("mine")), "a")
    both = left.join(parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("yours")), ["b", "fragment"])
    partial = both.select("a", "b", "n", F.size(F.array_intersect("mine", "yours")).alias("shared"))
    total = partial.groupBy("a", "b").agg(F.first("n").alias("n"), F.sum("shared").alias("shared"))
    return total.where(F.col("shared") * (100 + percent) >= needed(F.col("n"), percent)).select("a", "b")


#: A row and a center are compared if they meet in this part of the lists they must share; others may have other centers.
STAR_PART = 4


def candidates(met: DataFrame, percent: int, part: int) -> DataFrame:
    """(a, b, n: sizes of both together) with a > b, of rows of lists that meet, by what their prefixes share: at least
    one `part`-th of the shingles that linked rows share there."""
    n, m, p, q = (F.col(f"{x}{c}") for c in ("n", "place") for x in ("", "other_"))
    alike = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    met = met.where(alike & (F.least(n - p, m - q) >= rest_needed(n, m, percent)))
    pair = [F.greatest("node", "other_node").alias("a"), F.least("node", "other_node").alias("b"), (n + m).alias("n")]
    shared = overlap(n, m, percent) - rest_needed(n, m, percent) + 1
    found = met.select(*pair, shared.alias("least")).groupBy("a", "b", "n", "least").count()
    return found.where(F.col("count") * part >= F.col("least")).select("a", "b", "n")


def star_pairs(own: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each list's rows outside its largest component with one row of that component, which changes with `turn`. Pairs that
    meet in too few lists with the same center are left for `rest_pairs`.

    The first is the row with the fewest rarer shingles, which is nearest to what the list's texts have in common.
    """
    key = [F.col("place") if turn == 0 else F.lit(0).alias("place"), F.xxhash64(F.lit(turn), "node")]
    row = F.struct(*[k.alias(f"key{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "place")])
    by_root = own.groupBy("token", "root").agg(F.count("*").alias("many"), F.min(row).alias("center"))
    largest = by_root.groupBy("token").agg(F.max(F.struct("many", -F.col("center.key0"), "root", "center")).alias("top"), F.count("*").alias("roots"))
    centers = largest.where("roots > 1").select("token", F.col("top.root").alias("top_root"), "top.center.*")
    met = own.join(centers, "token").where(F.col("root") != F.col("top_root"))
    return candidates(met, percent, STAR_PART)


def least_shared(n, low, high, percent: int):
    """Shingles that the prefixes of a set of `n` and any linked one of `low` to `high` share at least.

    With a larger partner fewer are asked for, but for roundings, which the second form leaves out.
    """
    m = F.least(n, low)
    smaller = overlap(n, m, percent) - rest_needed(n, m, percent) + 1
    larger = F.least(F.lit(SHARED), F.ceil((n + high) * percent / (100 + percent) - high * percent / 100))
    return F.greatest(F.lit(1), F.least(smaller, F.when(high > n, larger).otherwise(smaller)))


#: Sets of up to so many shingles meet by their exact sizes, larger ones by classes some 2 % wide.
EXACT_SIZES = 256


def listed(own: DataFrame) -> DataFrame:
    """Rows of lists with several components, with the class (`kind`) of their size and a `rank` of their component by size."""
    several = own.groupBy("token").agg(F.min("root").alias("root1"), F.max("root").alias("root2")).where("root1 < root2").select("token")
    weights = own.where("node != root").groupBy("root").agg(F.count("*").alias("weight"))
    kind = F.when(F.col("n") < EXACT_SIZES, F.col("n")).otherwise(EXACT_SIZES + F.floor(50 * F.log(F.col("n") / EXACT_SIZES)))
    rank = F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), "root")
    return own.join(several, "token").join(weights, "root", "left").select("token", "node", "n", "place", kind.cast("long").alias("kind"), rank.alias("rank"))


def asking(here: DataFrame, percent: int) -> DataFrame:
    """token, kind, node, n, place, rank: the lists in which a row looks for partners of a class of sizes in higher components.

    Of the L lists that a row has in common with such rows, a linked partner is in `least_shared` at least, so it is in one of any
    L - least_shared + 1; the shortest ones are taken. A row in too few lists asks for none.
    """
    n = F.col("n")
    groups = here.groupBy("token", "kind").agg(F.count("*").alias("many"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rank").alias("top"))
    fits = (F.col("high") * 100 >= n * percent) & (F.col("low") * percent <= n * 100) & (F.col("top") > F.col("rank"))
    met = here.drop("kind").join(groups, "token").where(fits)
    own = Window.partitionBy("node", "kind")
    least = F.min(least_shared(n, F.col("low"), F.col("high"), percent)).over(own)
    met = met.withColumn("spare", F.count("*").over(own) - least).withColumn("turn", F.row_number().over(own.orderBy("many", "token")))
    return met.where("turn <= spare + 1").select("token", "kind", "node", "n", "place", "rank")


def meeting(here: DataFrame, percent: int) -> DataFrame:
    """Rows with those in higher components that they meet in the lists they ask, one row a list."""
    there = here.select("token", "kind", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "place", "rank")])
    return asking(here, percent).join(there, ["token", "kind"]).where("other_rank > rank")


def rest_pairs(own: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list's rows in different components that can link. The one in the smaller component, which is the same one
    in all lists, asks for the other, so that a dense group is asked for by the few rows that stars have not linked to it."""
    here = materialize(listed(own), "rest")
    n, m, p, q = (F.col(f"{x}{c}") for c in ("n", "place") for x in ("", "other_"))
    alike = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    met = meeting(here, percent).where(alike & (F.least(n - p, m - q) >= rest_needed(n, m, percent)))
    least = overlap(n, m, percent) - rest_needed(n, m, percent) + 1
    pairs = met.select(F.greatest("node", "other_node").alias("a"), F.least("node", "other_node").alias("b"), (n + m).alias("n"), least.alias("least")).distinct()
    # A pair in different components meets in each list that has both, so all it shares is among these.
    tokens = here.groupBy("node").agg(F.collect_list("token").alias("tokens"))
    mine, yours = (tokens.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in ("a", "b"))
    both = pairs.join(mine, "a").join(yours, "b")
    return both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("least")).select("a", "b", "n")


def linked(found: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, stars: int = STARS) -> DataFrame:
    """(node, root) of nodes that have links, but for roots: components of all links among the nodes of `found` lists.
    `sets_of` gives the segments of a column of nodes; it is asked once for each node that is in a pair.

    Stars link most of a dense group; then every pair of a list whose rows are in different components is compared, so
    no link between components is lost, however many stars there were.
    """
    roots = found.sparkSession.createDataFrame([], "node long, root long")
    own, tried, parts, turn = found.withColumn("root", F.col("node")), None, None, 0
    while True:
        pairs = star_pairs(own, percent, turn) if turn < stars else rest_pairs(own, percent)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if parts is not None:
            asked = asked.join(parts.select("node"), "node", "left_anti")
        more = sets_of(asked)
        parts = more if parts is None else parts.unionByName(more)
        new = materialize(verified(pairs, parts, percent), "links")
        some = not new.isEmpty()
        if some:
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = components(known.unionByName(new))
            named = roots.select("node", F.col("root").alias("its_root"))
            own = found.join(named, "node", "left").select(*found.columns, F.coalesce("its_root", "node").alias("root"))
        if turn == stars:
            return roots
        turn = turn + 1 if some else stars


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS, cells: int = CELLS) -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id (the smallest id that links reach, its own included).

    Rows link when their shingle sets share at least `percent` percent of what they hold together. A null text, or one
    without words, has no shingles and links nothing. A row without an id has its n_shingles, a null component_id, and
    links nothing. Rows that repeat an id are judged each by its own text. An empty table gives no rows; other columns
    are ignored, whatever their names. Shingles are compared by 58 bits of hash. `fragments` and `cells` change the
    work, not the result.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = id_text(df, id_col, text_col)
    order = global_order(docs, width, cells, fragments)
    sets = prefixed(docs, order, width, percent)
    able = sets.where("doc_id is not null and n > 0")
    nodes = able.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = lists(nodes, percent)
    keys = materialize(sets.select("doc_id", "n", "k1", "k2"), "keys")
    names = materialize(nodes.select("node", "k1", "k2", "first"), "names")
    release(sets, nodes)  # no prefix is asked for any more

    def sets_of(asked: DataFrame) -> DataFrame:
        return segments(docs, names.join(asked, "node", "left_semi"), order, width, FILTER_BITS)

    roots = linked(found, sets_of, percent)
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    firsts = roots.join(names.select("node", "first"), "node").select(F.col("root").alias("a"), F.col("first").alias("b"), "node")
    low = with_least(firsts).select("node", "m")
    of = names.join(low, "node", "left").select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), F.coalesce("m", "first").alias("component"))
    # Read from a table, so that AQE can split a set with very many copies in the last join.
    of = materialize(of, "components")
    rows = keys.join(of, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
