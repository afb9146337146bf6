"""Conversation structure repair: the cheapest edits that bring each conversation's roles into `(s?(ua)+)?`.

Turns are hash-partitioned by conversation and run of at most SLICE turns. Inside a partition's batches a DuckDB
recursive query advances one turn a recursion for all conversations at once and keeps, for each grammar state, the
minimum cost and its audit. A run beyond the first starts from every state; runs of long conversations are put together
by the same recursion over runs, FAN at a time, so no task holds a conversation of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import number_rows
from .common import materialize, prepare, shuffle_partitions

#: Turns in a run, runs that are put together at a time, rows that one DuckDB query gets.
SLICE, FAN, BATCH_ROWS = 256, 16, 8192
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, CUT = range(4)  # a turn's first fault
#: What may follow: nothing yet, after the system turn, after a user's, after an assistant's.
GRAMMAR = {"N": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
ACCEPTED = "NA"


@cache
def inserts(state: str) -> tuple[tuple[str, int, str], ...]:
    """(state, cost, audit) after no, one or two inserted turns; two bring any state to an end, more gain nothing."""
    out = [(state, 0, "")]
    for _ in range(2):
        out += [(GRAMMAR[s][r], cost + INSERT, audit + "I") for s, cost, audit in out for r in "ua" if r in GRAMMAR[s]]
    return tuple(dict.fromkeys(out))


@cache
def moves() -> pa.Table:
    """(src, initial, fault, dst, cost, audit): the best way over one turn between two states, insertions before it included."""
    best: dict[tuple, tuple[int, str]] = {}
    for src in GRAMMAR:
        for at, cost, audit in inserts(src):
            for initial in "sua?":
                for fault in range(4):
                    more = TRUNCATED if fault == CUT else 0
                    ways = [(at, DELETE, "D")]
                    if fault in (SOUND, CUT):
                        ways += [(GRAMMAR[at][r], c + more, e) for r, c, e in ((initial, KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")) if r in GRAMMAR[at]]
                    for dst, c, e in ways:
                        key, way = (src, initial, fault, dst), (cost + c, audit + e)
                        best[key] = min(best.get(key, way), way)
    rows = [(*k, *v) for k, v in best.items()]
    return pa.table(dict(zip(("src", "initial", "fault", "dst", "cost", "audit"), map(list, zip(*rows, strict=True)), strict=True)))


#: One recursion is one step of all runs; a key keeps its last row, so earlier steps don't pile up.
ADVANCE = """
WITH RECURSIVE best(start, slice, first, state, step, v) USING KEY (start, slice, first, state) AS (
  SELECT start, slice, first, first, 0::BIGINT, {'cost': 0::BIGINT, 'audit': ''}
  FROM (SELECT DISTINCT start, slice FROM steps), (VALUES ('N'), ('S'), ('U'), ('A')) AS s(first) WHERE first = 'N' OR slice > 0
  UNION
  SELECT b.start, b.slice, b.first, e.dst, b.step + 1, min({'cost': b.v.cost + e.cost, 'audit': b.v.audit || e.audit})
  FROM best b JOIN steps r ON r.start = b.start AND r.slice = b.slice AND r.step = b.step %s
  GROUP BY b.start, b.slice, b.first, e.dst, b.step
)
SELECT start, slice, first, state, v.cost AS cost, v.audit AS audit FROM best
"""
OVER_TURNS = ADVANCE % "JOIN moves e ON e.src = b.state AND e.initial = r.initial AND e.fault = r.fault"
OVER_RUNS = (ADVANCE % "AND r.src = b.state").replace("e.", "r.")
RUN = "start long, slice long, first string, state string, cost long, audit string"


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows, but for the last, that hold the rows of a (start, slice) together; rows are sorted."""
    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        many += batch.num_rows
        if many >= rows:
            table = pa.Table.from_batches(held)
            start, run = table["start"].to_numpy(), table["slice"].to_numpy()
            other = np.flatnonzero((start != start[-1]) | (run != run[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield table.slice(0, cut)
            held, many = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def advanced(steps: DataFrame, query: str, parts: int) -> DataFrame:
    """RUN rows: the best way through each run of `steps`, from each state it may start in to each state it may end in."""
    batch_rows = BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as con:
            con.register("moves", moves())
            for table in whole_runs(batches, batch_rows):
                con.register("steps", table)
                yield from con.execute(query).to_arrow_table().cast(_arrow_schema()).to_batches(max_chunksize=2000)
                con.unregister("steps")

    order = ["start", "slice", "step"]
    return materialize(steps.repartition(parts, "start", "slice").sortWithinPartitions(*order).mapInArrow(run, RUN), "runs")


@cache
def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RUN.split(", ")])


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with a known share of faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a turn, 1
    empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes it a user's. Nulls of role, text and that
    key count as one space; a null turn stays null."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), df[role_col].alias("role"), df[text_col].alias("text"))
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_again")).drop("_again")


class Repair:
    """The repair of a table of turns: `turns`, the edited turns, and `summary`, a row a conversation.

    Turns are taken by turn (nulls first), then role, then text. Nulls of role and text count as one space; turns
    without a conv_id are one conversation. Repeated turns are turns of their own, faulty as duplicates. An empty
    table gives no rows; other columns are ignored, whatever their names. Texts aren't cut, however long.
    """

    def __init__(self, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", slice_turns: int = SLICE, fan: int = FAN):
        self.spark = df.sparkSession
        prepare(self.spark)
        self.parts = shuffle_partitions(self.spark)
        word = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
        rows = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"))
        first = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
        self.rows = number_rows(rows, first, "pos")
        self.conversations = self._conversations()
        steps = self._steps().withColumn("slice", F.expr(f"seq div {slice_turns}")).withColumn("step", F.col("seq") % slice_turns)
        self.steps = materialize(steps, "steps")
        self.best = self._best(fan, slice_turns)

    def _conversations(self) -> DataFrame:
        """A row a conversation: where it starts, its turns, and the turn numbers it misses."""
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
        out = self.rows.groupBy("conv_id").agg(F.min("pos").alias("start"), F.count("*").alias("n"), gaps.cast("long").alias("gaps"))
        return materialize(out, "conversations")

    def _steps(self) -> DataFrame:
        """pos, start, seq, initial, fault, illegal of each turn. Joins are on positions, which no two turns share, but for
        the conversation's start."""
        own = F.rtrim(F.col("text"), F.lit(BLANKS))
        seen = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
        rows = self.rows.select("conv_id", "pos", F.left("role", F.lit(1)).alias("initial"), F.right(own, F.lit(1)).alias("last"), seen.alias("seen"))
        earliest = rows.where("last <> ''").groupBy("conv_id", "seen").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
        starts = self.conversations.select(F.col("conv_id").alias("of"), "start")
        rows = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("of"))).select("pos", "start", "initial", "last")
        before = rows.select((F.col("pos") + 1).alias("pos"), F.col("initial").alias("before"), F.col("start").alias("its_start"))
        rows = rows.join(earliest, "pos", "left").join(before, "pos", "left")
        fault = F.when(F.col("last") == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(SOUND)
        follows = F.col("its_start") == F.col("start")
        illegal = F.coalesce(follows & ~F.concat("before", "initial").isin("su", "ua", "au"), F.lit(False))
        initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
        return rows.select("pos", "start", (F.col("pos") - F.col("start")).alias("seq"), initial.alias("initial"), fault.alias("fault"), illegal.alias("illegal"))

    def _best(self, fan: int, slice_turns: int) -> DataFrame:
        """start, cost, audit of each conversation's cheapest repair, of equal costs the audit that is least."""
        runs = advanced(self.steps.select("start", "slice", "step", "initial", "fault"), OVER_TURNS, self.parts)
        longest = (self.conversations.agg(F.max("n")).first()[0] or 0) - 1
        last = longest // slice_turns
        while last > 0:
            up = runs.select("start", F.expr(f"slice div {fan}").alias("slice"), (F.col("slice") % fan).alias("step"), F.col("first").alias("src"), F.col("state").alias("dst"), "cost", "audit")
            runs, last = advanced(up, OVER_RUNS, self.parts), last // fan
        ends = {s: min((c, a) for at, c, a in inserts(s) if at in ACCEPTED) for s in GRAMMAR}
        cost, audit = F.lit(None).cast("long"), F.lit(None).cast("string")
        for state, (c, a) in ends.items():
            here = F.col("state") == state
            cost, audit = F.when(here, F.col("cost") + c).otherwise(cost), F.when(here, F.concat("audit", F.lit(a))).otherwise(audit)
        best = runs.where("first = 'N'").groupBy("start").agg(F.min(F.struct(cost.alias("cost"), audit.alias("audit"))).alias("b"))
        return materialize(best.select("start", "b.cost", "b.audit"), "audits")

    def turns(self) -> DataFrame:
        """start, place, edit, role, text: the repaired turns in place 0, 1, 2, ... of their conversation, and the
        deleted ones, whose place is null. `start` names the conversation, see `conversations`."""
        edits = self.best.select("start", "audit").repartition(self.parts, "start").mapInArrow(edited, EDIT)
        edits = materialize(edits, "edits")
        rows = self.rows.select("pos", "role", "text")
        own = edits.where("pos is not null").join(rows, "pos").select("start", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text")
        new = edits.where("pos is null").select("start", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
        return own.unionByName(new)

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

        The hash is of `role:text` of the repaired turns, joined by newlines. A conversation's turns stream through one
        hash in their order, which can't be split; nothing of them is kept."""
        counts = self.steps.groupBy("start").agg(
            *[F.sum((F.col("fault") == k).cast("long")).alias(a) for k, a in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))],
            F.sum(F.col("illegal").cast("long")).alias("illegal"),
        )
        order = ["start", "place"]
        kept = self.turns().where("place is not null").repartition(self.parts, "start").sortWithinPartitions(*order)
        hashes = kept.select(*order, "role", "text").mapInArrow(hashed, "start long, repaired_sha256 string")
        out = self.conversations.join(counts, "start").join(self.best, "start").join(hashes, "start", "left")
        return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256))).select("conv_id", *COLUMNS)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
EDIT = "start long, pos long, place long, edit string, new_role string"


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EDIT rows of (start, audit): pos of the turn (null for an inserted one), place in the result (null for a deleted
    one), and the role that the edit gives. The result has a system turn if its length is odd."""
    names = [x.split()[0] for x in EDIT.split(", ")]
    roles = np.asarray(["user", "assistant"], dtype=object)
    for batch in batches:
        for start, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            edit = np.frombuffer(audit.encode(), dtype=np.uint8)
            kept, own = edit != ord("D"), edit != ord("I")
            place, pos = np.cumsum(kept) - 1, start + np.cumsum(own) - 1
            given = roles[(place - int(kept.sum()) % 2) % 2]
            given[(edit == ord("K")) | ~kept] = None
            for a in range(0, len(edit), 4096):
                b = slice(a, a + 4096)
                n = len(edit[b])
                columns = [pa.array(np.full(n, start)), pa.array(pos[b], mask=~own[b]), pa.array(place[b], mask=~kept[b]), pa.array([chr(x) for x in edit[b]], pa.string()), pa.array(given[b], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, sha256) of rows sorted by start and place, one hash open at a time."""
    at, state = None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for start, _, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if start != at:
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = start, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if len(done) > 2000:
            yield _pairs(done)
            done = []
    if state is not None:
        done.append((at, state.hexdigest()))
    yield _pairs(done)


def _pairs(done: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], ["start", "repaired_sha256"])


def repair_damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: Callable[..., DataFrame] = damaged, **options) -> DataFrame:
    """Repairs what `damage` makes of `df`: a row for each conv_id of `df`, zeros and an empty audit where no turn is left."""
    fixed = Repair(damage(df, conv_col, turn_col, role_col, text_col), **options).summary().withColumnRenamed("conv_id", "of")
    every = df.select(df[conv_col].alias("conv_id")).distinct()
    out = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    rest = {"audit": F.lit(""), "repaired_sha256": F.lit(EMPTY_SHA256)}
    return out.select("conv_id", *[F.coalesce(c, rest.get(c, F.lit(0).cast("long"))).alias(c) for c in COLUMNS])
