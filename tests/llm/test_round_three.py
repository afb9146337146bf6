"""Importance resampling, the Jaccard join and conversation repair against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from tastegrid.llm import importance, jaccard, repair, simhash
from tastegrid.llm.common import tree_last

from .test_operators import SCHEMA, WORDS, by_row, fixture_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_resample(docs, target, ngram, buckets, percent, min_words, seed):
    def found(text):
        words = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]

    s, t = [0] * buckets, [0] * buckets
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for b in found(x)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((float(b) + 1) * (sum(s) + buckets) / ((float(a) + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        n, own = found(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("ngram", "percent", "min_words"), [(1, 10, 20), (1, 60, 1), (3, 100, 0)])
def test_importance_resampling(spark, ngram, percent, min_words):
    rows = fixture_rows() + [(100 + i, f"{WORDS[i % 12]} {i} Straße_x1-yé " * (i + 1), None, None, 1, "", "", "") for i in range(40)]
    target = [None, "", "alpha 3 beta", "straße gamma delta " * 30]
    made = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wanted = spark.createDataFrame([(1, x) for x in target], "item_id long, text string")
    got = importance.resample(made, wanted, ngram=ngram, buckets=97, percent=percent, min_words=min_words)
    want = brute_resample([(r[0], r[1]) for r in rows], target, ngram, 97, percent, min_words, 2024)
    assert by_row(got, "doc_id", "n_features", "weight", "score", "rank") == want


def test_importance_pieces_and_empty_tables(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("aZé -9_") for _ in range(9)) for _ in range(400)).encode()
    for ngram in (1, 2, 4):
        whole = sorted(x for _, found in importance.features(text, ngram) for x in found)
        for piece in (1, 7, 50):
            assert sorted(x for _, found in importance.features(text, ngram, piece) for x in found) == whole
    nothing, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(fixture_rows(), SCHEMA)
    assert importance.resample(nothing, nothing).count() == 0
    assert importance.resample(nothing, some).count() == 0
    assert importance.resample(some, nothing).count() == len(fixture_rows())


def brute_jaccard(rows, width, percent):
    def own(text):
        words = (text or "").translate(LOWER).encode().split()
        return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = [(i, own(x)) for i, x in rows]
    root = list(range(len(rows)))
    for a, (i, x) in enumerate(sets):
        for b in range(a):
            j, y = sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    least = {}
    for (i, x), r in zip(sets, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(x), None if i is None else least[r]) for (i, x), r in zip(sets, root, strict=True)), key=repr)


def near_texts(seed, groups, copies):
    """Groups of texts whose similarities lie about the threshold, a passage in many texts, exact copies, short texts."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(50)}" for _ in range(rng.choice([3, 5, 6, 40, 90]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            out.append(" ".join(words) + (f" {passage}" if rng.random() < 0.3 else ""))
    return [*out, *out[:7], passage, passage + " more words", passage.upper()]


@pytest.mark.parametrize(("width", "percent", "fragments", "cells"), [(5, 80, 8, 1 << 20), (5, 80, 3, 64), (2, 50, 5, 1024)])
def test_jaccard_components(spark, width, percent, fragments, cells):
    rows = fixture_rows() + [(200 + i, x, None, None, 1, "", "", "") for i, x in enumerate(near_texts(11, 9, 12))]
    rows += [(203, "an id that repeats with another text of some more words", None, None, 1, "", "", "")] * 2
    random.Random(1).shuffle(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6), width=width, percent=percent, fragments=fragments, cells=cells)
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_jaccard([(r[0], r[1]) for r in rows], width, percent)


@pytest.mark.parametrize("stars", [0, 1, 3])
def test_jaccard_loses_no_link_however_many_stars(spark, stars, monkeypatch):
    monkeypatch.setattr(jaccard.linked, "__defaults__", (stars,))
    rows = list(enumerate(near_texts(5, 4, 25)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_jaccard(rows, 5, 80)


def test_jaccard_rows_beside_a_dense_group_meet_few_of_it(spark, monkeypatch):
    """Rows that miss a dense group narrowly share most of its lists; few of these are asked, and no link is lost."""
    rng, base, texts = random.Random(8), [f"w{i}" for i in range(120)], []
    for k in range(300):
        words = list(base)
        for j in range(rng.randrange(3) if k % 8 else 5):
            words[rng.randrange(120)] = f"own{k}x{j}"
        texts.append(" ".join(words))
    met, plain = [], jaccard.meeting
    monkeypatch.setattr(jaccard, "meeting", lambda here, percent: met.append((here.count(), plain(here, percent).count())) or plain(here, percent))
    rows = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_jaccard(rows, 5, 80)
    assert len({r.component_id for r in got.collect()}) > 10
    assert all(many <= here for here, many in met)


def test_jaccard_pieces_order_and_empty(spark):
    rng = random.Random(2)
    for text in (" ".join(rng.choice(WORDS) for _ in range(300)).encode(), b" a  b\t c", b"", b"one"):
        whole = jaccard.hashes(text)
        for piece in (1, 5, 64):
            assert (jaccard.hashes(text, piece=piece) == whole).all()
    order = jaccard.Order(np.random.default_rng(1).integers(0, 1000, 256), 4)
    ranked = order.ranked(np.random.default_rng(2).integers(0, 2**63, 4000).astype(np.uint64))
    assert (np.diff(ranked.astype(float)) >= 0).all() and len(order.cuts) == 3 and (np.diff(order.cuts.astype(float)) >= 0).all()
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_leaves_little_with_the_driver(spark, monkeypatch):
    """Stars need no second round, their small tables aren't broadcast, and of many long vectors the driver gets what is made of one."""
    made = []
    plain = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: made.append(df) or plain(df, name))
    rows = spark.createDataFrame([(10 * k + j, 10 * k) for k in range(5) for j in range(1, 9)], "a long, b long")
    assert {tuple(r) for r in simhash.components(rows).collect()} == {tuple(r) for r in rows.collect()}
    assert len(made) == 2
    plan = made[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    vectors = spark.range(0, 100, 1, 20).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([np.full(6, b.num_rows, np.int64).tobytes()])], ["x"]) for b in batches), "x binary")
    for fan in (2, 8, 64):
        assert tree_last(vectors, np.int64, 6, lambda x: x.sum(), fan=fan) == 600
    assert tree_last(vectors.where("x is null"), np.int64, 6, lambda x: x.sum()) == 0


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows, damage=True):
    """From the end: the best rest of each place and state, in full."""
    rank = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    out = []
    left = brute_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=rank)
        seen, faults = set(), []
        for _, _, role, text in own:
            short = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not short else "d" if (role, text) in seen else "t" if short[-1] not in ".!?" else "")
            seen.add((role, text))
        follows = {"N": "su", "S": "u", "U": "a", "A": "u"}

        @cache
        def best(i, state, inserted=0, own=own, faults=faults, follows=follows):
            ways = [] if i < len(own) or state not in "NA" else [(0, "", ())]
            if inserted < 2:
                for r in follows[state].replace("s", ""):
                    c, a, rest = best(i, r.upper(), inserted + 1)
                    ways.append((c + 3, "I" + a, ({"u": "user", "a": "assistant"}[r] + ":", *rest)))
            if i < len(own):
                c, a, rest = best(i + 1, state)
                ways.append((c + 4, "D" + a, rest))
                role, text = own[i][2:]
                if faults[i] in ("", "t"):
                    more = 3 if faults[i] else 0
                    if role[:1] in tuple(follows[state]):
                        c, a, rest = best(i + 1, role[0].upper())
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *rest)))
                    for r in follows[state].replace("s", ""):
                        c, a, rest = best(i + 1, r.upper())
                        ways.append((c + more + 3, "R" + a, ({"u": "user", "a": "assistant"}[r] + f":{text}", *rest)))
            return min(ways) if ways else (10**9, "", ())

        cost, audit, lines = best(0, "N")
        turns = [t for _, t, _, _ in own if t is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        counts = [faults.count(x) for x in "bdt"]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, many, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why?", "A longer text without an end", "Done!", None, "é\U0001f600."]
    rows = []
    for conv in range(many):
        for turn in range(rng.randrange(1, most)):
            for _ in range(1 + (rng.random() < 0.1)):
                role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", "User", None, "unit"])
                rows.append((conv if conv % 9 else None, turn if rng.random() > 0.05 else None, role, rng.choice(texts), "x"))
    rng.shuffle(rows)
    return rows


TURNS = "conv_id long, turn long, role string, text string, start string"


@pytest.mark.parametrize(("slice_turns", "fan"), [(256, 16), (4, 2), (1, 3)])
def test_conversation_repair(spark, slice_turns, fan):
    rows = conversations(slice_turns, 60, 14)
    given = spark.createDataFrame(rows, TURNS).repartition(3)
    got = repair.repair_damaged(given, slice_turns=slice_turns, fan=fan)
    assert by_row(got, "conv_id", *repair.COLUMNS) == brute_repair([r[:4] for r in rows])


def test_long_conversation_and_undamaged_turns(spark):
    rows = conversations(8, 3, 400) + [(500, None, None, None, "")] * 3
    fixed = repair.Repair(spark.createDataFrame(rows, TURNS), slice_turns=32, fan=4)
    assert by_row(fixed.summary(), "conv_id", *repair.COLUMNS) == brute_repair([r[:4] for r in rows], damage=False)
    kept = fixed.turns().where("place is not null").groupBy("start", "place").count()
    assert kept.where("count > 1").count() == 0


def test_repair_of_nothing(spark):
    assert repair.repair_damaged(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hm.", "")], TURNS)).first()
    assert (got["conv_id"], got["cost"], got["audit"], got["repaired_sha256"]) == (gone, 0, "", hashlib.sha256(b"").hexdigest())
