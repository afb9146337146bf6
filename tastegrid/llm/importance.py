"""Target-distribution importance resampling over hashed n-gram counts, in two passes of Arrow batches.

Pass 1: each partition adds np.bincount vectors of its features' buckets, and treeReduce merges the partitions' vectors,
so the driver gets one vector of `buckets` counts whatever the input. Pass 2 gathers each feature's gain from the
broadcast vector of gains and sums documents with bincount weights. The draw is Gumbel top-k: the highest scores are
range-sorted and numbered, so no task and no driver sees all of them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import number_rows
from .common import column_bytes, id_text, materialize, prepare, tree_sum

NGRAM, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Bytes of text that are cut into words together.
PIECE = 1 << 20
#: Lower-cases A-Z and turns what is no word byte into a blank.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def word_lists(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some of them at a time; a word is never cut."""
    folded = raw.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        words = folded[at:end].split(b" ")
        yield [x for x in words if x]
        at = end


def features(raw: bytes, ngram: int = NGRAM, piece: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(new words, features ending in them): runs of 1 to `ngram` words, joined by one space."""
    carried: list[bytes] = []
    for words in word_lists(raw, piece):
        out, run = list(words), carried + words
        for k in range(2, ngram + 1):
            first = max(0, len(carried) - k + 1)
            out += [b" ".join(run[i : i + k]) for i in range(first, len(run) - k + 1)]
        yield len(words), out
        carried = run[max(0, len(run) - ngram + 1) :] if ngram > 1 else []


def bucketed(raw: bytes | None, ngram: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of their features) of one text, some of it at a time."""
    for n, found in features(raw or b"", ngram):
        yield n, np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found)) % buckets


def bucket_counts(df: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; nulls have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in column_bytes(batch, "text"):
                for _, found in bucketed(raw, ngram, buckets):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    texts = df.select(df[text_col].cast("string").alias("text"))
    return tree_sum(texts.mapInArrow(run, "counts binary"), np.int64, buckets)


def gains(source: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """floor(scale * ln of the smoothed ratio of target to source) of each bucket, as whole numbers."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    ratio = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.asarray([math.floor(scale * math.log(x)) for x in ratio], dtype=np.int64)


def noise(doc_id: int | None, seed: int, scale: float = 1000.0) -> int:
    """A whole-number Gumbel draw that depends on the id and the seed only."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, id_col: str, text_col: str, ngram: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row."""
    buckets = len(gain)
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.num_rows
            words, many, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            rows: list[int] = []
            held: list[np.ndarray] = []

            def settle() -> None:
                if not held:
                    return
                row = np.repeat(np.asarray(rows), [len(x) for x in held])
                own = np.bincount(row, weights=shared.value[np.concatenate(held)], minlength=n)  # noqa: B023
                weight[:] += own.astype(np.int64)  # noqa: B023
                rows.clear()  # noqa: B023
                held.clear()  # noqa: B023

            size = 0
            for i, raw in enumerate(column_bytes(batch, "text")):
                for new, found in bucketed(raw, ngram, buckets):
                    words[i] += new
                    many[i] += len(found)
                    rows.append(i)
                    held.append(found)
                    size += len(found)
                    if size >= PIECE:
                        settle()
                        size = 0
            settle()
            score = weight + np.asarray([noise(i, seed) for i in ids], dtype=np.int64)
            columns = [batch.column(0), *map(pa.array, (words, many, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `df`: doc_id, n_features, weight, score, and rank if it is drawn.

    Of the rows with at least `min_words` words, `percent` percent (rounded down) with the highest scores are drawn.
    A null or empty text has no features, weight 0 and isn't drawn while `min_words` is positive. A null id draws its noise from an empty id and
    comes after all others in ties. Rows that repeat an id and a text have equal scores and ranks of their own, in any order. An empty table
    gives no rows; an empty target leaves every gain to the smoothing. Other columns are ignored, whatever their names.
    """
    prepare(df.sparkSession)
    gain = gains(bucket_counts(df, text_col, ngram, buckets), bucket_counts(target, target_col, ngram, buckets))
    rows = materialize(scored(df, gain, id_col, text_col, ngram, seed), "scores")
    able = F.col("n_words") >= min_words
    drawn = rows.where(able).count() * percent // 100
    ranked = number_rows(rows.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank", start=1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
