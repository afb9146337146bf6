"""Substring dedup: remove words covered by a window of words that starts in an earlier document too.

Documents lie in blocks. In pass 1 each block sends the sketch cells of its windows to the tasks that own those cells;
they merge the partition sketches of all blocks into a count-min sketch, each its own range of cells, and answer every
block which of its cells were counted twice. The sketch overestimates counts, so a window it counts once is unique. It
grows with the input and is never in one place. Pass 2 groups exactly only the windows estimated repeated, by shards
of their hashes, which answer the blocks where windows start that an earlier document has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, id_text, materialize, pack_arrays, prepare, release, shuffle_partitions, slices, unpack_arrays

WINDOW = 13
BATCH_BYTES = 4 << 20
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: The sketch has ROWS rows of CELLS to 2 * CELLS cells for each window; a task owns 2**CHUNK_BITS cells at a time.
ROWS, CELLS, CHUNK_BITS = 2, 4, 22
#: Windows expected in one shard of the exact pass.
SHARD_WINDOWS = 1_000_000
_M1, _M2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_ROW = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class WordHashes(dict):
    """64-bit hashes of words, each computed once in a worker."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, width: int, by: np.uint64) -> np.ndarray:
    n = len(h) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out *= by
        out += h[j : j + n]
    return _mixed(out)


BLOCK = "block long, windows long, heads binary, texts binary"


def blocks(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Documents, some megabytes of text a row, and how many windows each row has."""
    most = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        raw: list[bytes | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            flags = np.asarray([(i is not None) + 2 * (x is not None) for i, x in zip(ids, raw, strict=True)], dtype=np.uint8)
            lengths = np.asarray([len(x or b"") for x in raw], dtype=np.int64)
            heads = pack_arrays(np.asarray([i or 0 for i in ids], dtype=np.int64), flags, lengths)
            many = sum(max(0, len(x.split()) - width + 1) for i, x in zip(ids, raw, strict=True) if x and i is not None)
            texts = zstandard.ZstdCompressor(level=1).compress(b"".join(x or b"" for x in raw))
            columns = [pa.array([v], t) for v, t in ((number, pa.int64()), (many, pa.int64()), (heads, pa.binary()), (texts, pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                ids.append(doc_id)
                raw.append(x)
                size += len(x or b"") + 16
                if size >= most:
                    yield flush()
                    ids, raw, size = [], [], 0
                    number += 1
        if ids:
            yield flush()

    return materialize(docs.mapInArrow(run, BLOCK), "blocks", "block", buckets)


def texts_of(heads: bytes, texts: bytes) -> tuple[list[int | None], list[bytes | None]]:
    """(ids, texts) of a block."""
    ids, flags, lengths = unpack_arrays(heads)
    whole = zstandard.ZstdDecompressor().decompress(texts)
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    starts = [0, *ends[:-1]]
    raw = [whole[a:b] if f & 2 else None for a, b, f in zip(starts, ends, flags.tolist(), strict=True)]
    return [i if f & 1 else None for i, f in zip(ids.view(np.int64).tolist(), flags.tolist(), strict=True)], raw


def windows(ids: list[int | None], raw: list[bytes | None], width: int, lanes: int) -> tuple[np.ndarray, ...]:
    """(row, position, hash by lane) of all windows of documents with an id; rows and positions rise."""
    out = []
    for a, b in slices(raw, [len(x or b"") for x in raw], BATCH_BYTES):
        words, rows, lengths = [], [], []
        for i in range(a, b):
            if raw[i] and ids[i] is not None:
                own = raw[i].split()
                if len(own) >= width:
                    words += own
                    rows.append(i)
                    lengths.append(len(own))
        if not rows:
            continue
        h, n = word_hashes(words), np.asarray(lengths)
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        keep = np.flatnonzero(at <= np.repeat(n - width, n))
        found = [np.repeat(np.asarray(rows, dtype=np.int32), n)[keep], at[keep].astype(np.int32), _rolled(h, width, _M1)[keep]]
        out.append((*found, _rolled(_mixed(h), width, _M2)[keep]) if lanes == 2 else tuple(found))
    if not out:
        kinds = (np.int32, np.int32, np.uint64, np.uint64)
        return tuple(np.zeros(0, dtype=x) for x in kinds[: 2 + lanes])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h * _ROW[row]) >> np.uint64(64 - bits)


def sketch_bits(windows_: int) -> int:
    """Bits of a cell's number; the sketch follows the number of windows, without a bound."""
    return max(12, (CELLS * windows_).bit_length())


def cell_messages(h: np.ndarray, bits: int, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of the sketch: its occupied cells, how often each, each window's place among them, and the chunks."""
    for row in range(ROWS):
        cell, of, count = np.unique(cells(h, row, bits), return_inverse=True, return_counts=True)
        yield cell, count, of, (cell >> np.uint64(low)).astype(np.int64) + (row << (bits - low))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of runs of equal values."""
    first = _starts(x).tolist()
    return list(zip(first, [*first[1:], len(x)], strict=True)) if first else []


CELL_MESSAGE = "block long, chunk long, packed binary"


def sketch_answers(table: DataFrame, width: int, bits: int, low: int) -> DataFrame:
    """(block, chunk, packed): for each block and chunk of cells, which of its occupied cells were counted twice or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, heads, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, _, h = windows(*texts_of(heads, texts), width, 1)
                for cell, count, _, chunk in cell_messages(h, bits, low):
                    inner = cell & np.uint64((1 << low) - 1)
                    blobs = [
                        pack_arrays(np.diff(inner[a:b], prepend=np.uint64(0)).astype(np.uint32), np.minimum(count[a:b], 2).astype(np.uint8))
                        for a, b in _runs(chunk)
                    ]
                    first = _starts(chunk)
                    columns = [pa.array(np.full(len(first), block)), pa.array(chunk[first]), pa.array(blobs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "chunk", "packed"])

    def merge(rows: pa.Table) -> pa.Table:
        """Add up a chunk of the sketch, saturating at two, and read it for every block."""
        total, told = np.zeros(1 << low, dtype=np.uint8), []
        for blob in rows["packed"]:
            gaps, count = unpack_arrays(blob.as_py())
            at = np.cumsum(gaps, dtype=np.int64)
            total[at] = np.minimum(total[at] + count, 2)
        for blob in rows["packed"]:
            at = np.cumsum(unpack_arrays(blob.as_py())[0], dtype=np.int64)
            told.append(pack_arrays(np.packbits(total[at] > 1, bitorder="little")))
        return pa.Table.from_arrays([rows["block"], rows["chunk"], pa.array(told, pa.binary())], ["block", "chunk", "packed"])

    sent = table.select("block", "heads", "texts").mapInArrow(send, CELL_MESSAGE)
    return materialize(sent.groupBy("chunk").applyInArrow(merge, CELL_MESSAGE), "sketch")


def estimated_repeated(h: np.ndarray, answers: dict[int, bytes], bits: int, low: int) -> np.ndarray:
    """Whether the merged sketch counts each window at least twice."""
    out = np.ones(len(h), dtype=bool)
    for cell, _, of, chunk in cell_messages(h, bits, low):
        twice = [np.unpackbits(unpack_arrays(answers[int(chunk[a])])[0], bitorder="little", count=b - a) for a, b in _runs(chunk)]
        if twice:
            out &= np.concatenate(twice)[of] > 0
    return out


def later_starts(w1: np.ndarray, w2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, whether a document of smaller id has it too."""
    order = np.lexsort((doc, w2, w1))
    a, b, d = w1[order], w2[order], doc[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, dtype=bool)
    out = np.zeros(len(a), dtype=bool)
    out[order] = d != d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


ASKED = "shard int, block long, settled boolean, packed binary"
FOUND = "block long, packed binary"


def _listed(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as gaps, and positions, as gaps within each row; both rise."""
    gap = np.diff(at, prepend=0)
    first = _starts(row)
    gap[first] = at[first]
    return np.diff(row, prepend=0).astype(np.uint32), gap.astype(np.uint32)


def _unlisted(rows: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.cumsum(rows, dtype=np.int64)
    whole = np.cumsum(gaps, dtype=np.int64)
    first = _starts(row)
    before = whole[first] - gaps[first]
    return row, whole - np.repeat(before, np.diff(np.append(first, len(row))))


def repeated_starts(table: DataFrame, answers: DataFrame, width: int, bits: int, low: int, shards: int) -> DataFrame:
    """(block, packed): rows and positions of windows that also start in a document of smaller id.

    A block settles what it can on its own: of documents that share a window it asks only for the earliest one. So a
    window is in a shard once for each block, however many documents have it.
    """

    def ask(block: pa.Table, told: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in ASKED.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        out: list[tuple] = []
        if block.num_rows:
            number = block["block"][0].as_py()
            ids, raw = texts_of(block["heads"][0].as_py(), block["texts"][0].as_py())
            row, at, w1, w2 = windows(ids, raw, width, 2)
            del raw
            bits_of = dict(zip(told["chunk"].to_pylist(), told["packed"].to_pylist(), strict=True))
            keep = estimated_repeated(w1, bits_of, bits, low)
            row, at, w1, w2 = row[keep], at[keep], w1[keep], (w2[keep] >> np.uint64(32)).astype(np.uint32)
            doc = np.asarray([i or 0 for i in ids], dtype=np.int64)
            later = later_starts(w1, w2, doc[row])
            if later.any():
                out.append((number % shards, number, True, pack_arrays(*_listed(row[later], at[later]))))
            row, at, w1, w2 = (x[~later] for x in (row, at, w1, w2))
            shard = (w1 % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            first = _starts(shard[order])
            for own in np.split(order, first[1:]) if len(order) else []:
                some = _starts(row[own])
                docs = doc[row[own][some]]
                out.append((int(shard[own[0]]), number, False, pack_arrays(*_listed(row[own], at[own]), docs, w1[own], w2[own])))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    def exact(rows: pa.Table) -> pa.Table:
        settled = rows["settled"].to_pylist()
        blobs, block = rows["packed"].to_pylist(), rows["block"].to_pylist()
        out = [(b, x) for b, x, s in zip(block, blobs, settled, strict=True) if s]
        asked = [(b, *unpack_arrays(x)) for b, x, s in zip(block, blobs, settled, strict=True) if not s]
        if asked:
            runs = [np.diff(np.append(_starts(np.cumsum(x[1], dtype=np.int64)), len(x[1]))) for x in asked]
            doc = np.concatenate([np.repeat(x[3].view(np.int64), n) for x, n in zip(asked, runs, strict=True)])
            later = later_starts(np.concatenate([x[4] for x in asked]), np.concatenate([x[5] for x in asked]), doc)
            for x, own in zip(asked, np.split(later, np.cumsum([len(x[1]) for x in asked])[:-1]), strict=True):
                if own.any():
                    row, at = _unlisted(x[1], x[2])
                    out.append((x[0], pack_arrays(*_listed(row[own], at[own]))))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "packed": pa.array([r[1] for r in out], pa.binary())})

    asked = table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASKED)
    return materialize(asked.groupBy("shard").applyInArrow(exact, FOUND), "starts")


def kept_words(words: list[bytes], at: np.ndarray, window: int) -> list[bytes]:
    """The words that no window from the positions `at` on covers."""
    edge = np.zeros(len(words) + window + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[: len(words)]) == 0).tolist()]


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document of smaller id.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and
    the kept text if `keep_text`. Windows are judged on the input. A null or empty text has no words. A document
    without an id takes no part: it keeps its words and removes none. Rows that repeat an id are parts of one document:
    their windows never repeat each other, and each row loses its own ones that a document of smaller id has. An empty
    table gives no rows; other columns are ignored. Windows are compared by 96 bits of hash.
    """
    spark = df.sparkSession
    prepare(spark)
    table = blocks(id_text(df, id_col, text_col), window, shuffle_partitions(spark))
    expected = table.agg(F.sum("windows")).first()[0] or 0
    bits, shards = sketch_bits(expected), max(shuffle_partitions(spark), -(-expected // SHARD_WINDOWS))
    low = min(CHUNK_BITS, bits)
    answers = sketch_answers(table, window, bits, low)
    starts = repeated_starts(table, answers, window, bits, low, shards)
    release(answers)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def kept(block: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows:
            ids, raw = texts_of(block["heads"][0].as_py(), block["texts"][0].as_py())
            lists = [_unlisted(*unpack_arrays(x.as_py())) for x in found["packed"]]
            row, at = (np.concatenate(x) for x in zip(*lists, strict=True)) if lists else (np.zeros(0, dtype=np.int64),) * 2
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[order]
            ends = np.searchsorted(row, np.arange(len(ids) + 1))
            for i, (doc_id, x) in enumerate(zip(ids, raw, strict=True)):
                words = (x or b"").split()
                n, own = len(words), at[ends[i] : ends[i + 1]]
                if len(own):
                    words = kept_words(words, own, window)
                text = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(text).hexdigest(), *[text] * keep_text))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_text)
        arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        arrays = [x.cast(pa.string()) if pa.types.is_binary(x.type) else x for x in arrays]
        return pa.Table.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return table.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(kept, schema)
