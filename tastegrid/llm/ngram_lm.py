"""N-gram language-model scoring with Elias-Fano tries.

Documents are tokenised once into blocks. Level by level, each block asks the shards for its distinct n-grams with
its own training counts; a shard adds them up, numbers them, builds its part of the trie (contexts, monotone
pointers, successors, quantised smoothed probabilities) as memory-mapped Elias-Fano levels and answers by
context-relative successor search. Words are the first level, numbered by their shards; an n-gram of a higher level
is the number of its context, an n-gram of the level below, and that of its word, so no two share an entry. The
successors of a frequent context are spread over shards by a salt of the word, as many as its count asks for.
Blocks and shards are groups of Spark, each bounded in bytes, and no task or driver ever holds the model whole.
`fit` keeps the shards' parts of the trie as rows of a table, from which `score_with` answers for any other table.

P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and for a context h of one more word than h', backing off by MU / (c(h) + MU):
P(w | h) = c(hw) / (c(h) + MU) + MU / (c(h) + MU) * P(w | h'). A document starts after an end; there, shorter contexts do.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, id_text, materialize, pack_arrays, prepare, shuffle_partitions, unpack_arrays
from .substring import _mixed, word_hashes

#: Words in the longest n-gram.
ORDER = 3
#: Bytes of text in a block, and of all text in a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
MU = 4.0
#: Probabilities are kept in STEPS steps of their log10 from LOWEST to 0; code 0 is for n-grams never seen.
LOWEST, STEPS = -24.0, 65534
#: A context's successors get another shard for every so many of its occurrences.
SALT_COUNT = 1 << 17
#: Bits of a word's number; the rest of 64 is for the contexts of one shard.
WORD_BITS = 40
#: An Elias-Fano level keeps every so many values as they are, where a search begins.
SKIP = 64
END = xxhash.xxh3_64_intdigest(b" ")  # no word holds a blank


class EliasFano:
    """A monotone sequence in memory-mapped levels: low bits packed, high bits unary, counts of ones every word."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = n = len(values)
        self.low = low = min(63, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        ones = np.zeros((int(high[-1]) if n else 0) // 64 * 64 + 64, dtype=np.uint8)
        ones[high] = 1
        bits = np.packbits(ones, bitorder="little").view("<u8")
        before = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64))
        packed = np.zeros(n * low // 64 + 2, dtype="<u8")
        if low:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            part, word, shift = values & np.uint64((1 << low) - 1), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(packed, word, part << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(packed, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        self.bits, self.before, self.packed, self.skip = mapped(bits, before, packed, np.ascontiguousarray(values[::SKIP]))

    def stored(self) -> list[np.ndarray]:
        return [np.asarray([self.n, self.low], dtype=np.uint64), self.bits, self.before, self.packed, self.skip]

    @classmethod
    def restored(cls, head: np.ndarray, bits: np.ndarray, before: np.ndarray, packed: np.ndarray, skip: np.ndarray) -> EliasFano:
        self = cls.__new__(cls)
        self.n, self.low = (int(x) for x in head)
        self.bits, self.before, self.packed, self.skip = mapped(bits, before.view(np.int64), packed, skip)
        return self

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.before, i, side="right") - 1
        rest, left = i - self.before[word], self.bits[word]
        # the position of the rest-th one: halve the word, six times
        at = np.zeros(len(i), dtype=np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(left & np.uint64((1 << step) - 1)).astype(np.int64)
            up = rest >= ones
            rest = rest - np.where(up, ones, 0)
            at += np.where(up, np.uint64(step), np.uint64(0))
            left = np.where(up, left >> np.uint64(step), left)
        high = (word.astype(np.uint64) << np.uint64(6)) + at - i.astype(np.uint64)
        if not self.low:
            return high
        bit = i.astype(np.uint64) * np.uint64(self.low)
        k, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = self.packed[k] >> shift
        over = shift + np.uint64(self.low) > np.uint64(64)
        part[over] |= self.packed[k[over] + 1] << (np.uint64(64) - shift[over])
        return high << np.uint64(self.low) | part & np.uint64((1 << self.low) - 1)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first position in [lo, hi) whose value is at least x, else hi."""
        near = np.searchsorted(self.skip, x)  # that many kept values are smaller
        lo, hi = np.maximum(lo, np.minimum(near * SKIP - SKIP, hi)), np.minimum(hi, near * SKIP)
        hi = np.maximum(lo, hi)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = self.access(mid) < x[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


def mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a memory-mapped file of this task that goes when they do."""
    sizes = [-(-x.nbytes // 8) * 8 for x in arrays]
    with tempfile.TemporaryFile() as f:
        f.truncate(max(sum(sizes), 1))
        whole = np.frombuffer(mmap.mmap(f.fileno(), max(sum(sizes), 1)), dtype=np.uint8)
    out, at = [], 0
    for x, size in zip(arrays, sizes, strict=True):
        own = whole[at : at + x.nbytes].view(x.dtype)
        own[:] = x
        out.append(own)
        at += size
    return out


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 for 0."""
    with np.errstate(divide="ignore"):
        step = np.rint((np.log10(p) - LOWEST) / -LOWEST * STEPS)
    return np.where(p > 0, np.clip(step, 0, STEPS) + 1, 0).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10 ** (LOWEST - LOWEST * (codes.astype(float) - 1) / STEPS), 0.0)


class Trie:
    """One level of a shard: contexts, pointers to their successors, successors relative to the context, codes."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, probabilities: np.ndarray):
        """Rows sorted by context and word, each pair once."""
        n = len(contexts)
        first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if n else np.zeros(0, dtype=np.int64)
        self.contexts = EliasFano(contexts[first], int(contexts[-1]) + 1 if n else 1)
        self.pointers = EliasFano(np.append(first, n).astype(np.uint64), n + 1)
        self.bits = np.uint64(int(words.max()).bit_length() if n else 1)
        place = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, n)))
        self.successors = EliasFano(place << self.bits | words, max(1, len(first)) << int(self.bits))
        self.codes = mapped(quantised(probabilities))[0]

    def stored(self) -> list[np.ndarray]:
        levels = [*self.contexts.stored(), *self.pointers.stored(), *self.successors.stored()]
        return [np.asarray([self.bits], dtype=np.uint64), *levels, self.codes]

    @classmethod
    def restored(cls, bits: np.ndarray, *arrays: np.ndarray) -> Trie:
        self = cls.__new__(cls)
        self.bits = np.uint64(bits[0])
        self.contexts, self.pointers, self.successors = (EliasFano.restored(*arrays[i : i + 5]) for i in (0, 5, 10))
        self.codes = mapped(arrays[15])[0]
        return self

    def look_up(self, contexts: np.ndarray, of: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of n-grams, the i-th of which is words[i] after contexts[of[i]]; 0 for those that the trie lacks."""
        at = self.find(contexts, of, words)
        out = np.zeros(len(words), dtype=np.uint16)
        out[at >= 0] = self.codes[at[at >= 0]]
        return out

    def find(self, contexts: np.ndarray, of: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places of n-grams among those of the trie, -1 for those that it lacks."""
        out = np.full(len(words), -1)
        if not len(words) or not self.contexts.n:
            return out
        at = self.contexts.successor(contexts, np.zeros(len(contexts), dtype=np.int64), np.full(len(contexts), self.contexts.n))
        known = at < self.contexts.n
        known[known] = self.contexts.access(at[known]) == contexts[known]
        at = np.where(known, at, 0)
        lo, hi = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        hi = np.where(known, hi, lo)
        asked = np.flatnonzero((hi > lo)[of] & (words >> self.bits == 0))
        own, want = of[asked], at[of[asked]].astype(np.uint64) << self.bits | words[asked]
        found = self.successors.successor(want, lo[own], hi[own])
        some = np.flatnonzero(found < hi[own])
        some = some[self.successors.access(found[some]) == want[some]]
        out[asked[some]] = found[some]
        return out


class Block(NamedTuple):
    number: int
    ids: np.ndarray
    held: np.ndarray  # 0 learnt from, 1 held out, 2 without an id
    lengths: np.ndarray
    vocabulary: np.ndarray  # hashes, sorted
    tokens: np.ndarray  # places in the vocabulary


BLOCK = "block long, bytes long, packed binary"


def packed_block(b: Block, size: int) -> pa.RecordBatch:
    """Tokens are kept as ranks by frequency, which are mostly small."""
    count = np.bincount(b.tokens, minlength=len(b.vocabulary))
    rank = np.empty(len(count), dtype=np.uint32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
    blob = pack_arrays(b.ids, b.held, b.lengths.astype(np.uint32), np.diff(b.vocabulary, prepend=np.uint64(0)), count.astype(np.uint32), rank[b.tokens])
    return pa.RecordBatch.from_arrays([pa.array([b.number], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["block", "bytes", "packed"])


def unpacked_block(number: int, blob: bytes) -> Block:
    ids, held, lengths, gaps, count, ranks = unpack_arrays(blob)
    order = np.argsort(-count.astype(np.int64), kind="stable")
    return Block(number, ids.view(np.int64), held, lengths.astype(np.int64), np.cumsum(gaps, dtype=np.uint64), order[ranks])


def blocks(docs: DataFrame, parts: int, part: int, buckets: int) -> DataFrame:
    """Tokenised documents, some megabytes of text a row."""
    most = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, lengths, tokens, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            vocabulary, token = np.unique(np.concatenate(tokens), return_inverse=True)
            own = (np.asarray(ids, dtype=np.int64), np.asarray(held, dtype=np.uint8), np.asarray(lengths, dtype=np.int64))
            return packed_block(Block(number, *own, vocabulary, token), size)

        end = np.asarray([END], dtype=np.uint64)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                own = word_hashes((raw or b"").lower().split())
                ids.append(doc_id or 0)
                held.append(2 if doc_id is None else int(zlib.crc32(str(doc_id).encode()) % parts == part))
                lengths.append(len(own) + 1)
                tokens += [own, end]
                size += len(raw or b"")
                if size >= most:
                    yield flush()
                    ids, held, lengths, tokens, size = [], [], [], [], 0
                    number += 1
        if ids:
            yield flush()

    return materialize(docs.mapInArrow(run, BLOCK), "blocks", "block", buckets)


class Level(NamedTuple):
    """The distinct n-grams of a block at one level, sorted by the numbers of their contexts and words."""

    context: np.ndarray  # places in the level below; none for words
    word: np.ndarray  # places in the vocabulary
    at: np.ndarray  # of each token, its n-gram's place; -1 where the document has begun too late
    count: np.ndarray  # learnt from
    shard: np.ndarray
    order: np.ndarray  # places by shard


def by_shard(shard: np.ndarray) -> np.ndarray:
    small = shard.astype(np.uint16) if len(shard) == 0 or shard.max() < 1 << 16 else shard
    return np.argsort(small, kind="stable")


def gram_shard(context: np.ndarray, word: np.ndarray, count: np.ndarray, shards: int, salt_count: int) -> np.ndarray:
    """The shard that numbered the context, and by a salt of the word as many more as its count asks for; blocks agree."""
    salts = np.uint64(1) << np.ceil(np.log2(np.maximum(count / salt_count, 1))).astype(np.uint64)
    return ((context + (_mixed(word) & (salts - np.uint64(1)))) % np.uint64(shards)).astype(np.int64)


def packed_contexts(numbers: np.ndarray, shard: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising numbers as gaps of their places in the shard that numbered them, and how far that one is from `shard`."""
    n = np.uint64(shards)
    return np.diff(numbers // n, prepend=np.uint64(0)), ((np.uint64(shard) + n - numbers % n) % n).astype(np.uint32)


def unpacked_contexts(gaps: np.ndarray, away: np.ndarray, shard: int, shards: int) -> np.ndarray:
    n = np.uint64(shards)
    return np.cumsum(gaps, dtype=np.uint64) * n + (np.uint64(shard) + n - away) % n


class Walk:
    """A block's n-grams, one level after another; each needs the answers to the one below."""

    def __init__(self, block: Block, shards: int, salt_count: int, stored: bool = False):
        """`stored`: a stored model answers, whose places needn't rise."""
        self.block, self.shards, self.salt_count, self.stored = block, shards, salt_count, stored
        self.place = np.arange(len(block.tokens)) - np.repeat(np.cumsum(block.lengths) - block.lengths, block.lengths)
        self.learnt = np.repeat(block.held == 0, block.lengths)
        shard = (_mixed(block.vocabulary) % np.uint64(shards)).astype(np.int64)
        self.level = Level(block.tokens[:0], np.arange(len(block.vocabulary)), block.tokens, self._counts(block.tokens, len(block.vocabulary)), shard, by_shard(shard))
        self.above = 1

    def _counts(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[self.learnt & (at >= 0)], minlength=n).astype(np.uint32)

    def ask(self) -> pa.RecordBatch:
        """A message to each shard that has n-grams of this level."""
        level, order = self.level, self.level.order
        shard = level.shard[order]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, dtype=np.int64)
        blobs = []
        for own in np.split(order, cuts[1:]) if len(cuts) else []:
            if self.above == 1:
                blobs.append(pack_arrays(np.diff(self.block.vocabulary[own], prepend=np.uint64(0)), level.count[own]))
                continue
            context = level.context[own]
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            runs = np.diff(np.append(first, len(own))).astype(np.uint32)
            mine = context[first]
            names = packed_contexts(self.numbers[mine], int(level.shard[own[0]]), self.shards)
            blobs.append(pack_arrays(*names, runs, self.totals[mine], self.words[level.word[own]], level.count[own]))
        n = len(cuts)
        columns = [pa.array(np.full(n, self.block.number)), pa.array(shard[cuts].astype(np.int32)), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "shard", "packed"])

    def heard(self, answers: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
        """The answers to this level, in the order of its n-grams: codes, and totals and numbers if they were sent."""
        columns: dict[str, list[np.ndarray]] = {"code": [], "total": [], "number": []}
        for shard, blob in sorted(answers, key=lambda x: x[0]):
            values, of, total, gaps = unpack_arrays(blob)
            columns["code"].append(values[of])
            if len(gaps):
                places = gaps if self.above == 1 or self.stored else np.cumsum(gaps, dtype=np.uint64)
                columns["total"].append(total)
                columns["number"].append(places.astype(np.uint64) * np.uint64(self.shards) + np.uint64(shard))
        out = {}
        for name, parts in columns.items():
            if parts and sum(map(len, parts)):
                whole = np.concatenate(parts)
                out[name] = np.empty_like(whole)
                out[name][self.level.order] = whole
        return out

    def up(self, totals: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Go on to the next level, given what this one's shards said; the totals of the contexts of its n-grams."""
        # In order of numbers, so that what is sent rises.
        order = np.argsort(numbers)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        at = np.where(self.level.at >= 0, place[self.level.at], -1)
        self.numbers, self.totals = numbers[order], totals[order]
        if self.above == 1:
            self.words, self.tokens = self.numbers, at
            before = np.roll(at, 1)
            before[self.place == 0] = place[np.searchsorted(self.block.vocabulary, np.uint64(END))]
        else:
            before = np.where(self.place >= self.above - 1, np.roll(at, 1), -1)
        some = np.flatnonzero(before >= 0)
        v = len(self.words)
        pairs, found = np.unique(before[some] * v + self.tokens[some], return_inverse=True)
        at = np.full(len(before), -1)
        at[some] = found
        context, word = pairs // v, pairs % v
        shard = gram_shard(self.numbers[context], self.words[word], self.totals[context], self.shards, self.salt_count)
        self.level = Level(context, word, at, self._counts(at, len(pairs)), shard, by_shard(shard))
        self.above += 1
        return self.totals[context]


#: The number that no block has, for rows of the model.
MODEL_BLOCK = -1
ANSWER = "block long, shard int, level int, packed binary, n long, v long"


def answer_table(rows: pa.Table, level: int, blobs: list[bytes], n: int = 0, v: int = 0) -> pa.Table:
    """A row to each block; the first one carries what the shard adds to sums over all shards."""
    many = rows.num_rows
    sums = [pa.array([x, *[0] * (many - 1)][:many], pa.int64()) for x in (n, v)]
    return pa.Table.from_arrays([rows["block"], rows["shard"], pa.array([level] * many, pa.int32()), pa.array(blobs, pa.binary()), *sums], [x.split()[0] for x in ANSWER.split(", ")])


def packed_answer(codes: np.ndarray, total: np.ndarray | None = None, places: np.ndarray | None = None) -> bytes:
    """Codes by a dictionary, the most frequent first; totals and places, or gaps between them, if later levels need them."""
    values, of, counts = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.uint16)
    rank[order] = np.arange(len(order))
    none = np.zeros(0, dtype=np.uint32)
    return pack_arrays(values[order], rank[of], none if total is None else total, none if places is None else places.astype(np.uint32))


def kept(answers: pa.Table, arrays: list[np.ndarray]) -> pa.Table:
    """The answers, and a row for no block with this shard's part of the trie."""
    row = [MODEL_BLOCK, answers["shard"][0].as_py(), answers["level"][0].as_py(), pack_arrays(*arrays), 0, 0]
    return pa.concat_tables([answers, pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, answers.schema, strict=True)], answers.column_names)])


def answer_words(rows: pa.Table, keep: bool = False) -> pa.Table:
    """Counts of words over all blocks, and their places in this shard, frequent words first."""
    parts = [unpack_arrays(x.as_py()) for x in rows["packed"]]
    ends = np.cumsum([len(x[0]) for x in parts])[:-1]
    known, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([x[1] for x in parts])).astype(np.uint64)
    place = np.empty(len(total), dtype=np.int64)
    place[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(total))
    none = np.zeros(0, dtype=np.uint16)
    blobs = [packed_answer(none, total[x], place[x]) for x in np.split(at, ends)]
    answers = answer_table(rows, 1, blobs, int(total.sum()), int((total > 0).sum()))
    some = total > 0
    numbered = np.asarray([len(total)], dtype=np.uint64)
    return kept(answers, [numbered, total[some], place[some], *EliasFano(known[some], 1 << 64).stored()]) if keep else answers


def answer_grams(rows: pa.Table, level: int, last: bool, shards: int, keep: bool = False) -> pa.Table:
    """Build this shard's part of a level of the trie and look the blocks' n-grams up in it."""
    parts = [unpack_arrays(x.as_py()) for x in rows["packed"]]
    shard = rows["shard"][0].as_py()
    asked = np.concatenate([unpacked_contexts(x[0], x[1], shard, shards) for x in parts])
    contexts, of = np.unique(asked, return_inverse=True)
    of_context = np.zeros(len(contexts))
    of_context[of] = np.concatenate([x[3] for x in parts])
    words = np.concatenate([x[4] for x in parts]).astype(np.uint64)
    if len(contexts) >> (64 - WORD_BITS) or int(words.max(initial=0)) >> WORD_BITS:
        raise ValueError("more contexts or words than a key has bits for")
    keys = np.repeat(of.astype(np.uint64), np.concatenate([x[2] for x in parts])) << np.uint64(WORD_BITS) | words
    learnt = np.concatenate([x[5] for x in parts])
    ends = np.cumsum([len(x[4]) for x in parts])[:-1]
    del parts, words, asked
    known, at = np.unique(keys, return_inverse=True)
    del keys
    total = np.bincount(at, weights=learnt, minlength=len(known))
    context, word = (known >> np.uint64(WORD_BITS)).astype(np.int64), known & np.uint64((1 << WORD_BITS) - 1)
    del known
    some = total > 0
    trie = Trie(contexts[context[some]], word[some], total[some] / (of_context[context[some]] + MU))
    codes, total = trie.look_up(contexts, context, word), total.astype(np.uint64)
    # The n-grams of a message rise, and so do their places.
    more = [() if last else (total[x], np.diff(x, prepend=0)) for x in np.split(at, ends)]
    answers = answer_table(rows, level, [packed_answer(codes[x], *y) for x, y in zip(np.split(at, ends), more, strict=True)])
    numbered, none = np.asarray([len(total)], dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    entries = [none, none] if last else [total[some], np.flatnonzero(some).astype(np.uint64)]
    return kept(answers, [numbered, *entries, *trie.stored()]) if keep else answers


def stored_answer(rows: pa.Table, model: pa.Table, level: int, last: bool, shards: int) -> pa.Table:
    """What a shard's stored part of the trie has on the blocks' n-grams. Those that it lacks get places beyond its own,
    that no n-gram of the model has; a block asks a shard once, so each of them has a place of its own there."""
    if not rows.num_rows:
        return answer_table(rows, level, [])
    shard, blobs = rows["shard"][0].as_py(), []
    arrays = unpack_arrays(model["packed"][0].as_py()) if model.num_rows else None
    numbered = int(arrays[0][0]) if arrays else 0
    trie = (EliasFano.restored(*arrays[3:]) if level == 1 else Trie.restored(*arrays[3:])) if arrays else None
    for x in map(unpack_arrays, rows["packed"].to_pylist()):
        n = len(x[0]) if level == 1 else len(x[4])
        at = np.full(n, -1)
        if level == 1 and trie:
            hashes = np.cumsum(x[0], dtype=np.uint64)
            found = trie.successor(hashes, np.zeros(n, dtype=np.int64), np.full(n, trie.n))
            some = np.flatnonzero(found < trie.n)
            some = some[trie.access(found[some]) == hashes[some]]
            at[some] = found[some]
        elif trie:
            contexts = unpacked_contexts(x[0], x[1], shard, shards)
            at = trie.find(contexts, np.repeat(np.arange(len(contexts)), x[2]), x[4].astype(np.uint64))
        some, codes = at >= 0, np.zeros(0 if level == 1 else n, dtype=np.uint16)
        total, place = np.zeros(n, dtype=np.uint64), np.uint64(numbered) + np.arange(n, dtype=np.uint64)
        if some.any():
            if level > 1:
                codes[some] = trie.codes[at[some]]
            if not last:
                total[some], place[some] = arrays[1][at[some]], arrays[2][at[some]]
        blobs.append(packed_answer(codes) if last else packed_answer(codes, total, place))
    return answer_table(rows, level, blobs)


def walked(block: pa.Table, answers: pa.Table, shards: int, salt_count: int, stored: bool = False) -> Iterator[tuple[Walk, dict[str, np.ndarray]]]:
    """The block's levels from the first one on, with the shards' answers where they are there."""
    walk = Walk(unpacked_block(block["block"][0].as_py(), block["packed"][0].as_py()), shards, salt_count, stored)
    heard: dict[int, list] = {}
    for level, shard, blob in zip(answers["level"].to_pylist(), answers["shard"].to_pylist(), answers["packed"].to_pylist(), strict=True):
        heard.setdefault(level, []).append((shard, blob))
    del answers
    while True:
        got = walk.heard(heard.pop(walk.above, []))
        yield walk, got
        if "number" not in got:
            return
        walk.up(got["total"], got["number"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, part: int = 1, order: int = ORDER) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32 of the id leaves another remainder than `part`; scores all whole texts by
    n-grams of up to `order` words (2 or more). Tokens are words in lower case (A-Z) and one end; a null or empty text
    is its end alone. A row without an id is scored, not learnt from, and its held_out is false. Repeated rows each
    count, with one text or several. If nothing is learnt, every token has the probability of an unknown one. An empty
    table gives no rows; other columns are ignored. Words are told apart by 64 bits of hash, n-grams by the numbers of
    their context and word.
    """
    docs = id_text(df, id_col, text_col)
    tokenised, heard, model = _learnt(docs, parts, part, order, keep=False)
    return _scored(tokenised, heard, model)


class Model(NamedTuple):
    """A learnt model: rows (shard, level, packed) of the trie, a row for each shard and level, and how it was cut."""

    levels: DataFrame
    order: int
    shards: int
    salt_count: int
    total: int  # training tokens
    types: int  # distinct ones


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, part: int = 1, order: int = ORDER) -> Model:
    """The model that `score` learns from the same rows, kept as a table in the shared folder.

    Words keep their counts, so that their probabilities are exact; longer n-grams keep quantised ones.
    """
    return _learnt(id_text(df, id_col, text_col), parts, part, order, keep=True)[2]


def score_with(model: Model, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `score` returns, for the rows of any table by a model learnt before. Nothing is learnt from them: held_out is true
    but for rows without an id. Nulls, empty and repeated rows are as in `score`; an empty table gives no rows."""
    prepare(df.sparkSession)
    shards, order = model.shards, model.order
    tokenised = blocks(id_text(df, id_col, text_col), 1, 0, shuffle_partitions(df.sparkSession))

    def answer(asked: DataFrame, level: int) -> DataFrame:
        stored = model.levels.where(F.col("level") == level).groupBy("shard")
        run = lambda rows, own: stored_answer(rows, own, level, level == order, shards)
        return asked.groupBy("shard").cogroup(stored).applyInArrow(run, ANSWER)

    heard = None
    for level in range(1, order + 1):
        asked = _asked(tokenised, heard, shards, model.salt_count, stored=True)
        found = materialize(answer(asked, level), f"level-{level}")
        heard = found if heard is None else heard.unionByName(found)
    return _scored(tokenised, heard, model, stored=True)


def _asked(tokenised: DataFrame, heard: DataFrame | None, shards: int, salt_count: int, stored: bool = False) -> DataFrame:
    """The blocks' messages to the shards of the first level that they haven't heard of."""
    message = "block long, shard int, packed binary"

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield Walk(unpacked_block(number, blob), shards, salt_count).ask()

    def ask_grams(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
        for walk, _ in walked(block, answers, shards, salt_count, stored):
            pass
        return pa.Table.from_batches([walk.ask()])

    if heard is None:
        return tokenised.select("block", "packed").mapInArrow(ask_words, message)
    return tokenised.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(ask_grams, message)


def _learnt(docs: DataFrame, parts: int, part: int, order: int, keep: bool) -> tuple[DataFrame, DataFrame, Model]:
    """The blocks, the shards' answers to them, and the model, whose rows are there if `keep`."""
    if order < 2:
        raise ValueError("order is at least 2")
    spark = docs.sparkSession
    prepare(spark)
    tokenised = blocks(docs, parts, part, shuffle_partitions(spark))
    shards = max(shuffle_partitions(spark), -(-(tokenised.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    salt_count = SALT_COUNT

    def grams_of(level: int):
        return lambda rows: answer_grams(rows, level, level == order, shards, keep)

    asked = _asked(tokenised, None, shards, salt_count)
    found = materialize(asked.groupBy("shard").applyInArrow(lambda rows: answer_words(rows, keep), ANSWER), "level-1")
    total, types = (x or 0 for x in found.agg(F.sum("n"), F.sum("v")).first())
    answers = F.col("block") != MODEL_BLOCK
    levels, heard = found.where(~answers), found.where(answers) if keep else found
    for level in range(2, order + 1):
        asked = _asked(tokenised, heard, shards, salt_count)
        found = materialize(asked.groupBy("shard").applyInArrow(grams_of(level), ANSWER), f"level-{level}")
        levels, heard = levels.unionByName(found.where(~answers)), heard.unionByName(found.where(answers) if keep else found)
    return tokenised, heard, Model(levels.select("shard", "level", "packed"), order, shards, salt_count, total, types)


def _scored(tokenised: DataFrame, heard: DataFrame, model: Model, stored: bool = False) -> DataFrame:
    """Sums over the tokens of each document, by the shards' answers."""
    shards, salt_count, total, types = model.shards, model.salt_count, model.total, model.types

    def add_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORED.split(", ")]
        if not block.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2), strict=True)})
        below = None
        for walk, got in walked(block, answers, shards, salt_count, stored):
            if walk.above == 1:
                b = walk.block
                start = np.cumsum(b.lengths) - b.lengths
                known = np.add.reduceat((got["total"] > 0)[b.tokens].astype(np.int64), start)
                p = ((got["total"] + 0.5) / (total + 0.5 * (types + 1)))[b.tokens]
                base = np.add.reduceat(np.log10(p), start)
            else:
                backoff, at = MU / (walk.totals[walk.level.context] + MU), walk.level.at
                p = np.where(at >= 0, np.minimum(restored(got["code"])[at] + backoff[at] * p, 1.0), p) if len(backoff) else p
            below = walk
        b = below.block
        sums = (pa.array(known), pa.array(np.full(len(b.ids), total)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), start)))
        return pa.Table.from_arrays([pa.array(b.ids, mask=b.held == 2), pa.array(b.held == 1), pa.array(b.lengths), *sums], names)

    return tokenised.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(add_up, SCORED)
