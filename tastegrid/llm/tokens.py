"""Token counts by a public tokenizer: byte-balanced batches of distinct units cut at safe boundaries."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_bytes, id_text, prepare, slices

#: Bytes of text whose units are looked up together.
BATCH_BYTES = 4 << 20
#: Units in each of the two generations that a worker keeps between batches.
CACHE_UNITS = 300_000
#: Words encoded as one text, each after a space.
RUN_WORDS = 1000

# Everything that some regex engine may take for white space.
_BLANK = "\\s\u180e\u200b\ufeff"
_TIGHT = re.compile(f"[{_BLANK}][ \\n]|\\n[{_BLANK}]")
# Latin letters and a tail of punctuation never share a token, and no added token has this shape.
_STEM = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?|&*#$%]+)")
_GRAPHIC = re.compile("[!-~]+").fullmatch
_CUT = re.compile(f"(?<=[^{_BLANK}])(?=[ \\t\\n\\r\\f\\v])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class UnitEncoder:
    """Encodes texts as a concatenation of units.

    The tokenizer's pre-tokenizer never puts a non-blank and a following blank in one token, nor looks behind,
    so a text may be cut there: the tokens of the pieces are the tokens of the text. Each distinct unit
    (a word with its leading blank) is encoded once; `values(ids, cuts)` says what is kept of ids between each two
    cuts, `join` puts values together.

    Units are named by keys: a word stands for itself after a space, a line feed and a word for just that, and two
    line feeds and any text for that text alone.
    """

    def __init__(self, path: str, values, join):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.values, self.join = Tokenizer.from_file(path), values, join
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # tokens that begin with a space
        self.spaced[[i for x, i in vocabulary.items() if x[:1] == "\u0120"]] = True
        self.now: dict[str, object] = {}
        self.old: dict[str, object] = {}

    @staticmethod
    def _parts(key: str) -> tuple[str, str] | None:
        """Two keys whose values joined are the key's."""
        if key[:1] == "\n" != key[1:2]:
            return "\n\n\n", f"\n\n{key[1:]}"
        bare = key[:2] == "\n\n"
        found = _STEM.fullmatch(key, 2 if bare else 0)
        return (f"\n\n{found[1]}" if bare else found[1], f"\n\n{found[2]}") if found else None

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text's begin, with the end as the last cut."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cuts = np.cumsum([0, *map(len, found)])
        return np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(cuts[-1])), cuts

    def _words(self, words: list[str]) -> list:
        """Values of words without blanks, encoded in runs: a word begins at each token that begins with a space."""
        runs = [f" {' '.join(words[i : i + RUN_WORDS])}" for i in range(0, len(words), RUN_WORDS)]
        ids, _ = self._ids(runs)
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(words) or (len(at) and at[0]):
            return self.values(*self._ids([f" {x}" for x in words]))  # a vocabulary of another kind
        return self.values(ids, np.append(at, len(ids)))

    def _learn(self, keys: set[str]) -> None:
        now, old, single, parted = self.now, self.old, set(), []
        for key in keys:
            if key in old:
                now[key] = old[key]
            elif key.isalpha():
                single.add(key)
            elif parts := self._parts(key):
                parted.append((key, parts))
            else:
                single.add(key)
        for key in {x for _, parts in parted for x in parts}.difference(now):
            if key in old:
                now[key] = old[key]
            else:
                single.add(key)
        words, others = [], []
        for key in single:
            (words if key.isalpha() or _GRAPHIC(key) else others).append(key)
        for a, b in slices(words, [len(x) + 1 for x in words], BATCH_BYTES):
            now.update(zip(words[a:b], self._words(words[a:b]), strict=True))
        for a, b in slices(others, [len(x) + 1 for x in others], BATCH_BYTES):
            texts = [x[2:] if x[:2] == "\n\n" else f" {x}" for x in others[a:b]]
            now.update(zip(others[a:b], self.values(*self._ids(texts)), strict=True))
        for key, (a, b) in parted:
            now[key] = self.join((now[a], now[b]))

    def __call__(self, texts: list[str]) -> list:
        if len(self.now) > CACHE_UNITS:  # rare units go, frequent ones come back
            self.old, self.now = self.now, {}
        known, docs, missing = self.now.get, [], set()
        for text in texts:
            if _TIGHT.search(text):
                keys = [f"\n\n{x}" for x in _CUT.split(text)]
            else:
                keys = text.replace("\n", " \n").split(" ")
                keys[0] = f"\n\n{keys[0]}"
            found = list(map(known, keys))
            miss = [i for i, x in enumerate(found) if x is None]
            missing.update([keys[i] for i in miss])
            docs.append((keys, found, miss))
        self._learn(missing)
        out = []
        for keys, found, miss in docs:
            for i in miss:
                found[i] = self.now[keys[i]]
            out.append(self.join(found))
        return out


_encoders: dict[tuple[str, str], UnitEncoder] = {}


def _lengths(ids: np.ndarray, cuts: np.ndarray) -> list[int]:
    return np.diff(cuts).tolist()


def _bytes(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    raw, at = ids.tobytes(), (4 * cuts).tolist()
    return [raw[a:b] for a, b in pairwise(at)]


def length_encoder(path: str) -> UnitEncoder:
    if (path, "n") not in _encoders:
        _encoders[path, "n"] = UnitEncoder(path, _lengths, sum)
    return _encoders[path, "n"]


def ids_encoder(path: str) -> UnitEncoder:
    """Ids as little-endian unsigned 32-bit bytes."""
    if (path, "ids") not in _encoders:
        _encoders[path, "ids"] = UnitEncoder(path, _bytes, b"".join)
    return _encoders[path, "ids"]


def encoded(encode: UnitEncoder, raw: list[bytes | None]) -> Iterator:
    """What `encode` makes of each text, in order; null is the empty text."""
    for a, b in slices(raw, [len(x or b"") for x in raw], BATCH_BYTES):
        yield from encode([(x or b"").decode("utf-8", "replace") for x in raw[a:b]])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Whole texts are counted, exactly as the tokenizers library counts them without added special tokens.
    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each;
    an empty table gives no rows; other columns are ignored. `tokenizer` is the path of a byte-level BPE file
    that every executor can open (by default that of the installed public_tokenizers package).
    """
    prepare(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = length_encoder(tokenizer or default_path())
        for batch in batches:
            raw = column_bytes(batch, "text")
            n = list(encoded(encode, raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or b"") for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(df, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
