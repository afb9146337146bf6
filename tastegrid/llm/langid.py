"""Language ID with string kernels: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest ridge."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column_bytes, materialize, prepare

#: n-grams of 1 to 3 bytes; their numbers in one table.
GRAMS = 256 + 65536 + (1 << 24)
#: Bounds of the training sample: documents a language, of which landmarks, and bytes of a document.
PER_LANGUAGE, LANDMARKS, SAMPLE_BYTES = 300, 32, 65536
RIDGE, SHARPNESS, BATCH = 1e-2, 5.0, 64


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # numbers of all n-grams that landmarks hold
    landmarks: np.ndarray  # landmarks by n-grams, rows of unit length
    weights: np.ndarray  # landmarks by languages
    bias: np.ndarray


def gram_numbers(raw: bytes) -> np.ndarray:
    """Numbers of all n-grams of a text in lower case (A-Z)."""
    x = np.frombuffer(raw.lower(), dtype=np.uint8).astype(np.int32)
    two = (x[:-1] << 8) | x[1:]
    three = (two[:-1] << 8) | x[2:] if len(x) > 2 else x[:0]
    return np.concatenate([x, two + 256, three + (256 + 65536)])


class Presence:
    """Texts as unit vectors over all n-grams, 1 for each that is present, normalised.

    Only the coordinates that landmarks have are kept, the others add nothing to a product with a landmark; but a
    text's length counts all its n-grams, so that products are the kernel of both texts.
    """

    def __init__(self, grams: np.ndarray):
        self.n = len(grams)
        self.column = np.full(GRAMS, self.n, dtype=np.int32)
        self.column[grams] = np.arange(self.n, dtype=np.int32)
        self.last = np.zeros(GRAMS, dtype=np.int32)

    def distinct(self, numbers: np.ndarray) -> int:
        """How many different ones there are: each counts where it was seen last."""
        at = np.arange(len(numbers), dtype=np.int32)
        self.last[numbers] = at
        return int((self.last[numbers] == at).sum())

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.n + 1), dtype=np.float32)
        length = np.zeros(len(texts), dtype=np.float32)
        for i, raw in enumerate(texts):
            numbers = gram_numbers(raw)
            out[i][self.column[numbers]] = 1
            length[i] = self.distinct(numbers)
        return out[:, : self.n] / np.sqrt(np.maximum(length, 1))[:, None]


def fit(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The first `landmarks` texts of each language span the Nyström map; all texts train the ridge."""
    languages = sorted(set(labels))
    label = np.asarray([languages.index(x) for x in labels], dtype=np.int64)
    marks = [i for k in range(len(languages)) for i in np.flatnonzero(label == k)[:landmarks]]
    grams = np.unique(np.concatenate([np.unique(gram_numbers(texts[i])) for i in marks])) if marks else np.zeros(0, dtype=np.int64)
    presence = Presence(grams)
    at = presence([texts[i] for i in marks])
    value, vector = np.linalg.eigh((at @ at.T).astype(np.float64)) if marks else (np.zeros(0), np.zeros((0, 0)))
    keep = value > 1e-6 * max(value.max(initial=0), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.concatenate([presence(texts[i : i + BATCH]) @ at.T for i in range(0, len(texts), BATCH)]) @ root if marks else np.zeros((0, 0))
    goal = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.maximum(np.bincount(label, minlength=len(languages)), 1)[label] if len(label) else np.zeros(0)
    weight = weight / weight.sum() if len(weight) else weight
    mean, bias = weight @ phi, weight @ goal
    centred = phi - mean
    coef = np.linalg.solve(centred.T @ (centred * weight[:, None]) + ridge / 10 * np.eye(phi.shape[1]), centred.T @ ((goal - bias) * weight[:, None]))
    return Model(languages, grams, at, (root @ coef).astype(np.float32), (bias - mean @ coef).astype(np.float32))


def scores(model: Model, presence: Presence, texts: list[bytes]) -> np.ndarray:
    """Kernel rows times weights, as shares that add up to 1."""
    if not model.languages:
        return np.zeros((len(texts), 0))
    found = SHARPNESS * ((presence(texts) @ model.landmarks.T) @ model.weights + model.bias).astype(np.float64)
    found = np.exp(found - found.max(axis=1, keepdims=True))
    return found / found.sum(axis=1, keepdims=True)


def training_sample(df: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int, sample_bytes: int) -> tuple[list[bytes], list[str]]:
    """At most `per_language` labelled texts of each language, of at most `sample_bytes` bytes, by a hash of their id.

    Rows that repeat an id and a label teach one text, the first in order of code points. Ids are first thinned by
    hash to about 4 * per_language + 64 a language, so that no task orders a number of them that grows with the
    table; the odds that fewer than per_language are left, which would make the sample smaller, are under e**-100 at the default.
    """
    rows = df.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= sample_bytes) & (F.octet_length(text_col) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("its_id"), F.col(text_col).alias("text"))
    ids = materialize(rows.select("lang", "its_id").distinct().withColumn("h", F.xxhash64(F.lit(3), "its_id")), "sample-ids")
    # One row a language.
    many = ids.groupBy("lang").agg(F.count("*").alias("many"))
    share = F.col("h") / F.lit(2.0**64) + 0.5
    near = ids.join(F.broadcast(many), "lang").where(share * F.col("many") <= 4 * per_language + 64)
    order = F.row_number().over(W.partitionBy("lang").orderBy("h", "its_id"))
    ids = near.select("lang", "its_id", "h").withColumn("n", order).where(F.col("n") <= per_language)
    # Bounded by per_language rows a language.
    found = rows.join(F.broadcast(ids), ["lang", "its_id"]).groupBy("lang", "n").agg(F.min("text").alias("text")).orderBy("lang", "n").collect()
    return [r["text"].encode() for r in found], [r["lang"] for r in found]


def held_out(id_col: str | Column, parts: int, part: int) -> Column:
    """Whether the crc32 of an id as text leaves remainder `part`; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % parts == part


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, part: int = 1, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1), and the columns in `keep`.

    Learns from the texts and labels of documents that are not held out; rows without an id, text or label teach
    nothing, nor do texts of over SAMPLE_BYTES bytes. Every whole text is classified, by its bytes alone. A text
    that is null or has no letter is `und` with score 0, as is every text if no label could be learned. held_out
    is false for a null id. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"), *([F.struct(*[df[c] for c in keep]).alias("kept")] if keep else []))
    model = spark.sparkContext.broadcast(fit(*training_sample(rows, ~held_out("doc_id", parts, part), "doc_id", "text", "lang", per_language, SAMPLE_BYTES), landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, m = regex.compile(r"\p{L}"), model.value
        presence = Presence(m.grams)
        for batch in batches:
            raw = column_bytes(batch, "text")
            some = [i for i, x in enumerate(raw) if x and letter.search(x.decode("utf-8", "replace"))] if m.languages else []
            lang, score = ["und"] * len(raw), [0.0] * len(raw)
            for a in range(0, len(some), BATCH):
                own = some[a : a + BATCH]
                found = scores(m, presence, [raw[i] for i in own])
                for i, k, s in zip(own, found.argmax(axis=1).tolist(), found.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = m.languages[k], s
            at = [0, 2, *([3] if keep else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", *["kept"] * bool(keep), "lang_pred", "score"])

    rows = rows.withColumn("lang", F.coalesce(held_out("doc_id", parts, part), F.lit(False)))
    kept = f", kept {rows.schema['kept'].dataType.simpleString()}" if keep else ""
    out = rows.mapInArrow(run, f"doc_id long, held_out boolean{kept}, lang_pred string, score double")
    return out.select("doc_id", "held_out", "lang_pred", "score", *([F.col("kept")[c].alias(c) for c in keep] if keep else []))


def accepted(df: DataFrame, min_score: float = 0.3, **options) -> DataFrame:
    """The rows of `df`, columns unchanged, whose language is recognised with at least `min_score`."""
    own = df.toDF(*[f"own_{c}" for c in df.columns])
    out = identify(own, "own_doc_id", "own_text", "own_lang", keep=own.columns, **options)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*[F.col(f"own_{c}").alias(c) for c in df.columns])
