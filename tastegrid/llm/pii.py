"""PII by weak supervision.

Patterns for four kinds give base spans, which always stay. Looser patterns give candidates that these miss, secrets
among them; regex, gazetteer and context labelers vote on each. Expectation maximisation over the counts of vote
patterns of all candidates estimates how reliable each labeler is and how likely each pattern is personal data. A
logistic span classifier learns these posteriors from the votes and from what labelers don't see: the shape of a span,
its length and digits, the words beside it and its place. It decides which candidates are added.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, id_text, materialize, prepare, release

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)

# Base patterns. Possessive repeats and a look-behind keep them linear in the text: a run of digits that fails from
# its start fails from every later digit too.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beyond the base: written-out addresses, IPv6, cards with other separators or in longer runs of digits,
# phones without a plus, and secrets. All repeats are possessive or of bounded length, so they are linear too.
_AT = re.compile(r"[\x20]?(?:@|\(at\)|\[at\]|\{at\})[\x20]?|[\x20]at[\x20](?=[A-Za-z0-9-]++[\x20]dot[\x20])")
_DOT = r"(?:\.|[\x20]?(?:\(dot\)|\[dot\]|\{dot\})[\x20]?|[\x20]dot[\x20])"
_LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]++(?![0-9A-Za-z.])")
_CARD_LIKE = re.compile(
    r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){3}|[0-9]{4}[\x20./_-][0-9]{6}[\x20./_-][0-9]{5})(?![0-9])"
)
_PHONE_LIKE = re.compile(
    r"(?<![0-9.+-])(?:00[1-9][0-9]{1,3}(?:[\x20./-][0-9]{2,8}){1,5}"
    r"|(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
    r"|0[1-9][0-9]{1,4}[\x20/-][0-9]{3,8}(?:[\x20-][0-9]{2,6}){0,3})(?![0-9-])"
)
_SECRET_LIKE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_=])")
_HINT = re.compile(r"[0-9@]|[(\[{]at[)\]}]|\x20dot\x20")

#: What stands shortly before personal data of each kind, and before other numbers.
CONTEXT = (
    re.compile(r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\W*(?:to|at|me)?\W*$", re.I),
    re.compile(r"\b(?:ip|ipv6|address|host|server|client|login|adresse)\W*$", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte)\W*(?:number|no|nr)?\W*$", re.I),
    re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|telefon|tel[eé]fono|t[eé]l[eé]phone)\W*(?:me|us)?\W*(?:number|no|nr|at)?\W*$", re.I),
    re.compile(r"\b(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|auth)\W*$", re.I),
)
OTHER = re.compile(
    r"\b(?:order|invoice|id|ref|reference|isbn|version|serial|part|case|article|page|commit|sha1|sha256|md5|checksum|digest"
    r"|hash|uuid|etag|revision|build|tracking)\W*(?:number|no|nr)?\W*$",
    re.I,
)
#: Ends of domains, prefixes of card issuers and of secrets that the gazetteers know.
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu example test".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
SECRET_PREFIXES = ("AKIA", "AIza", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "eyJ")
CONTEXT_CHARS = 32
#: Different candidates that train the classifier: about so many at most, those of the smallest hashes.
TRAIN_CANDIDATES = 20_000


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind and start; matches whose parts, digits or checksum fail are dropped."""
    out = [Span(0, a, b) for a, b in _emails(text)]
    out += [Span(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [Span(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [Span(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
        done = found.end() if found else m.end()
        if found:
            yield start, done


def _ipv6(text: str) -> Iterator[tuple[int, int]]:
    for m in _COLONS.finditer(text):
        if m[0].count(":") >= 2 and m.end() - m.start() <= 39 and any("0" <= c <= "9" for c in m[0]):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            yield m.start(), m.end()


def loose_spans(text: str) -> Iterator[Span]:
    """Matches of the looser patterns, by kind and start."""
    found = {
        EMAIL: _loose_emails(text) if "@" in text or "at" in text else (),
        IP: _ipv6(text) if "::" in text or ":" in text else (),
        CARD: (m.span() for m in _CARD_LIKE.finditer(text)),
        PHONE: (m.span() for m in _PHONE_LIKE.finditer(text)),
        SECRET: (m.span() for m in _SECRET_LIKE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])),
    }
    for kind, spans_ in found.items():
        for start, end in spans_:
            yield Span(kind, start, end)


def candidates(text: str, base: list[Span]) -> list[tuple[Span, bool]]:
    """Base spans, and matches of the looser patterns that touch none of them; whether each is a base span."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((x.start, x.end) for x in base):  # joined, so that both lists rise
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out = [(x, True) for x in base]
    for x in loose_spans(text):
        i = bisect_right(ends, x.start)
        if i == len(ends) or starts[i] >= x.end:
            out.append((x, False))
    return out


def votes(text: str, span: Span, strict: bool) -> tuple[int, ...]:
    """(kind, base pattern, gazetteer, context, counter-context, shape): 1 for, -1 against, 0 abstains."""
    found = text[span.start : span.end]
    before, digits = text[max(0, span.start - CONTEXT_CHARS) : span.start], _digits(found)
    if span.kind == EMAIL:
        known = 1 if re.split(r"[.)\]}\s]+", found)[-1].lower() in DOMAINS else -1
        shape = 1 if re.search(r"@|[(\[{]at", found) else 0
    elif span.kind == IP:
        known = 1 if found.lower().startswith(("fe80:", "fc", "fd", "2")) else -1 if found.startswith(("0.", "255.")) else 0
        shape = 1 if ":" in found and len(digits) > 1 or len(set(found.split("."))) > 2 else -1
    elif span.kind == CARD:
        known = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if luhn(digits) else -1
    elif span.kind == PHONE:
        known = 1 if found.startswith(("+", "00")) or digits[-7:-4] == "555" else -1 if digits[-10:-9] in ("0", "1") else 0
        shape = 1 if found.startswith(("(", "+")) else 0
    else:
        known = 1 if found.startswith(SECRET_PREFIXES) else 0
        shape = 1 if len(set(found)) >= 10 and len(digits) >= 3 else -1
    return span.kind, int(strict), known, int(bool(CONTEXT[span.kind].search(before))), -int(bool(OTHER.search(before))), shape


#: Columns of the classifier: kinds, votes for and against, then groups of so many places for what labelers don't see.
GROUPS = {"length": 8, "digits": 5, "parts": 6, "place": 4, "shape": 32, "before": 32, "after": 32}
_VOTE_COLUMNS = len(KINDS) + 2 * 5
COLUMNS = _VOTE_COLUMNS + sum(GROUPS.values())


def _hashed(text: str, places: int) -> int:
    return zlib.crc32(text.encode()) % places


def active(text: str, span: Span, vote: tuple[int, ...]) -> list[int]:
    """The columns that are 1 for a candidate."""
    found = text[span.start : span.end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", found[:64]))))
    before = re.search(r"(\w+)\W*$", text[max(0, span.start - CONTEXT_CHARS) : span.start])
    after = re.match(r"\W*(\w+)", text[span.end : span.end + CONTEXT_CHARS])
    places = {
        "length": min(len(found).bit_length(), 7),
        "digits": 4 * len(_digits(found)) // len(found),
        "parts": min(len(re.findall("[A-Za-z0-9]+", found)), 5),
        "place": min(4 * span.start // max(len(text), 1), 3),
        "shape": _hashed(shape, 32),
        "before": _hashed(before[1].lower() if before else "", 32),
        "after": _hashed(after[1].lower() if after else "", 32),
    }
    out = [span.kind]
    for i, v in enumerate(vote[1:]):
        if v:
            out.append(len(KINDS) + 2 * i + (v < 0))
    at = _VOTE_COLUMNS
    for name, size in GROUPS.items():
        out.append(at + places[name])
        at += size
    return out


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation over vote patterns (-1, 0, 1), given how often each occurs.

    (posterior of each pattern, P(vote | class) as labelers by classes by votes, class prior.) The start takes the
    majority of votes; `prior` counts keep a labeler that is never wrong from being certain.
    """
    n, m = patterns.shape
    posterior = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    table, share = np.full((m, 2, 3), 1 / 3), 0.5
    # Labelers are taken to be better than chance.
    better = np.asarray([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = (weight[1].sum() + prior) / (weight.sum() + 2 * prior)
        for j in range(m):
            for c in range(2):
                table[j, c] = [weight[c][patterns[:, j] == v].sum() + 3 * prior * better[c][v + 1] for v in (-1, 0, 1)]
                table[j, c] /= table[j, c].sum()
        log = np.log([1 - share, share]) + sum(np.log(table[j][:, patterns[:, j] + 1]).T for j in range(m)) if n else np.zeros((0, 2))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if n and np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, table, share


def features(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), COLUMNS))
    for row, columns in zip(out, rows, strict=True):
        row[columns] = 1
    return out


def train(x: np.ndarray, goal: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic classifier by Newton steps; `goal` are probabilities."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (goal - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


VOTES = ("kind", "strict", "known", "context", "other", "shape")


def candidate_table(docs: DataFrame) -> DataFrame:
    """A row for each candidate of all texts: its votes, its active columns and a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in column_bytes(batch, "text"):
                text = (raw or b"").decode("utf-8", "replace")
                if _HINT.search(text):
                    for span, strict in candidates(text, base_spans(text)):
                        v = votes(text, span, strict)
                        near = text[max(0, span.start - CONTEXT_CHARS) : span.end + CONTEXT_CHARS]
                        rows.append((*v, active(text, span, v), zlib.crc32(f"{span.kind} {span.start} {near}".encode())))
            kinds = [*[pa.int32()] * len(VOTES), pa.list_(pa.int32()), pa.int64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*VOTES, "active", "hash"])

    schema = ", ".join(f"{x} int" for x in VOTES) + ", active array<int>, hash long"
    return materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "candidates")


def span_model(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier. Votes are counted over all candidates, at most 5 * 3**5 patterns.

    The classifier learns from about TRAIN_CANDIDATES different ones of them at most, those whose hashes are in the
    lowest share, so that what comes to the driver doesn't grow with the corpus; copies teach once.
    """
    table = candidate_table(docs)
    found = np.asarray(sorted(tuple(r) for r in table.groupBy(*VOTES).count().collect()), dtype=np.int64)
    found = found.reshape(-1, len(VOTES) + 1)
    posterior: dict[tuple[int, ...], float] = {}
    for k in range(len(KINDS)):  # labelers are as reliable as they are on that kind
        own = found[found[:, 0] == k]
        for pattern, p in zip(own, reliabilities(own[:, 1:6], own[:, 6].astype(float))[0], strict=True):
            posterior[tuple(pattern[:6].tolist())] = float(p)
    different = table.agg(F.count_distinct("hash")).first()[0]
    lowest = int(min(1.0, TRAIN_CANDIDATES / max(different, 1)) * (1 << 32))
    one = F.min(F.struct(*VOTES, "active")).alias("one")
    sample = sorted(table.where(F.col("hash") < lowest).groupBy("hash").agg(one).collect())
    release(table)
    goal = np.asarray([posterior[tuple(r["one"][c] for c in VOTES)] for r in sample])
    return train(features([r["one"]["active"] for r in sample]), goal)


def spans(text: str, weights: np.ndarray, threshold: float = 0.5) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by kind and start. Of added spans that overlap, the likelier ones stay."""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    more = [x for x, strict in candidates(text, base) if not strict]
    if not more:
        return base, base
    score = features([active(text, x, votes(text, x, False)) for x in more]) @ weights
    limit = np.log(threshold / (1 - threshold))
    kept: list[tuple[Span, float]] = []
    for x, p in sorted(zip(more, score.tolist(), strict=True), key=lambda y: (y[0].start, -y[1])):
        if p <= limit:
            continue
        if kept and x.start < kept[-1][0].end:
            if p <= kept[-1][1]:
                continue
            kept.pop()
        kept.append((x, p))
    return base, sorted([*base, *(x for x, _ in kept)])


def _listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[x.kind]}:{x.start}:{x.end}" for x in found)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    spans lists all spans, base and added, as kind:start:end in code points; secrets are a fifth kind that is only
    added. A null or empty text has none; null ids stay null; repeated rows are judged alike; an empty table gives no
    rows; other columns are ignored.
    """
    prepare(df.sparkSession)
    docs = id_text(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(span_model(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in column_bytes(batch, "text"):
                base, all_ = spans((raw or b"").decode("utf-8", "replace"), shared.value, threshold)
                n = [0] * len(BASE_KINDS)
                for x in base:
                    n[x.kind] += 1
                rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(all_)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6))], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, found: list[Span]) -> str:
    """`text` with each span replaced by its kind; of overlapping spans the earliest, longest one counts."""
    out, at = [], 0
    for x in sorted(found, key=lambda x: (x.start, -x.end)):
        if x.start >= at:
            out += [text[at : x.start], f"[{KINDS[x.kind].upper()}]"]
            at = x.end
        elif x.end > at:
            at = x.end
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`df` with the spans of its texts replaced; a null text stays null. Columns and rows are kept."""
    prepare(df.sparkSession)
    text = F.col(f"own_{text_col}").cast("string")
    own = df.toDF(*[f"own_{c}" for c in df.columns])
    docs = own.select(F.lit(0).cast("long").alias("doc_id"), text.alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(span_model(docs))
    rest = [f"own_{c}" for c in df.columns if c != text_col]
    rows = own.select(F.lit(0).cast("long").alias("doc_id"), text.alias("text"), F.struct(*rest, F.lit(0).alias("own_")).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in column_bytes(batch, "text"):
                if raw is not None:
                    t = raw.decode("utf-8", "replace")
                    found = spans(t, shared.value, threshold)[1]
                    raw = redact(t, found) if found else t
                out.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], ["text", "rest"])

    found = rows.mapInArrow(run, f"text string, rest {rows.schema['rest'].dataType.simpleString()}")
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[f"own_{c}"].alias(c) for c in df.columns])
