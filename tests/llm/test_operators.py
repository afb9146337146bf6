"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tastegrid.llm import ann, langid, media, mixing, ngram_lm, packing, pii, queries, simhash, substring, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, its_fp string, fp string, starts string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def fixture_rows():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))
    long, shared = text(30_000), " ".join(f"shared{i}" for i in range(60))
    texts = [None, "", " \n\t ", "12345 !!", long, long, text(40), shared, f"{text(20)} {shared} {text(15)}", f"{shared}\n\n  {text(5)}", "a  b  c\td\r\n e", "Mail x@y.com or +1 (555) 123-4567 <|endoftext|> now", "x" * 5000, shared, text(200) + " changed", text(1)]
    near = text(300)
    texts += [near, near.replace("alpha", "Alpha", 1), near + " tail"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 1, "x", None, "y") for i, t in enumerate(texts)]
    return [*rows, (None, shared, "en", "s1", 1, "x", None, "y"), rows[6], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_token_counts(docs, empty):
    t = tokenizer()
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in fixture_rows()), key=repr)
    assert by_row(tokens.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == want
    assert tokens.token_counts(empty).count() == 0


def test_unit_boundaries_on_odd_blanks():
    rng, t, encode = random.Random(1), tokenizer(), tokens.ids_encoder(tokens.default_path())
    parts = ["a", "Word", "it's", " ", "  ", "\n", "\t", " ", "\x1c", "᠎", "!", "...", "9", "<|endoftext|>", "é", "日本", "\r\n", "'s", "|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def brute_substrings(rows):
    """(doc_id, words, removed, sha256 of what is kept) of each row with an id, by a dictionary of windows."""
    words = [(i, (t or "").encode().split()) for i, t in rows if i is not None]
    first = {}
    for i, w in words:
        for p in range(len(w) - 12):
            first[tuple(w[p : p + 13])] = min(i, first.get(tuple(w[p : p + 13]), i))
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, docs, empty, monkeypatch):
    rows = [(r[0], r[1]) for r in fixture_rows()]
    # One id with several texts, one of which an earlier document has.
    rows += [(90, rows[6][1]), (90, "other " * 20), (90, None), (4, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (8 << 20, 3000):
        monkeypatch.setattr(substring, "BLOCK_BYTES", size)
        got = substring.remove_repeated(df).collect()
        assert len(got) == len(rows)
        assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute_substrings(rows)
        assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    kept = substring.remove_repeated(docs, keep_text=True).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in kept)
    assert substring.remove_repeated(empty).count() == 0


def test_sketch_loses_none_and_passes_few(spark, monkeypatch):
    """With a small budget of cells a task, hundreds of blocks and chunks: no repeated window is lost, few others pass."""
    monkeypatch.setattr(substring, "BLOCK_BYTES", 20_000)
    low = 12
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(500))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) + (f" {shared}" if i % 20 == 0 else "") for i in range(400)]
    table = substring.blocks(substring.id_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"), 13, 4)
    many = table.agg({"windows": "sum"}).first()[0]
    bits = substring.sketch_bits(many)
    answers = {}
    for r in substring.sketch_answers(table, 13, bits, low).collect():
        answers.setdefault(r.block, {})[r.chunk] = bytes(r.packed)
    found, once, total = [], 0, 0
    counts = Counter()
    for r in table.collect():
        ids, raw = substring.texts_of(bytes(r.heads), bytes(r.texts))
        _, _, h = substring.windows(ids, raw, 13, 1)
        counts.update(h.tolist())
        found.append((h, substring.estimated_repeated(h, answers[r.block], bits, low)))
    assert len({c for x in answers.values() for c in x}) > 100 and len(answers) > 40
    for h, ok in found:
        again = np.asarray([counts[x] > 1 for x in h.tolist()])
        assert ok[again].all()
        once, total = once + int(ok[~again].sum()), total + int((~again).sum())
    assert once < 0.05 * total


def test_language_id(spark, docs, empty):
    rng = random.Random(2)
    vocab = {"aa": ["the", "with", "house"], "bb": ["der", "und", "straße"], "cc": ["què", "niño", "año"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(3, 40))), k, None, 0, "", "", "") for i, k in enumerate(rng.choices(list(vocab), k=400))]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    # One id on many rows, under two labels, teaches a text a label.
    many = spark.createDataFrame([(3, f"text {i}", "aa" if i % 2 else "bb", None, 0, "", "", "") for i in range(50)] + rows[:20], SCHEMA)
    texts, labels = langid.training_sample(many, langid.F.lit(True), "doc_id", "text", "lang", 300, 65536)
    assert len(texts) == len({(r[0], r[2]) for r in rows[:20]} | {(3, "aa"), (3, "bb")}) and labels == sorted(labels)
    # Thinning by hash before ordering leaves the sample as it is.
    big = spark.createDataFrame([(i, f"text {i}", "aa" if i % 9 else "bb", None, 0, "", "", "") for i in range(4000)], SCHEMA)
    h = {r.doc_id: r.h for r in big.select("doc_id", langid.F.xxhash64(langid.F.lit(3), "doc_id").alias("h")).collect()}
    want = [f"text {i}".encode() for k in (1, 0) for i in sorted((i for i in h if bool(i % 9) == bool(k)), key=h.get)[:40]]
    assert langid.training_sample(big, langid.F.lit(True), "doc_id", "text", "lang", 40, 65536)[0] == want
    odd = langid.identify(docs).collect()
    assert len(odd) == len(fixture_rows()) and {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd)
    assert langid.identify(empty).count() == 0 and langid.accepted(docs).columns == docs.columns


def test_media_round_trip(spark, docs, empty):
    for r in media.text_media(docs, keep_media=True).collect():
        raw = next((t or "").encode() for i, t, *_ in fixture_rows() if i == r.doc_id)
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        m = media.read_media(bytes(r.media))
        assert media.sample_bytes(bytes(r.media), m) == padded and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-32:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert m.codec == "raw" and m.duration == len(padded)
        assert all(bytes(r.media)[k.start : k.start + k.length] == padded[576 * 16 * j : 576 * 16 * j + 576] for j, k in enumerate(r.keyframes))
    assert media.text_media(empty).count() == 0
    whole = media.write_media(b"\1" * 576 * 40)
    rows = spark.createDataFrame([(1, bytearray(whole)), (2, None), (3, bytearray(b"")), (4, bytearray(whole[:90])), (5, bytearray(random.Random(3).randbytes(300)))], "id long, m binary")
    assert {r.id: r.codec for r in media.media_columns(rows, "id", "m").collect()} == {1: "raw", 2: None, 3: None, 4: None, 5: None}


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    rows = fixture_rows()
    assert len(got) == len(rows) and got == mixing.mix(docs.repartition(3)).collect()
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len((t or "").encode().split())
    names = [*sorted(x for x in sizes if x is not None), None]
    goal = dict(zip(names, mixing.targets([sizes[x] for x in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s, n in sizes.items():
        assert abs(taken[n, round(goal[s], 6)] - goal[s]) <= 1
    assert abs(sum(goal.values()) - min(1.5, 2) * sum(sizes.values())) < 1e-6
    times = [r.first_time for r in got if r.first_time is not None]
    assert times == sorted(times)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_demand_is_inverted():
    for knots in mixing.SCHEDULES:
        t, w = zip(*knots, strict=True)
        grid = np.linspace(0, 1, 2001)
        curve = np.interp(grid, t, w)
        area = np.append(0, np.cumsum((curve[1:] + curve[:-1]) / 2 * np.diff(grid)))
        at = mixing.demanded(knots, np.linspace(0, 1, 11))
        assert np.allclose(np.interp(at, grid, area / area[-1]), np.linspace(0, 1, 11), atol=1e-5)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = [r for r in fixture_rows() if r[0] is not None]
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    label = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            label[i] = min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(fixture_rows())
    assert all((r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", label[r.doc_id]) for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_hubs_and_chains(spark, monkeypatch):
    rng = random.Random(9)
    names = rng.sample(range(-(1 << 40), 1 << 40), 330)
    links = [(names[0], x) for x in names[1:200]] + [*zip(names[200:230], names[201:231], strict=True)] + [(names[i], names[i + 1]) for i in range(250, 330, 2)]
    root = {x: x for pair in links for x in pair}
    for _ in range(40):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {(x, r) for x, r in root.items() if x != r}
    rows = spark.createDataFrame([(max(x), min(x)) for x in links], "a long, b long")
    for salts in (2, 64):
        monkeypatch.setattr(simhash, "SALTS", salts)
        assert {tuple(r) for r in simhash.components(rows).collect()} == want


def test_grid_loses_no_near_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    fp = [base]
    for d in range(1, 7):
        flip = np.zeros(300, dtype=np.uint64)
        for row in range(300):
            for b in rng.choice(64, d, replace=False):
                flip[row] |= np.uint64(1) << np.uint64(b)
        fp.append(base ^ flip)
    fp = np.unique(np.concatenate(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    manhattan = np.abs(simhash.popcounts(fp)[:, None].astype(int) - simhash.popcounts(fp)[None].astype(int)).sum(axis=2)
    unary = simhash.thermometer(fp)
    assert (np.bitwise_count(unary[:, None] ^ unary[None]) == manhattan).all() and (manhattan <= np.bitwise_count(fp[:, None] ^ fp[None])).all()
    assert [simhash.grid_groups(n) for n in (0, 10**6, 10**8, 10**9, 10**10, 10**14)] == [6, 6, 7, 8, 9, simhash.MOST_GROUPS]
    for groups in (5, 6, 7, 8):
        cell = simhash.grid_cells(fp, groups)
        node = np.repeat(np.arange(len(fp)), cell.shape[1])
        order = np.argsort(cell.ravel(), kind="stable")
        for small in (0, 32):
            a, b = simhash.cell_links(cell.ravel()[order], fp[node[order]], small=small)
            root = simhash._roots(len(fp), node[order][a], node[order][b])
            assert near[node[order][a], node[order][b]].all()
            assert (root[:, None] == root[None])[near].all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=(1, 16)) + rng.normal(size=(300, 16)) / 30])
    x[40:60] = x[40]
    rows = [(i, [float(v) for v in y], 1) for i, y in enumerate(x.astype(np.float32))]
    rows += [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [float("nan")] * 16, 1), (2150, [], 1), (None, rows[0][1], 1), (2200, [None] * 16, 1), rows[50]]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec_id_2 int")).collect()
    v = np.asarray([r[1] for r in rows[:1000]])
    length, hits = np.linalg.norm(v, axis=1), 0
    queries = [i for i in range(1000) if i % 50 == 0]
    for q in queries:
        s = ann.cosine(np.repeat(v[q : q + 1], 1000, axis=0), v)
        s[q] = -2
        best = np.lexsort((np.arange(1000), -s))[:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - v[q] @ v[r.vec_id] / (length[q] * length[r.vec_id])) < 1e-9 for r in own)
        hits += len({r.vec_id for r in own} & {int(b) for b in best})
    assert hits >= 0.9 * 5 * len(queries) and {r.query_id for r in got} == set(queries)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, x int")).collect()
    assert len(few) == 2


def test_packing(docs, empty):
    t, got = tokenizer(), packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(
        (i, k, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n])))
        for i, x, *_ in fixture_rows()
        for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 2]]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024))
    )
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        assert sum(n for _, n in own) <= 1024
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
    assert packing.pack_documents(empty).count() == 0


def brute_rounds(pieces, capacity):
    """{piece: sequence} of `pieces` (length by rank), by the rounds of the operator on plain lists with one stack."""
    half = capacity // 2
    of = {r: r for r, n in enumerate(pieces) if n > half}
    gaps = {r: capacity - pieces[r] for r in of}
    opened = packing.OPENED
    for low, high in packing.bands(capacity)[1:]:
        waiting = [r for r, n in enumerate(pieces) if low < n <= high]
        while waiting:
            room = [s for s, g in gaps.items() if g >= min(pieces[r] for r in waiting)]
            over = sum(pieces[r] for r in waiting) - sum(gaps[s] for s in room)
            more = max(0, -(-over // capacity), 0 if room else -(-len(waiting) // (capacity // (low + 1))))
            new = range(opened, opened + more)
            gaps, room, opened = gaps | dict.fromkeys(new, capacity), [*room, *new], opened + more
            share = -(-2 * len(waiting) // len(room))
            line = [(-pieces[r], 1, r) for r in waiting]
            for s in room:
                many = max(1, min(gaps[s] // high, share))
                line += [(-(gaps[s] - (many - 1) * high), 0, s)] + [(-high, 0, s)] * (many - 1)
            stack, waiting = [], []
            for value, is_piece, tie in sorted(line):
                if not is_piece:
                    stack.append(tie)
                elif stack:
                    of[tie] = stack.pop()
                    gaps[of[tie]] += value
                else:
                    waiting.append(tie)
    return of


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - length)
    return len(gaps)


@pytest.mark.parametrize("lengths", [range(1, 65), range(14, 34), range(1, 9)])
def test_packing_rounds(spark, monkeypatch, lengths):
    """Placements are those of the rounds with one stack, over many partitions; the count is best fit's, one by one."""
    monkeypatch.setattr(packing, "ROUND_ROWS", 60)
    rng = random.Random(6)
    rows = [(i // 2, i % 2, 0, rng.choice(lengths), 7) for i in range(500)]
    rows += rows[:20]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    order = pieces.orderBy(packing.F.desc("length"), packing.F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece").collect()
    want, at = {}, {}
    for rank, sequence in sorted(brute_rounds([r.length for r in order], 64).items()):
        r = order[rank]
        want.setdefault(sequence, []).append((r.doc_id, r.piece, at.get(sequence, 0)))
        at[sequence] = at.get(sequence, 0) + r.length
    got = {}
    for r in packing.pack(pieces, 64).collect():
        got.setdefault(r.sequence_id, []).append((r.doc_id, r.piece, r.offset))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(at.values()) <= 64
    assert len(got) <= 1.01 * best_fit_decreasing([r[3] for r in rows], 64) + 1


def test_brackets():
    rng = random.Random(4)
    for _ in range(200):
        kind = rng.choices([1, -1], k=rng.randint(1, 60))
        stack, want = [], set()
        for i, k in enumerate(kind):
            if k > 0:
                stack.append(i)
            elif stack:
                want.add((stack.pop(), i))
        _, gap, piece = packing.brackets(np.asarray(kind))
        assert set(zip(gap.tolist(), piece.tolist(), strict=True)) == want
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
    assert packing.bands(1024)[0] == (512, 1024) and packing.bands(1024)[-1][0] == 0 and packing.bands(1) == [(0, 1)]


def brute_lm(rows, order=ngram_lm.ORDER, other=None):
    """(doc_id, held out, tokens, known, learnt, base, score) of each row, or each of `other`, by plain dictionaries."""
    tok = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for i, w in tok:
        if i is not None and not held(i):
            for at in range(len(w)):
                count[(w[at],)] += 1
                for k in range(2, order + 1):
                    if at >= k - 2:
                        count[tuple([None, *w][at - k + 2 : at + 2])] += 1
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    out = []
    scored = tok if other is None else [(i, [*(t or "").encode().lower().split(), None]) for i, t in other]
    for i, w in scored:
        base = [(count[(x,)] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        score = 0.0
        for at, p in enumerate(base):
            for k in range(2, order + 1):
                if at >= k - 2:
                    gram = tuple([None, *w][at - k + 2 : at + 2])
                    p = (count[gram] + ngram_lm.MU * p) / (count[gram[:-1]] + ngram_lm.MU)
            score += math.log10(p)
        out.append((i, held(i) if other is None else i is not None, len(w), sum(count[(x,)] > 0 for x in w), n, sum(map(math.log10, base)), score))
    return out


def assert_lm(got, want):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted((tuple(r[c] for c in names) for r in got), key=repr)
    want = sorted(want, key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for x, y in zip(got, want, strict=True):
        assert abs(x[5] - y[5]) < 1e-6 and abs(x[6] - y[6]) <= 2e-4 * x[2]  # half a step a token


def test_lm_scores(spark, docs, empty, monkeypatch):
    rows = [(r[0], r[1]) for r in fixture_rows()]
    # One id on rows of different texts, each of which counts.
    rows += [(7, "alpha beta other words"), (7, "alpha beta"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (2, 3, 4):
        assert_lm(ngram_lm.score(df, order=order).collect(), brute_lm(rows, order))
    # Many blocks, shards and salts give the same.
    for name, value in (("BLOCK_BYTES", 20_000), ("SHARD_BYTES", 30_000), ("SALT_COUNT", 50)):
        monkeypatch.setattr(ngram_lm, name, value)
    assert_lm(ngram_lm.score(df).collect(), brute_lm(rows))
    assert ngram_lm.score(docs).count() == len(fixture_rows()) and ngram_lm.score(empty).count() == 0
    none = [(None, "a b"), (None, None)]
    assert_lm(ngram_lm.score(spark.createDataFrame(none, "doc_id long, text string")).collect(), brute_lm(none))


def test_lm_scores_another_table_from_the_stored_trie(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in fixture_rows()]
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice([*WORDS, "unseen", f"new{rng.randrange(30)}"]) for _ in range(n))
    other = [(i, text(n)) for i, n in enumerate([0, 1, 2, 5, 300, 9000])]
    other += [(5, rows[6][1]), (5, "alpha beta other words"), (None, "alpha gamma delta"), (60, None), (61, "ALPHA  beta\tnew1 beta")]
    schema = "doc_id long, text string"
    df, another = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    monkeypatch.setattr(ngram_lm, "SALT_COUNT", 50)
    for order, bytes_ in ((2, 1 << 20), (3, 20_000), (4, 30_000)):
        monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", bytes_)
        monkeypatch.setattr(ngram_lm, "SHARD_BYTES", bytes_)
        model = ngram_lm.fit(df, order=order)
        assert_lm(ngram_lm.score_with(model, another).collect(), brute_lm(rows, order, other))
    assert ngram_lm.score_with(model, another.limit(0)).count() == 0
    # What it learnt from, it scores as it did then.
    then = {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in ngram_lm.score(df, order=4).collect()}
    assert then == {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in ngram_lm.score_with(model, df).collect()}
    # Without the trie's last level, its n-grams are worth what backing off leaves them.
    less = model._replace(levels=model.levels.where("level < 4"))
    whole, cut = (sorted((r.n_tokens, r.score) for r in ngram_lm.score_with(m, another).collect()) for m in (model, less))
    assert all(c <= w + 1e-9 for (_, w), (_, c) in zip(whole, cut, strict=True))
    assert any(w - 1 > c for (_, w), (_, c) in zip(whole, cut, strict=True))
    # A model of nothing knows nothing.
    nothing = ngram_lm.fit(spark.createDataFrame([(None, "a b")], schema))
    assert_lm(ngram_lm.score_with(nothing, another).collect(), brute_lm([], 3, other))


def test_lm_contexts_of_like_hash_stay_apart(spark):
    words = [f"w{i}" for i in range(60_000)]
    seen, alike = {}, []
    for w, h in zip(words, substring.word_hashes([w.encode() for w in words]).tolist(), strict=True):
        alike += [(seen[h >> 36], w)] if h >> 36 in seen else []
        seen[h >> 36] = w
    a, b = alike[0]
    texts = [f"{a} x {f'{a} y ' * 11}", f"{b} x " * 20]
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    # a held-out text asks for a pair that only the other context has
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [*zip(ids, texts, strict=True), (held, f"{b} y")]
    assert_lm(ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute_lm(rows))


def test_lm_salts_spread_a_frequent_context():
    word = np.arange(100_000, dtype=np.uint64)
    one = np.full(len(word), 7, dtype=np.uint64)
    few, many = (ngram_lm.gram_shard(one, word, np.full(len(word), c, dtype=np.uint64), 64, 1000) for c in (10, 100_000))
    assert len(set(few.tolist())) == 1 and np.bincount(many, minlength=64).max() < 0.1 * len(word)


def test_elias_fano_and_trie():
    rng = np.random.default_rng(2)
    for universe, n in ((10, 30), (1 << 40, 1000), (5000, 5000), (1 << 20, 0)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        ef = ngram_lm.EliasFano(values, universe)
        assert (ef.access(np.arange(n)) == values).all()
        if n:
            x = rng.integers(0, universe, 200).astype(np.uint64)
            assert (ef.successor(x, np.zeros(200, dtype=np.int64), np.full(200, n)) == np.searchsorted(values, x)).all()
    pairs = np.unique(rng.integers(0, 40, 800) * 1000 + rng.integers(0, 1000, 800))
    context, word, p = (pairs // 1000 * 7).astype(np.uint64), (pairs % 1000).astype(np.uint64), rng.random(len(pairs))
    trie = ngram_lm.Trie(context, word, p)
    asked = np.arange(45, dtype=np.uint64) * np.uint64(7)
    grid_of, grid_word = np.repeat(np.arange(45), 1100), np.tile(np.arange(1100, dtype=np.uint64), 45)
    want = np.zeros(45 * 1100, dtype=np.uint16)
    want[pairs // 1000 * 1100 + pairs % 1000] = ngram_lm.quantised(p)
    assert (trie.look_up(asked, grid_of, grid_word) == want).all()
    assert np.abs(np.log10(ngram_lm.restored(ngram_lm.quantised(p))) - np.log10(p)).max() < 2e-4


def brute_base(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := digits(m[0])) <= 19 and pii.luhn(d)]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "@@", ".", "_", "+", "-", " ", "1", "25", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "é", "x@y.com", "10.0.0.1", "\n", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert pii._listed(pii.base_spans(text)).split(",") == (brute_base(text) or [""]), text


def test_pii(spark, docs, empty):
    rows = [(i, f"call me at phone {t}", "en", "s", 0, "", "", "") for i, t in enumerate(["+1 (212) 555-0100", "(212) 555-0199", "x@y.com", "joe (at) site (dot) com", "12345 is plain", None])]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_phone == 1 and got[2].n_email == 1 and got[4].spans == "" and got[5].spans == ""
    odd = pii.find_pii(docs).collect()
    for r in odd:
        text = next(t or "" for i, t, *_ in fixture_rows() if i == r.doc_id)
        base = brute_base(text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= {*r.spans.split(",")} | {""}
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == len(odd)
    assert out.where("doc_id = 11").first().text.startswith("Mail [EMAIL] or [PHONE]")
    assert pii.find_pii(empty).count() == 0


def test_expectation_maximisation_finds_the_good_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    flip = lambda p: np.where(rng.random(20_000) < p, truth, ~truth) * 2 - 1
    votes = np.stack([flip(0.95), flip(0.9), flip(0.55)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, table, share = pii.reliabilities(patterns, counts.astype(float))
    assert table[0, 1, 2] > 0.9 > 0.7 > table[2, 1, 2] and abs(share - 0.4) < 0.05 and len(posterior) == len(patterns)


def planted_pii(n=400):
    """(text, added spans): personal data that the base patterns miss, and numbers and words that are none."""
    rng = random.Random(12)
    word = lambda: rng.choice(WORDS)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card():
        body = "4" + digits(14)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    dotted = lambda x: ".".join(x[i : i + 4] for i in range(0, 16, 4))
    good = [
        ("email", lambda: ("mail ", f"{word()} at {word()} dot com")),
        ("email", lambda: ("", f"{word()}(at){word()}.org")),
        ("ip", lambda: ("host ", f"fe80::{hexes(3)}:{rng.randint(1, 9)}{hexes(2)}")),
        ("card", lambda: ("card ", dotted(card()))),
        ("phone", lambda: ("tel ", f"0049 30 {digits(6)}")),
        ("phone", lambda: ("call ", f"(212) 555-{digits(4)}")),
        ("secret", lambda: ("token = ", hexes(40))),
        ("secret", lambda: ("", f"ghp_{hexes(36)}")),
    ]
    bad = [
        lambda: ("order number ", dotted("9" + digits(14) + "0")),
        lambda: ("commit ", hexes(40)),
        lambda: ("sha256 ", hexes(64)),
        lambda: ("version ", f"{digits(1)}.{digits(2)}"),
        lambda: ("", f"look at {word()} dot"),
        lambda: ("", f"12:30:{digits(2)}"),
    ]
    out = []
    for _ in range(n):
        head = " ".join(word() for _ in range(rng.randint(2, 9))) + " "
        if rng.random() < 0.6:
            kind, make = rng.choice(good)
            before, found = make()
            span = [f"{kind}:{len(head) + len(before)}:{len(head) + len(before) + len(found)}"]
        else:
            before, found = rng.choice(bad)()
            span = []
        out.append((head + before + found + " " + word(), span))
    return out


def test_pii_adds_what_the_base_misses(spark):
    rows = planted_pii()
    got = pii.find_pii(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    right = wrong = missed = 0
    for r in got:
        text, want = rows[r.doc_id]
        base = set(brute_base(text))
        added = {x for x in r.spans.split(",") if x} - base
        right, wrong, missed = right + len(added & set(want)), wrong + len(added - set(want)), missed + len(set(want) - added - base)
    assert right > 150 and right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95, (right, wrong, missed)


def test_candidates_are_linear_and_whole():
    text = " ".join(f"x{i}@y.com 10.0.0.{i % 256} fe80::{i % 10}1" for i in range(20_000))
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    assert len(base) == 40_000 and sum(x.kind == pii.IP and not strict for x, strict in found) == 20_000
    long = "a" * 5000 + "(at)" + "b" * 300 + "".join(f".c{i}" for i in range(40))
    assert [x[1:] for x, _ in pii.candidates(long, []) if x.kind == pii.EMAIL] == [(0, len(long))]


def test_classifier_learns_what_it_is_given():
    rng = np.random.default_rng(5)
    x = (rng.random((3000, 12)) < 0.4).astype(float)
    truth = rng.normal(size=12)
    goal = 1 / (1 + np.exp(-x @ truth))
    assert np.abs(pii.train(x, goal, ridge=1e-6) - truth).max() < 1e-3


def test_added_spans_that_overlap():
    weights = np.zeros(pii.COLUMNS)
    weights[pii.PHONE], weights[pii.SECRET] = 1.0, 2.0
    base, both = pii.spans("00491 234567 a0b1c2d3e4f5g6h7i8j9 x@y.com", weights)
    assert [pii.KINDS[x.kind] for x in both] == ["email", "phone", "secret"] and [pii.KINDS[x.kind] for x in base] == ["email"]


def test_damaged_media_never_fail():
    rng = random.Random(4)
    whole = media.write_media(rng.randbytes(576 * 70))
    head = whole.index(b"mdat")
    assert media.described(whole)[0] == "raw"
    for i in range(10_000):
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(head)
            bad[at] = rng.choice([0, 1, 255, rng.randrange(256)])
        if i % 5 == 0:
            del bad[rng.randrange(len(bad)) :]
        found = media.described(bytes(bad))
        assert len(found) == 5 and all(0 <= k["start"] and k["start"] + k["length"] <= len(bad) for k in found[3] or [])
    for kind, value in ((b"stss", 0), (b"stss", 71), (b"stco", 1 << 31)):
        bad = bytearray(whole)
        at = bad.index(kind) + 12
        bad[at : at + 4] = struct.pack(">I", value)
        assert media.described(bytes(bad)) == (None,) * 5


def test_media_with_absurd_counts_take_no_memory():
    import tracemalloc

    bad = bytearray(media.write_media(b"\1" * 576 * 40))
    at = bad.index(b"stsz") + 8
    bad[at : at + 8] = struct.pack(">II", 1, 50_000_000)
    tracemalloc.start()
    assert media.described(bytes(bad)) == (None,) * 5
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_media_tracks_and_fragments(spark):
    box, full, n = media.box, media.full, lambda *x: struct.pack(f">{len(x)}I", *x)

    def track(number, handler, codec, *tables):
        head = full(b"tkhd", n(0, 0, number, 0, 0), b"\0" * 60)
        entry = full(b"stsd", n(1), box(codec, b"\0" * 8))
        mdia = box(b"mdia", full(b"mdhd", n(0, 0, 1000, 0), b"\0" * 4), full(b"hdlr", b"\0" * 4, handler, b"\0" * 13), box(b"minf", box(b"stbl", entry, *tables)))
        return box(b"trak", head, mdia)

    def whole(first):
        sound = track(1, b"soun", b"mp4a", full(b"stts", n(1, 3, 10)), full(b"stsc", n(1, 1, 2, 1)), full(b"stz2", n(8, 3), bytes([4, 5, 6])), full(b"stco", n(2, first, first + 9)))
        empty = [full(b"stts", n(0)), full(b"stsc", n(0)), full(b"stsz", n(0, 0)), full(b"stco", n(0))]
        extend = box(b"mvex", full(b"trex", n(2, 1, 40, 0, 0x10000)))
        return box(b"ftyp", b"isom", n(0)) + box(b"moov", full(b"mvhd", b"\0" * 96), sound, track(2, b"vide", b"avc1", *empty), extend)

    def moof(data_offset):
        run = full(b"trun", n(3), struct.pack(">i", data_offset), n(0), n(7, 8, 9), flags=0x205)
        return box(b"moof", full(b"mfhd", n(1)), box(b"traf", full(b"tfhd", n(2), flags=0x20000), run))

    first = len(whole(0)) + 8
    head = whole(first) + box(b"mdat", bytes(range(15)))
    data = head + moof(len(moof(0)) + 8) + box(b"mdat", bytes(range(100, 124)))
    sound, video = media.read_tracks(data)
    assert (sound.codec, sound.duration, sound.offsets.tolist(), sound.sizes.tolist(), sound.keys.tolist()) == ("mp4a", 30, [first, first + 4, first + 9], [4, 5, 6], [0, 1, 2])
    assert (video.codec, video.handler, video.duration, video.sizes.tolist(), video.keys.tolist()) == ("avc1", "vide", 120, [7, 8, 9], [0])
    assert media.sample_bytes(data, video) == bytes(range(100, 124)) and media.sample_bytes(data, sound) == bytes(range(15))
    rows = spark.createDataFrame([(1, bytearray(data), "x"), (2, bytearray(data[:-3]), "y")], "id long, m binary, codec string")
    got = {r.id: r for r in media.media_columns(rows, "id", "m").collect()}
    assert got[1].codec == "avc1" and [t.codec for t in got[1].tracks] == ["mp4a", "avc1"] and len(got[1].keyframes) == 1
    assert got[2].codec is None and got[2].tracks is None


def test_index_prunes_and_misses_nothing_within_its_radius():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5000, 32))
    x = ann.unit((centres[:, None] + rng.normal(size=(5000, 20, 32)) / 12).reshape(-1, 32))
    mean, rotation = ann.learn(x[:: len(x) // ann.SAMPLE][: ann.SAMPLE])
    code, parts = ann.codes(x, mean, rotation), ann.cuts(len(x))
    within, sub = len(parts) * (ann.PROBED + 1) - 1, ann.substrings(code, parts)
    assert all(16 <= b - a <= 19 for a, b in parts) and parts[0][0] == 0 and parts[-1][1] == ann.BITS
    queries = np.arange(0, len(x), 1000)
    met = hits = 0
    for q in queries:
        near = np.bitwise_count(sub ^ sub[q]) <= ann.PROBED  # the probed buckets hold these entries
        met += near.sum()
        assert near.any(axis=1)[ann.apart(code, code[q]) <= within].all()
        best = np.argsort(-(x @ x[q]))[1:6]
        hits += (ann.apart(code[best], code[q]) <= within).sum()
    assert met / len(queries) < 0.01 * len(x) and hits > 0.9 * 5 * len(queries)


def test_nearest_in_clusters_and_with_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([(rng.normal(size=(100, 1, 24)) + rng.normal(size=(100, 10, 24)) / 15).reshape(-1, 24), rng.normal(size=(200, 24))])
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    want = {}
    for q in range(0, len(x), 50):
        s = ann.cosine(np.repeat(x[q : q + 1], len(x), axis=0), x)
        s[q] = -2
        want[q] = np.lexsort((np.arange(len(x)), -s))[:5].tolist()
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * 5 * len(want)
    monkeypatch.setattr(ann, "SLICE_BYTES", 40 * (8 * 24 + 8 * ann.WORDS + 32))  # slices of 40 entries: leading bits and salts
    assert ann.layout(len(x), 24, "<f8").lead == 5
    again = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        again.setdefault(r.query_id, []).append(r.vec_id)
    assert again == got


def test_nearest_on_the_table_are_settled_by_the_index(spark):
    got = {}
    for r in queries.QUERIES["op7_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    ids = np.asarray([i for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)])
    x = np.asarray([rows[i] for i in ids], dtype=float)
    want, hits = ids[ids % 50 == 0].tolist(), 0
    assert sorted(got) == sorted(want)
    for q in want:
        s = ann.cosine(np.repeat(x[ids == q], len(x), axis=0), x)
        s[ids == q] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s[ids == i][0] - score) < 1e-12 for _, i, score in own)
        hits += len(set(best.tolist()) & {i for _, i, _ in own})
    assert hits >= 0.95 * 5 * len(want)


def test_probing_goes_on_until_the_radius_is_covered():
    rng = np.random.default_rng(6)
    x = ann.unit(rng.normal(size=(600, 24)))
    mean, rotation = ann.learn(x)
    code = ann.codes(x, mean, rotation)
    at = ann.layout(len(x), 24, "<f8")
    sub = ann.substrings(code, at.parts)
    apart = ann.apart(code[:40, None], code[None])
    least = np.bitwise_count(sub[:40, None] ^ sub[None]).min(axis=2)
    for radius in (0, 11, 12, 40, 57, ann.BITS):
        assert (least[apart <= radius] <= at.flips(radius)).all()


def test_repeated_query_ids_give_the_same_rows_again(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 8))
    rows = [(i % 60, [float(v) for v in y]) for i, y in enumerate(x)]  # each id twice, with two vectors
    runs = []
    for order in (rows, rows[::-1], rows[60:] + rows[:60]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(5)
        runs.append(sorted(map(tuple, ann.search(df, queries=F.col("vec_id") % 20 == 0, k=70).collect())))
    assert runs[0] == runs[1] == runs[2]
    assert Counter(q for q, *_ in runs[0]) == {0: 59, 20: 59, 40: 59}  # all other ids, fewer than k
    assert all(q != v for q, _, v, _ in runs[0])


def test_pii_sample_is_bounded_and_copies_teach_once(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_CANDIDATES", 50)
    seen = []
    monkeypatch.setattr(pii, "train", lambda x, goal: seen.append(x.shape) or np.zeros(pii.COLUMNS))
    rows = [(i, f"host fe80::{i % 600:x}:1 and token = {hashlib.sha1(str(i % 600).encode()).hexdigest()}") for i in range(3000)]
    pii.span_model(spark.createDataFrame([*rows, *[rows[0]] * 1000], "doc_id long, text string"))
    pii.span_model(spark.createDataFrame([rows[0]] * 40, "doc_id long, text string"))
    assert 20 < seen[0][0] < 100 and seen[1][0] == 2
