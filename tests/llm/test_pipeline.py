"""The pipeline's stages, one after another, on the fixture and the smallest tables."""

import random

import numpy as np

import corpus_pipeline
from tastegrid.llm import langid, mixing
from tests.llm.test_operators import SCHEMA, brute_fingerprint, fixture_rows

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.createDataFrame(fixture_rows(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_take_any_columns_and_nulls(spark):
    names = "row own_row mix _mix _mix_row _mix_time mix_time its_row kept rest dropped fp its_fp node part tie least".split()
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} string" for x in names)
    rng = random.Random(1)
    words = {"en": "the with house and for".split(), "de": "der und haus mit für".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, f"s{i % 3}", *names))
    rows += [(None, None, None, None, *[None] * len(names)), (3, "the house", None, None, *names), rows[5]]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r["mix"] in ("mix", None) and r["row"] in ("row", None) for r in out.collect()), name
    assert corpus_pipeline.best_fit_packing(spark, docs, SF).count() == len(rows)


def test_language_stage_keeps_clean_documents_and_rejects_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "1234 -- 99 !!")], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(extra, allowMissingColumns=True), SF).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert not kept & {9001, 9002, 9003} and len(kept & lettered) >= 0.98 * len(lettered)


def test_pii_stage_replaces_and_counts(spark):
    rows = [(1, "write x@y.com or +1 (555) 123-4567", 33), (2, None, 0), (3, "nothing here", 12)]
    got = {r.doc_id: r for r in corpus_pipeline.pii_redaction(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), SF).collect()}
    assert got[1].text == "write [EMAIL] or [PHONE]" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[2].n_chars == 0 and got[3].text == "nothing here"


def test_language_kernel_equals_dense_ridge():
    """Scores equal kernel ridge with Nystroem landmarks computed from sets of n-grams."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["ab", "cd", "xyz"] if i % 2 else ["qu", "ro", "ab"]) for _ in range(rng.randint(2, 9))).encode() for i in range(40)]
    labels = ["b" if i % 2 else "a" for i in range(40)]
    model = langid.fit(texts, labels, landmarks=4)
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    marks = [i for k in "ab" for i in [j for j in range(40) if labels[j] == k][:4]]
    value, vector = np.linalg.eigh(kernel[np.ix_(marks, marks)])
    keep = value > 1e-6 * value.max()
    phi = kernel[:, marks] @ (vector[:, keep] / np.sqrt(value[keep]))
    goal = np.array([[1.0, -1.0] if x == "a" else [-1.0, 1.0] for x in labels])
    weight = np.full(40, 1 / 40)
    mean, bias = weight @ phi, weight @ goal
    c = phi - mean
    coef = np.linalg.solve(c.T @ (c * weight[:, None]) + langid.RIDGE / 10 * np.eye(c.shape[1]), c.T @ ((goal - bias) * weight[:, None]))
    want = langid.SHARPNESS * (c @ coef + bias)
    want = np.exp(want - want.max(axis=1, keepdims=True))
    got = langid.scores(model, langid.Presence(model.grams), texts)
    assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def test_dedup_leaves_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()}
    fp = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    label = {i: i for i in fp}
    while True:
        new = {i: min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4) for i in fp}
        if new == label:
            break
        label = new
    assert kept == {i for i in fp if label[i] == i}


def test_dedup_keeps_one_row_with_null_and_repeated_ids(spark):
    words = [f"word{i}" for i in range(40)]
    same, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::2])
    rows = [(2, same), (1, same), (1, same), (None, same), (3, other), (3, other), (None, third), (None, third)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted([(1, same), (3, other), (None, third)], key=repr)


def test_mix_meets_its_targets_with_null_and_repeated_ids(spark):
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(300)]
    rows = [(i, f"a b c d t{k}", s) for s in ("s0", "s1", "s2") for k, i in enumerate(ids)]
    got = corpus_pipeline.source_mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF)
    words = {r.source: 5 * r["count"] for r in got.groupBy("source").count().collect()}
    goal = mixing.targets([1500] * 3, mixing.WEIGHTS)
    assert all(abs(words[f"s{i}"] - goal[i]) <= 5 for i in range(3))
