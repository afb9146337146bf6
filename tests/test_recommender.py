"""Hand-made fixtures and properties of the splits, models, metrics and readers."""

import copy
import io
import math
import threading
import tracemalloc
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastegrid import cli, sources
from tastegrid.experiment import run_experiment
from tastegrid.operators import evaluate as ev
from tastegrid.operators import models as m
from tastegrid.operators.encode import with_dense_index
from tastegrid.operators.neural import Net, NeuralModel
from tastegrid.operators.saved import NoModel, load_ids, load_model, save_model
from tastegrid.operators.splits import allbut, kfold, split_files, time_split, write_folds
from tastegrid.plans.catalogue import QUERIES
from tastegrid.sources.delimited import whole_lines

ROWS = "userId long, movieId long, rating double, timestamp long, pos long"


def indexed(df):
    return with_dense_index(with_dense_index(df, "userId", "user_idx"), "movieId", "item_idx")


@pytest.fixture(scope="module")
def lowrank(spark):
    rng = np.random.default_rng(3)
    u, i = rng.normal(size=(60, 2)), rng.normal(size=(40, 2))
    rows = [(a + 1, int(b) + 1, float(np.clip(np.rint(3 + u[a] @ i[b]), 1, 5)), t, t * 100 + a) for a in range(60) for t, b in enumerate(rng.permutation(40)[:25])]
    return indexed(spark.createDataFrame(rows, ROWS)).cache()


def test_split_breaks_ties_by_position_and_keeps_short_users(spark):
    df = spark.createDataFrame([(1, 10, 3.0, 5, 0), (1, 11, 4.0, 5, 2), (1, 12, 5.0, 5, 1), (2, 10, 1.0, 1, 3), (3, 10, 2.0, 1, 4), (3, 11, 2.0, 2, 5)], ROWS)
    train, val, test = ([(r.userId, r.movieId) for r in x.orderBy("userId").collect()] for x in time_split(df))
    assert train == [(1, 10)] and val == [(1, 12), (3, 10)] and test == [(1, 11), (2, 10), (3, 11)]


def test_kfold_13(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 1.0, i, i) for i in range(1, 14)], ROWS)
    compat = kfold(df, ["pos"], mode="compat")
    assert sorted(r.pos for r in compat.where("fold = 1 and part = 'train'").collect()) == sorted([*range(6, 14), 11, 12, 13])
    assert sorted(r.pos for r in compat.where("fold = 5 and part = 'test'").collect()) == [9, 10, 11, 12, 13]
    exact = kfold(df, ["pos"])
    assert exact.groupBy("fold").count().where("count <> 13").count() == 0
    write_folds(exact, str(tmp_path / "folds"))
    assert spark.read.parquet(str(tmp_path / "folds")).where("fold = 2 and part = 'test'").count() == 2


def test_allbut_cap_and_order(spark):
    df = spark.createDataFrame([(i % 2, i, 1.0, i, i) for i in range(12)], ROWS)
    assert sorted(r.pos for r in allbut(df, ["pos"], 2, 3, 3).where("part = 'test'").collect()) == [2, 3, 4]
    assert sorted(r.pos for r in allbut(df, ["pos"], 1, 2).where("part = 'test'").collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        allbut(df, ["pos"], 3, 2)


def test_bias_model_on_unseen_ids_and_clip(spark):
    train = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0), (1, 0, 1.0)], "user_idx int, item_idx int, rating double")
    got = {(r.user_idx, r.item_idx): r.prediction for r in m.BiasModel().fit(train).predict(spark.createDataFrame([(0, 1), (1, 0), (9, 9), (9, 9)], "user_idx int, item_idx int")).collect()}
    mu = 11 / 3
    assert got == {(0, 1): 5.0, (1, 0): pytest.approx(max(0.5, mu + (1 - mu) + (3 - mu))), (9, 9): pytest.approx(mu)}
    assert m.GlobalMean().fit(train).predict(train).select("prediction").distinct().count() == 1


def test_knn_against_dense_arrays(spark, lowrank):
    train, val, _ = time_split(lowrank)
    for k in (3, 20, 39):
        got = {(r.user_idx, r.item_idx): r.prediction for r in m.ItemKNN(k).fit(train).predict(val).collect()}
        bias = m.BiasModel().fit(train)
        n_u, n_i = 60, train.agg(F.max("item_idx")).first()[0] + 1
        v = np.zeros((n_u, n_i))
        for r in m.residual_matrix(train, bias).collect():
            v[r.user_idx, r.item_idx] = r.v
        norm = np.sqrt((v * v).sum(axis=0))
        sim = np.divide(v.T @ v, norm[:, None] * norm[None], out=np.zeros((n_i, n_i)), where=norm[:, None] * norm[None] > 0)
        for r in bias.with_base(val).collect():
            w = np.where(v[r.user_idx] != 0, np.round(sim[r.item_idx], 10), 0.0) if r.item_idx < n_i else np.zeros(n_i)
            w[r.item_idx] = 0
            top = np.argsort(-w, kind="stable")[:k]
            adj = w[top] @ v[r.user_idx][top] / w[top].sum() if w[top].sum() else 0.0
            assert got[r.user_idx, r.item_idx] == pytest.approx(float(np.clip(r._base + adj, 0.5, 5)), abs=1e-6)


def test_ranking_metrics_by_hand(spark):
    rows = [(0, i, i, i == 0, 5.0) for i in range(10)] + [(1, i, i, i < 2, float(9 - i)) for i in range(10)]
    got = {(r.user_idx, r.k): (r.P, r.R, r.NDCG) for r in ev.user_metrics(spark.createDataFrame(rows, "user_idx int, item_idx int, cand_pos int, is_relevant boolean, prediction double"), [5, 10]).collect()}
    assert got[0, 5] == (0.0, 0.0, 0.0) and got[0, 10] == (0.1, 1.0, pytest.approx(1 / math.log2(11)))
    assert got[1, 5] == (0.4, 1.0, pytest.approx(1.0))


def test_users_with_few_unseen_items_are_skipped(spark, lowrank):
    train, _, test = time_split(lowrank)
    assert ev.ranking_candidates(train, test, threshold=0, n_negatives=99).count() == 0
    found = ev.ranking_candidates(train, test, threshold=0, max_users=7, n_negatives=5)
    assert found.select("user_idx").distinct().count() <= 7 and found.where("is_relevant").count() * 6 == found.count()


def test_als_and_network_learn(spark, lowrank):
    train, val, _ = (x.cache() for x in time_split(lowrank))
    base = ev.rating_metrics(m.GlobalMean().fit(train).predict(val)).first().RMSE
    als = m.ALSModel(factors=4, iterations=8, regularization=0.05, feedback="explicit").fit(train)
    assert ev.rating_metrics(als.predict(val)).first().RMSE < base
    top = als.recommend(0, 5).collect()
    assert len(top) == 5 and [r.score for r in top] == sorted((r.score for r in top), reverse=True)
    net = NeuralModel(emb_dim=8, layers=(16, 8), epochs=6, lr=0.01, batch_size=64).fit(train)
    assert net.losses[-1] < net.losses[0] and len(net.losses) == 6
    odd = net.predict(spark.createDataFrame([(0, 0), (0, 0), (999, 999)], "user_idx int, item_idx int"))
    assert odd.count() == 3 and odd.where("prediction between 0.5 and 5").count() == 3


def test_gradients_are_right():
    net = Net(5, 4, emb_dim=3, layers=(4, 2), dropout=0.0, seed=1)
    u, i, r = np.array([0, 1, 1]), np.array([2, 2, 3]), np.array([1.0, 4.0, 2.0])
    _, grads = net.gradients(u, i, r, np.random.default_rng(0))
    for name in net.params:
        at = tuple(d - 1 if name.startswith(("w", "b")) else 1 for d in net.params[name].shape)
        at = (1, 0) if name == "user" else (2, 0) if name == "item" else at
        old, losses = net.params[name][at], []
        for step in (1e-5, -1e-5):
            net.params[name][at] = old + step
            losses.append(float(((net.forward(u, i)[0] - r) ** 2).mean()))
        net.params[name][at] = old
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-4)


def test_readers_cli_and_experiment(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    lines = [f"{u}::{i}::{rng.integers(1, 6)}::{1000 + t}" for u in range(1, 21) for t, i in enumerate(rng.permutation(30)[:15] + 1)]
    (tmp_path / "ratings.dat").write_text("\n".join([*lines[:5], "", *lines[5:]]) + "\n")
    (tmp_path / "movies.dat").write_bytes('1::Misérables, "Les"::Drama|War\n2::NA::NA\n'.encode("latin-1"))
    (tmp_path / "users.dat").write_text("1::F::1::10::01234\n")
    ratings, movies, users = sources.load_1m(spark, str(tmp_path))
    assert [f"{r.userId}::{r.movieId}::{r.rating:.0f}::{r.timestamp}" for r in ratings.orderBy("pos").collect()] == lines
    assert movies.orderBy("movieId").first().title == 'Misérables, "Les"' and movies.where("movieId = 2").first().title is None
    assert users.first().zip == "01234" and ratings.agg(F.max("user_idx"), F.max("item_idx")).first() == (19, 29)
    assert cli.main(["--user", "1", "--model", "knn", "--topn", "3", "--data", str(tmp_path)], spark) == 0
    assert "Top 3 recommendations for User 1 (KNN)" in capsys.readouterr().out
    assert cli.main(["--user", "99", "--data", str(tmp_path)], spark) == 1
    assert "User 99 not found. Valid range: 1 - 20" in capsys.readouterr().out
    (tmp_path / "tags.dat").write_text("7::1::dark comedy::99\n")
    (tmp_path / "movies.dat").write_text("1::Amélie::Comedy\n")
    assert sources.load_10m(spark, str(tmp_path))[2].first().tag == "dark comedy"
    found = run_experiment(ratings, {"GlobalMean": m.GlobalMean, "BiasModel": m.BiasModel}, ranked=("BiasModel",), show=lambda x: None)
    assert set(found) == {"GlobalMean", "BiasModel"}


def test_recommend_drops_items_without_id_after_the_cut(spark):
    train = spark.createDataFrame([(1, 10, 0, 0, 5.0), (1, 13, 0, 3, 4.0), (2, 11, 1, 1, 3.0)], "userId long, movieId long, user_idx int, item_idx int, rating double")
    movies = spark.createDataFrame([(11, "Eleven", "")], "movieId long, title string, genres string")
    got = ev.recommend(m.BiasModel().fit(train), 0, train, movies, 2).collect()
    assert [(r.rank, r.title) for r in got] == [(1, "Eleven")] and len(ev.recommend(m.BiasModel().fit(train), 0, train, movies, 0).collect()) == 0


@pytest.mark.parametrize("name", ["als_predict_val", "als_recommend", "ranking_metrics_als", "neural_predict_val", "ranking_metrics_neural"])
def test_registered_models_train_in_full(spark, monkeypatch, name):
    class Fitted(Exception):
        pass

    def fit(model, train):
        raise Fitted(model)

    monkeypatch.setattr(m.ALSModel, "fit", fit)
    monkeypatch.setattr(NeuralModel, "fit", fit)
    with pytest.raises(Fitted) as found:
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
    model = found.value.args[0]
    if "als" in name:
        assert (model.factors, model.iterations, model.regularization, model.feedback) == (50, 20, 0.1, "implicit")
    else:
        assert (model.emb_dim, model.layers, model.epochs, model.lr, model.batch_size) == (32, (64, 32, 16), 10, 0.001, 1024)


def test_similar_items_of_the_whole_catalogue(spark):
    d = "/root/testdata/sf0.001"
    train = time_split(sources.indexed_interactions(spark, d))[0].cache()
    v = {}
    for r in m.residual_matrix(train, m.BiasModel().fit(train)).where("v <> 0").collect():
        v.setdefault(r.item_idx, {})[r.user_idx] = r.v
    norm = {i: math.sqrt(sum(x * x for x in own.values())) for i, own in v.items()}
    want = {}
    for i in v:
        sims = [(-round(sum(x * v[j][u] for u, x in v[i].items() if u in v[j]) / (norm[i] * norm[j]), 10), j) for j in v if j != i]
        want |= {(i, k + 1): -s for k, (s, _) in enumerate(sorted(x for x in sims if x[0] < 0)[:5])}
    got = {(r.i, r.r): r.sim for r in QUERIES["item_similarity_all"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {i for i, _ in got} > {r.i for r in QUERIES["item_similarity_topk"](spark, d).select("i").distinct().collect()}


def plain_als(matrix, factors, iterations, regularization, seed):
    """Implicit ALS on whole matrices, a user or item at a time: {id: factors} of users and of items."""
    ids = [sorted({r[k] for r in matrix}) for k in (0, 1)]
    x = [{i: np.random.default_rng([seed, side, i // 64]).random((64, factors))[i % 64] * 0.01 for i in ids[side]} for side in (0, 1)]
    own = [{}, {}]
    for u, i, v in matrix:
        own[0].setdefault(u, []).append((i, v))
        own[1].setdefault(i, []).append((u, v))
    for _ in range(iterations):
        for side in (0, 1):
            others = x[1 - side]
            gram = sum(np.outer(y, y) for y in others.values()) + regularization * np.eye(factors)
            for i, rated in own[side].items():
                a = gram + sum((abs(v) - 1) * np.outer(others[j], others[j]) for j, v in rated)
                b = sum((max(v, 0) * others[j] for j, v in rated), np.zeros(factors))
                at = x[side][i]
                r = b - a @ at
                p, old = r, r @ r
                for _ in range(3):
                    if old <= 1e-20:
                        break
                    alpha = old / (p @ a @ p)
                    at, r = at + alpha * p, r - alpha * (a @ p)
                    p, old = r + r @ r / old * p, r @ r
                x[side][i] = at
    return x


@pytest.mark.parametrize("workers", [1, 3, 8])
def test_implicit_als_equals_arrays(spark, lowrank, workers):
    """Factors, predictions and recommendations equal a run on arrays to 6 places, also where a user lies over tasks."""
    heavy = spark.createDataFrame([(3, i, 3.0 + i % 2, 10_000 + i) for i in range(400, 700)], "user_idx int, item_idx int, rating double, timestamp long")
    train, val, _ = time_split(lowrank)
    train = train.select("user_idx", "item_idx", "rating", "timestamp").unionByName(heavy).cache()
    als = m.ALSModel(factors=5, iterations=6, regularization=0.1, workers=workers).fit(train)
    matrix = [(r.user_idx, r.item_idx, r.v) for r in als.matrix.collect()]
    users, items = plain_als(matrix, 5, 6, 0.1, 42)
    for want, got in ((users, als.user_factors), (items, als.item_factors)):
        got = {r.id: np.asarray(r.features) for r in got.collect()}
        assert got.keys() == want.keys() and all(np.abs(got[k] - want[k]).max() < 1e-6 for k in want)
    base = {(r.user_idx, r.item_idx): r._base for r in als.bias.with_base(val).collect()}
    for r in als.predict(val).collect():
        dot = users[r.user_idx] @ items[r.item_idx] if r.user_idx in users and r.item_idx in items else 0.0
        assert r.prediction == pytest.approx(min(5.0, max(0.5, base[r.user_idx, r.item_idx] + dot)), abs=1e-6)
    seen = {i for u, i, _ in matrix if u == 5}
    want = sorted(((users[5] @ y, i) for i, y in items.items() if i not in seen), reverse=True)[:40]
    assert [(round(r.score, 6), r.item_idx) for r in als.recommend(5, 40).collect()] == [(round(s, 6), i) for s, i in want]
    # Ids without factors add nothing to the biases.
    odd = spark.createDataFrame([(3, 0), (9999, 0), (3, 9999)], "user_idx int, item_idx int")
    base = {(r.user_idx, r.item_idx): r._base for r in als.bias.with_base(odd).collect()}
    got = {(r.user_idx, r.item_idx): r.prediction for r in als.predict(odd).collect()}
    assert all(got[k] == pytest.approx(min(5.0, max(0.5, base[k]))) for k in ((9999, 0), (3, 9999)))


def test_als_of_nothing(spark):
    empty = spark.createDataFrame([], "user_idx int, item_idx int, rating double")
    als = m.ALSModel(factors=3, iterations=1).fit(empty)
    assert als.user_factors.count() == 0 and als.predict(empty).count() == 0


def plain_training(u, i, r, emb, layers, epochs, lr, batch, seed):
    """Mini-batches on arrays, with Adam over whole tables: (losses, net)."""
    net = Net(0, 0, emb, layers, seed=seed)
    n_users, n_items = u.max() + 1, i.max() + 1
    rows = np.concatenate([np.random.default_rng([seed, b]).normal(size=(64, emb)) for b in range((n_users + n_items) // 64 + 1)])
    net.params |= {"user": rows[:n_users], "item": rows[n_users : n_users + n_items]}
    net.params = {k: x.astype(np.float32) for k, x in net.params.items()}
    m, v = ({k: np.zeros_like(x) for k, x in net.params.items()} for _ in range(2))
    t, losses = 0, []
    for epoch in range(epochs):
        rng, own = np.random.default_rng([seed, epoch, 0]), []
        order = rng.permutation(len(r))
        for a in range(0, len(r), batch):
            at, t = order[a : a + batch], t + 1
            loss, grads = net.gradients(u[at], i[at], r[at].astype(np.float32), rng)
            own.append(loss)
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.params[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        losses.append(float(np.mean(own)))
    return losses, net


def test_one_worker_is_plain_training(spark, lowrank):
    """Fit and predict equal mini-batch training with dense Adam on arrays, also if it goes on from what was written."""
    train, val, _ = time_split(lowrank)
    pdf = train.select("user_idx", "item_idx", "rating").toPandas().sort_values(["user_idx", "item_idx", "rating"])
    u, i, r = (pdf[c].to_numpy() for c in ("user_idx", "item_idx", "rating"))
    losses, net = plain_training(u, i, r, 4, (8,), 4, 0.01, 64, 5)
    for save_every in (10, 2):
        model = NeuralModel(emb_dim=4, layers=(8,), epochs=4, lr=0.01, batch_size=64, seed=5, workers=1, save_every=save_every).fit(train)
        assert np.allclose(losses, model.losses, rtol=2e-3)
        for row in model.predict(val).collect():
            y = net.forward(np.array([row.user_idx]), np.array([min(row.item_idx, model.n_items - 1)]))[0][0]
            assert row.prediction == pytest.approx(min(5.0, max(0.5, y)), abs=0.05)


def test_workers_take_the_steps_of_one(spark):
    """Losses by epoch stay within 2 % whatever the number of workers."""
    from tastegrid.plans import catalogue

    train = catalogue._split(spark, "/root/testdata/sf0.01")[0]
    losses = {n: NeuralModel(epochs=3, workers=n).fit(train).losses for n in (1, 4, 8)}
    for n in (4, 8):
        assert np.allclose(losses[n], losses[1], rtol=0.02)


def test_missed_steps_are_caught_up():
    from tastegrid.operators.neural import DenseAdam

    rng = np.random.default_rng(3)
    x, m, v = (rng.normal(size=(4, 3)).astype(np.float32) for _ in range(3))
    v, last = np.abs(v), np.array([0, 7, 30, 2])
    m[0], v[0] = 0, 0  # never used so far
    want = [a.astype(float) for a in (x, m, v)]
    for row, at in enumerate(last):
        for t in range(at + 1, 41):
            want[1][row] *= 0.9
            want[2][row] *= 0.999
            want[0][row] -= 0.01 * (want[1][row] / (1 - 0.9**t)) / (np.sqrt(want[2][row] / (1 - 0.999**t)) + 1e-8)
    DenseAdam(0.01, 50).catch_up(x, m, v, last, np.arange(4), 40)
    assert (last == 40).all()
    for got, a in zip((x, m, v), want, strict=True):
        assert np.allclose(got, a, atol=1e-5)


def test_heavy_users_are_dealt(spark, lowrank, monkeypatch):
    train, val, _ = time_split(lowrank)
    want = sorted((r.i, r.j, round(r.sim, 9)) for r in m.ItemKNN().fit(train).similarity().collect())
    monkeypatch.setattr(m, "USER_ROWS", 4)
    assert sorted((r.i, r.j, round(r.sim, 9)) for r in m.ItemKNN().fit(train).similarity().collect()) == want


def test_unseen_items_need_no_product(spark, lowrank):
    train, _, test = time_split(lowrank)
    users = spark.createDataFrame([(0,), (0,), (59,), (700,)], "user_idx int")
    found = ev.unseen_items(users, train)
    last = train.agg(F.max("item_idx")).first()[0]
    seen = {(r.user_idx, r.item_idx) for r in train.collect()}
    want = sorted((u, i) for u in (0, 59, 700) for i in range(last + 1) if (u, i) not in seen)
    assert sorted((r.user_idx, r.item_idx) for r in found.collect()) == want
    plan = ev.ranking_candidates(train, test)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("size", [1, 2, 3, 7, 97, 1000, 1009])
def test_permuted_is_a_bijection(spark, size):
    from tastegrid.functions.permute import grid, permuted

    a, b = grid(size)
    assert a * b - size < max(1, a)
    rows = spark.range(a * b).crossJoin(spark.createDataFrame([(0,), (1,), (2_000_000_000,)], "key long"))
    got = rows.select("key", permuted(F.col("id"), F.col("key"), (a, b)).alias("v")).toPandas()
    orders = [tuple(x["v"]) for _, x in got.groupby("key")]
    assert all(sorted(x) == list(range(a * b)) for x in orders)
    assert size < 90 or len(set(orders)) == 3


def test_sampled_negatives_are_unseen_and_lazy(spark, lowrank):
    """Each user's first n unseen items in the user's own order; users without so many are left out."""
    train, _, test = time_split(lowrank)
    users = spark.createDataFrame([(0,), (0,), (5,), (59,), (700,)], "user_idx int")
    more = spark.createDataFrame([(0, 3), (700, 1), (700, 1)], "user_idx int, item_idx int")
    size = train.agg(F.max("item_idx")).first()[0] + 1
    seen = {(r.user_idx, r.item_idx) for r in train.collect()} | {(0, 3), (700, 1)}
    free = {u: size - sum(x == u for x, _ in seen) for u in (0, 5, 59, 700)}
    for n in (1, min(free.values()), min(free.values()) + 1, size - 1, size):
        got = ev.sampled_negatives(users, train, more, n).toPandas()
        assert sorted(got["user_idx"].unique()) == sorted(u for u in free if free[u] >= n)
        for u, own in got.groupby("user_idx"):
            assert sorted(own["neg_pos"]) == list(range(n)) and own["item_idx"].is_unique
            assert not {(u, i) for i in own["item_idx"]} & seen and own["item_idx"].between(0, size - 1).all()
    few, many = (ev.sampled_negatives(users, train, more, n).orderBy("user_idx", "neg_pos").collect() for n in (2, 4))
    assert [(r.user_idx, r.item_idx) for r in many if r.neg_pos < 2] == [(r.user_idx, r.item_idx) for r in few if r.user_idx in {x.user_idx for x in many}]


def test_unseen_items_in_blocks(spark, lowrank, monkeypatch):
    train, _, test = time_split(lowrank)
    want = sorted(map(tuple, ev.unseen_items(test, train, test).collect()))
    monkeypatch.setattr(ev, "ITEM_BLOCK", 7)
    assert sorted(map(tuple, ev.unseen_items(test, train, test).collect())) == want


class Beside:
    """Peers that are threads of this process: `exchange` goes through a list they share."""

    def __init__(self, size):
        self.size, self.barrier, self.boxes = size, threading.Barrier(size, timeout=120), [None] * size

    def of(self, rank):
        peer = copy.copy(self)
        peer.rank = rank
        return peer

    def exchange(self, messages):
        self.boxes[self.rank] = list(messages)
        self.barrier.wait()
        got = [box[self.rank] for box in self.boxes]
        self.barrier.wait()
        return got


@pytest.mark.parametrize(("workers", "piece", "chunk"), [(1, 1 << 18, 1 << 18), (3, 50, 80), (5, 1000, 80)])
def test_als_in_pieces_equals_arrays(spark, monkeypatch, workers, piece, chunk):
    """Ratings dealt by Spark, read from files in pieces by several workers, give the factors of a run on arrays."""
    from tastegrid.operators import als

    monkeypatch.setattr(als, "PIECE", piece)
    monkeypatch.setattr(als, "CHUNK", chunk)
    rng = np.random.default_rng(9)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 500), rng.integers(0, 60, 500), strict=True)} | {(7, i) for i in range(300)})
    matrix = [(u, i, float(rng.normal())) for u, i in pairs]
    rows = spark.createDataFrame(matrix, "u long, i long, v double").repartition(5)
    batches = [[] for _ in range(workers)]
    for x in als.dealt(rows, len(matrix), workers).toArrow().to_batches(max_chunksize=37):
        for k in range(workers):
            batches[k].append(x.filter(pa.array(x.column(0).to_numpy() == k)))
    peers = Beside(workers)
    with ThreadPoolExecutor(workers) as pool:
        halves = list(pool.map(lambda k: als.fitted(peers.of(k), als.loaded(batches[k]), 4, 3, 0.1, 7), range(workers)))
    assert piece > 50 or all(len(half.bounds) > 3 for part in halves for half in part)
    for side, want in enumerate(plain_als(matrix, 4, 3, 0.1, 7)):
        got = [(i, x) for part in halves for i, x in zip(part[side].ids[part[side].mine()].tolist(), part[side].x[part[side].mine()], strict=True)]
        assert [i for i, _ in got] == sorted(want) and all(np.abs(x - want[i]).max() < 1e-6 for i, x in got)


def test_als_holds_no_ratings(monkeypatch):
    """A task's memory goes with its factors and its pieces, not with its ratings."""
    from tastegrid.operators import als

    monkeypatch.setattr(als, "PIECE", 5000)
    monkeypatch.setattr(als, "CHUNK", 5000)
    rng, peaks = np.random.default_rng(2), []
    for many in (100_000, 400_000):
        held = als.Rows(als.RATING), als.Rows(als.RATING)
        for x in held:
            for a in range(0, many, 10_000):
                rows = np.zeros(10_000, dtype=als.RATING)
                rows["own"], rows["other"] = np.arange(a, a + 10_000) * 1000 // many, rng.integers(0, 1000, 10_000)
                rows["v"] = rng.normal(size=10_000)
                x.put(a, rows)
        tracemalloc.start()
        als.fitted(Beside(1).of(0), held, 4, 1, 0.1, 7)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 300_000 * 8 + peaks[0]  # less than one number for each rating more


def test_long_ids_are_taken_in_pieces(monkeypatch):
    """What doesn't fit in a piece is summed in pieces, with the same factors."""
    from tastegrid.operators import als

    class Alone:
        rank, size = 0, 1

        def exchange(self, messages):
            return list(messages)

    monkeypatch.setattr(als, "CHUNK", 80)
    rng = np.random.default_rng(4)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 9, 150), rng.integers(0, 30, 150), strict=True)} | {(2, i) for i in range(30)})
    matrix = [(u, i, float(rng.normal())) for u, i in pairs]
    u, i, v = (np.array(c) for c in zip(*matrix, strict=True))
    users, items = als.Half(Alone(), u, i, v, 0, 4, 7), als.Half(Alone(), i, u, v, 1, 4, 7)
    users.meet(items)
    items.meet(users)
    assert 0 < len(users.long) < len(users.ids) and len(users.groups) and len(items.groups) > 1
    for _ in range(3):
        users.step(items, 0.1)
        items.step(users, 0.1)
    want = plain_als(matrix, 4, 3, 0.1, 7)
    for half, own in zip((users, items), want, strict=True):
        assert all(np.abs(x - own[k]).max() < 1e-6 for k, x in zip(half.ids.tolist(), half.x, strict=True))


def test_loader_gives_bad_lines_a_row_of_their_own(spark, tmp_path):
    ddl = "userId long, movieId long, rating double, timestamp long"
    lines = ["1::2::3::4", "", "1::NA::3.5::", "  ", "7::8", "1::2::3::4::5::6::7::8::9::10", "1::2::good::4", "+5:: 6 ::.5::9\r", "x::2::3::4::5", "1.5::2::3::4", "null::nan::None::<NA>"]
    (tmp_path / "a.dat").write_bytes("\n".join(lines).encode())
    path = str(tmp_path / "a.dat")
    for options in ({}, {"split": 9}, {"chunk": 3, "split": 20}):
        got = {r.pos.offset: tuple(r)[:4] for r in sources.read_delimited(spark, path, ddl, position=True, **options).collect()}
        starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
        assert got == {starts[0]: (1, 2, 3.0, 4), starts[2]: (1, None, 3.5, None), starts[4]: (7, 8, None, None), starts[7]: (5, 6, 0.5, 9), starts[10]: (None,) * 4}
        bad = {r.pos.offset: (r.line, r.error) for r in sources.rejected_lines(spark, path, ddl, **options).collect()}
        told = {5: "10 fields, 4 expected", 6: "rating is no double", 8: "5 fields, 4 expected", 9: "userId is no bigint"}
        assert bad == {starts[k]: (lines[k], x) for k, x in told.items()}
        raw = {r.pos.offset: bytes(r.line) for r in sources.read_lines(spark, path, **options).collect()}
        assert raw == {s: x.encode() for s, x in zip(starts, lines, strict=True)}


def test_loader_of_folders_encodings_and_nothing(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    (folder / "b.dat").write_bytes(b"3::c\n")
    (folder / "a.dat").write_bytes(b"\xef\xbb\xbf1::caf\xc3\xa9 \"x\"\n2::\xff\xe2\x82\n")
    (folder / "_SUCCESS").write_bytes(b"9::z\n")
    (folder / "empty.dat").write_bytes(b"")
    got = sources.read_delimited(spark, str(folder), "id long, t string", position=True).orderBy("pos").collect()
    assert [(r.id, r.t) for r in got] == [(1, 'café "x"'), (2, "��"), (3, "c")]
    (tmp_path / "l.dat").write_bytes(b"1::\xe9\n")
    assert sources.read_delimited(spark, str(tmp_path / "l.dat"), "id long, t string", "ISO-8859-1").first().t == "é"
    assert sources.read_delimited(spark, str(folder / "empty.dat"), "id long, t string").count() == 0
    with pytest.raises(ValueError):
        sources.read_delimited(spark, str(folder), "id long", "UTF-16")


@pytest.mark.parametrize("n", [0, 3, 13, 60])
def test_split_files_byte_for_byte(spark, tmp_path, n):
    lines = [f"{k * 7 % 4}::{k}::{k % 5}::{'é' * (k % 3)}".encode("latin-1") + b"\n" for k in range(n)]
    (tmp_path / "ratings.dat").write_bytes(b"".join(lines))
    size, rest = divmod(n, 5)
    want = {}
    for i in range(1, 6):  # heads and tails of the file
        left = lines[n - rest :]
        want[f"r{i}.test"] = lines[: i * size][-size:] * bool(size) + left * (i == 5)
        want[f"r{i}.train"] = lines[: (i - 1) * size] + lines[n - (5 - i) * size :] + left * (i < 5)
    for name, start, stop in (("ra", 1, 10), ("rb", 11, 20)):
        seen, out = {}, ([], [])
        for x in lines:
            user = x.split(b"::")[0]
            seen[user] = seen.get(user, 0) + 1
            out[start <= seen[user] <= stop].append(x)
        want[f"{name}.train"], want[f"{name}.test"] = out
    read = sources.read_lines(spark, str(tmp_path / "ratings.dat"), split=64)
    for _ in range(2):  # a second run replaces the files
        split_files(read, str(tmp_path / "out"))
    assert {x.name: x.read_bytes() for x in (tmp_path / "out").iterdir()} == {k: b"".join(v) for k, v in want.items()}
    split_files(read, str(tmp_path / "exact"), mode="exact")
    whole = sorted(lines)
    for i in range(1, 6):
        parts = [(tmp_path / "exact" / f"r{i}.{part}").read_bytes().splitlines(keepends=True) for part in ("train", "test")]
        assert sorted(parts[0] + parts[1]) == whole and parts[0] == [x for x in lines if x not in parts[1]]


def test_ranges_hold_each_line_once():
    data = b"ab\n\nlonger line\nx\n" + b"y" * 30 + b"\nlast"
    begins = [0, 3, 4, 16, 18, 49]
    for split in range(1, len(data) + 2):
        for chunk in (1, 4, 100):
            got = []
            for a in range(0, len(data), split):
                for start, part in whole_lines(io.BytesIO(data), a, min(a + split, len(data)), chunk):
                    assert data[start : start + len(part)] == part and (part.endswith(b"\n") or start + len(part) == len(data))
                    got += [start] + [start + k + 1 for k in range(len(part) - 1) if part[k] == 10]
            assert got == begins


@pytest.mark.parametrize("make", [m.GlobalMean, m.BiasModel, lambda: m.ItemKNN(5), lambda: m.ALSModel(factors=3, iterations=2, workers=2), lambda: NeuralModel(emb_dim=4, layers=(8, 4), epochs=2, workers=2)])
def test_saved_models_predict_as_before(spark, lowrank, tmp_path, make):
    train, val, _ = time_split(lowrank)
    asked = val.select("user_idx", "item_idx").unionByName(spark.createDataFrame([(0, 999), (999, 0), (999, 999)], "user_idx int, item_idx int"))
    model, path = make().fit(train), str(tmp_path / "model")
    save_model(model, path, train)
    again = load_model(spark, path)
    assert type(again) is type(model) and {x: getattr(again, x) for x in model.VALUES if x != "layers"} == {x: getattr(model, x) for x in model.VALUES if x != "layers"}
    before, after = ({(r.user_idx, r.item_idx): r.prediction for r in x.predict(asked).collect()} for x in (model, again))
    assert before.keys() == after.keys() and all(after[k] == pytest.approx(x, abs=1e-12) for k, x in before.items())
    if isinstance(model, m.ALSModel):
        assert [r.item_idx for r in again.recommend(0, 5).collect()] == [r.item_idx for r in model.recommend(0, 5).collect()]
    assert load_ids(spark, path).count() == train.select("userId", "movieId").distinct().count()


def test_unfinished_models_do_not_load(spark, lowrank, tmp_path):
    train = time_split(lowrank)[0]
    path = str(tmp_path / "model")
    save_model(m.BiasModel().fit(train), path)
    with pytest.raises(Exception, match="exist"):
        save_model(m.BiasModel().fit(train), path)
    with pytest.raises(NoModel, match="without the ids"):
        load_ids(spark, path)
    (tmp_path / "model" / "manifest" / "_SUCCESS").unlink()
    for wrong in (path, str(tmp_path / "nothing")):
        with pytest.raises(NoModel, match="no whole model"):
            load_model(spark, wrong)


def test_cli_serves_a_saved_model(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    lines = [f"{u}::{i}::{rng.integers(1, 6)}::{1000 + t}" for u in range(1, 21) for t, i in enumerate(rng.permutation(30)[:15] + 1)]
    (tmp_path / "ratings.dat").write_text("\n".join(lines) + "\n")
    (tmp_path / "movies.dat").write_text("1::One::Drama\n")
    saved, data = str(tmp_path / "knn"), ["--data", str(tmp_path)]
    assert cli.main(["--user", "1", "--model", "knn", "--topn", "4", "--save", saved, *data], spark) == 0
    first = capsys.readouterr().out
    (tmp_path / "ratings.dat").unlink()
    assert cli.main(["--user", "1", "--topn", "4", "--fitted", saved, *data], spark) == 0
    assert capsys.readouterr().out == first and "Top 4 recommendations for User 1 (KNN)" in first
    assert cli.main(["--user", "99", "--fitted", saved, *data], spark) == 1
    assert "User 99 not found. Valid range: 1 - 20" in capsys.readouterr().out
    assert cli.main(["--user", "1", "--fitted", str(tmp_path / "none"), *data], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["--user", "1", "--model", "als", "--fitted", saved, *data], spark)


def test_products_by_ranges(spark, lowrank, monkeypatch):
    """Ranges, pieces of products and the way by single items give what the self-join gives, and no product is shuffled."""
    from tastegrid.operators import products

    train, val, _ = time_split(lowrank)
    knn = m.ItemKNN(5).fit(train)
    sims = {(r.i, r.j): round(r.sim, 10) for r in knn.similarity().collect()}
    want = {}
    for i in {i for i, _ in sims}:
        own = sorted((-s, j) for (a, j), s in sims.items() if a == i and s > 0)
        want |= {(i, r): (j, -s) for r, (s, j) in enumerate(own[:5], start=1)}
    rated = {}
    for r in knn.matrix.collect():
        rated.setdefault(r.user_idx, []).append(r.item_idx)
    near = {(r.user_idx, r.item_idx, j): sims[r.item_idx, j] for r in val.collect() for j in rated[r.user_idx] if sims.get((r.item_idx, j), 0) != 0}
    for ranges, pieces, few in ((1, 1 << 20, 0), (3, 7, 0), (40, 50, 0), (4, 100, 10**6)):
        monkeypatch.setattr(products, "RANGES", ranges)
        monkeypatch.setattr(m, "FEW_USERS", few)
        for cut in {pieces, 1 << 20}:
            # tasks take the module as it is written, so pieces are tried here
            by = products.by_ranges(knn.matrix, knn.norms, products.item_ranges(knn.matrix)).toArrow()
            monkeypatch.setattr(products, "PRODUCTS", cut)
            first = (by["low"].to_numpy() == 0) & (by["high"].to_numpy() == 0)
            one = [by[c].to_numpy()[first] for c in ("user_idx", "item_idx", "x")]
            found = [(int(k >> 32), int(k & 0xFFFFFFFF), d) for keys, ds in products.sums(one, one) for k, d in zip(keys.tolist(), ds.tolist(), strict=True)]
            assert len({x[:2] for x in found}) == len(found)
            assert all(abs(d - sims.get((i, j), 0)) < 2e-10 for i, j, d in found if i != j)
        got = {(r.i, r.r): (r.j, r.s) for r in knn.most_similar(5).collect()}
        assert {k: j for k, (j, _) in got.items()} == {k: j for k, (j, _) in want.items()}
        some = {r.i for r in knn.most_similar(5, val.where("item_idx < 9")).collect()}
        assert some == {i for i, _ in want} & {r.item_idx for r in val.where("item_idx < 9").collect()}
        got = {(r.user_idx, r.i, r.j): r.s for r in knn._near(val).collect()}
        assert got.keys() == near.keys() and all(abs(got[k] - near[k]) < 2e-10 for k in near)
    # The rows that meet in the join of the matrix with itself were what was grouped by i and j.
    monkeypatch.setattr(m.ItemKNN, "similarity", None)
    assert knn.most_similar(5).count() == len(want)


def test_asked_products_by_blocks_of_users(spark, lowrank, monkeypatch):
    """Any number of blocks, rows of a user and pieces give the same; an entry goes to one block, wherever its user's items lie."""
    from tastegrid.operators import products

    train, val, _ = time_split(lowrank)
    knn = m.ItemKNN(5).fit(train)
    v = {(r.user_idx, r.item_idx): r.v for r in knn.matrix.collect()}
    of = {}
    for (u, i), x in v.items():
        of.setdefault(i, {})[u] = x
    asked = {(r.user_idx, r.item_idx) for r in val.collect()} | {(0, i) for i in of}
    dot = lambda i, j: sum(x * of[j][u] for u, x in of.get(i, {}).items() if u in of[j])
    want = {(u, i, j): dot(i, j) for u, i in asked for w, j in v if w == u and j != i}
    want = {k: d for k, d in want.items() if abs(d) > 1e-12}
    pairs = spark.createDataFrame(sorted(asked), "user_idx int, i int")
    for blocks, rows in ((1, 1000), (7, 3), (130, 1000)):
        monkeypatch.setattr(products, "BLOCKS", blocks)
        monkeypatch.setattr(products, "ROW_ASKED", rows)
        got = {(r.user_idx, r.i, r.j): r.d for r in products.dots_of(pairs, knn.matrix).collect() if abs(r.d) > 1e-12}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    user, item = (np.array(x, dtype=np.int32) for x in zip(*v, strict=True))
    starts, items = np.array([0, 3, 3, 7]), np.array([1, 2, 5, 0, 2, 4, 9], dtype=np.int32)
    for pieces in (1, 5, 1 << 20):
        found = products.asked_sums((np.array([3, 0, 3, 99]), np.array([0, 2, 2, 1]), (starts, items)), (user, item, np.array(list(v.values()))), pieces)
        got = {(of_row, i, j): d for x in found for of_row, i, j, d in zip(*(y.tolist() for y in x), strict=True)}
        pieced = {(r, i, j): dot(i, j) for r, i, own in ((0, 3, (1, 2, 5)), (2, 0, (0, 2, 4, 9)), (2, 3, (0, 2, 4, 9))) for j in own if i != j}
        pieced = {k: d for k, d in pieced.items() if d != 0}
        assert got.keys() == pieced.keys() and all(got[k] == pytest.approx(pieced[k]) for k in got)
    # Entries were copied for each range of items that their user has.
    monkeypatch.setattr(m, "by_ranges", None)
    monkeypatch.setattr(m, "FEW_USERS", 0)
    assert knn.predict(val).count() == val.count()


def test_neighbours_of_one_user_leave_other_rows_alone(spark, monkeypatch):
    """Products are made of the rows of those who rated an item of the user, which no shuffle of the others finds."""
    rows = spark.createDataFrame([(u, (7 * u + 13 * k) % 4000, float(1 + (u * k) % 5)) for u in range(900) for k in range(2, 12)], "user_idx int, item_idx int, rating double").distinct()
    knn = m.ItemKNN(5).fit(rows)
    wanted = ev.unseen_items(spark.createDataFrame([(3,)], "user_idx int"), rows)
    seen = []
    plain = m.ItemKNN.similarity
    monkeypatch.setattr(m.ItemKNN, "similarity", lambda self, lefts, rights, matrix=None: seen.append((self.matrix if matrix is None else matrix).count()) or plain(self, lefts, rights, matrix))
    got = {(r.user_idx, r.i, r.j): r.s for r in knn._near(wanted).collect()}
    assert len(seen) == 1 and seen[0] < knn.matrix.count() / 10
    monkeypatch.setattr(m, "FEW_USERS", 0)
    want = {(r.user_idx, r.i, r.j): r.s for r in knn._near(wanted).collect()}
    assert got and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-10) for k in want)


def test_ratings_are_made_once_for_both_indexes(spark):
    """Nothing of the join of orders and lines, or of a file, is left in the plan of indexed ratings."""
    found = sources.indexed_interactions(spark, "/root/testdata/sf0.001")
    assert not [x for x in found.inputFiles() if "lineitem" in x or "orders" in x]
    old = indexed(sources.interactions(spark, "/root/testdata/sf0.001")).select(*found.columns)
    assert found.exceptAll(old).count() == 0 and old.exceptAll(found).count() == 0


def test_split_files_write_a_line_three_times(spark, tmp_path, monkeypatch):
    """Once for all folds, whose files are runs of the same lines, and once for each of ra and rb."""
    from tastegrid.operators import splits

    written = []
    monkeypatch.setattr(splits, "join_parts", lambda df, *rest: written.append(df.count()))
    (tmp_path / "ratings.dat").write_bytes(b"".join(b"%d::%d::3\n" % (k % 4, k) for k in range(63)))
    for mode in ("compat", "exact"):
        split_files(sources.read_lines(spark, str(tmp_path / "ratings.dat")), str(tmp_path / mode), mode)
    assert written == [3 * 63, 3 * 63]


@pytest.mark.parametrize("span", [5, 4000])
def test_rows_are_summed(span):
    from tastegrid.operators.neural import summed

    rng = np.random.default_rng(6)
    index = np.unique(rng.integers(0, span, 1000), return_inverse=True)[1]
    g = rng.normal(size=(1000, 3))
    want = np.zeros((index.max() + 1, 3))
    np.add.at(want, index, g)
    assert np.allclose(summed(index, g), want)


@pytest.mark.parametrize("workers", [1, 3])
def test_workers_beside_each_other_train_alike(workers):
    """Steps on rows held with their moments equal training with dense Adam on arrays; several workers' losses are near."""
    from tastegrid.operators.neural import Share, Worker

    rng = np.random.default_rng(12)
    u, i, r = rng.integers(0, 90, 3000), rng.integers(0, 70, 3000), rng.integers(1, 6, 3000).astype(float)
    u[0], i[0] = 89, 69
    losses, net = plain_training(u, i, r, 4, (8,), 3, 0.01, 64, 5)
    peers, counts = Beside(workers), [len(r[k::workers]) for k in range(workers)]

    def run(k):
        own = Net(0, 0, 4, (8,), seed=5)
        share = Share(160, workers, k, 4, 5)
        worker = Worker(peers.of(k), share, own, np.zeros((2, sum(x.size for x in own.layers().values()))), counts, 64, 0.01, 3)
        told = [worker.epoch(e, u[k::workers], i[k::workers] + 90, r[k::workers].astype(np.float32), 5) for e in range(3)]
        at = np.flatnonzero(share.row() < 160)
        worker.adam.catch_up(share.x, share.m, share.v, share.last, at, 3 * worker.steps)
        return told, share.row()[at], share.x[at]

    with ThreadPoolExecutor(workers) as pool:
        found = list(pool.map(run, range(workers)))
    assert np.allclose(np.sum([x for x, _, _ in found], axis=0), losses, rtol=2e-3 if workers == 1 else 0.05)
    rows = np.concatenate([x for _, x, _ in found])
    assert sorted(rows.tolist()) == list(range(160))
    if workers == 1:
        want = np.concatenate([net.params["user"], net.params["item"]])
        assert np.abs(found[0][2] - want[rows]).max() < 0.02


@pytest.mark.parametrize(("name", "model"), [("ranking_metrics_als", m.ALSModel), ("ranking_metrics_neural", NeuralModel)])
def test_ranking_takes_every_user(spark, monkeypatch, name, model):
    """Every user with a relevant test item is ranked, and no more than the first 500 were."""
    asked = []
    monkeypatch.setattr(model, "fit", lambda self, train: self)
    monkeypatch.setattr(model, "predict", lambda self, df: asked.append(df) or df.withColumn("prediction", -F.col("item_idx").cast("double")))
    d = "/root/testdata/sf0.01"
    got = {(r.metric, r.k): r.value for r in QUERIES[name](spark, d).collect()}
    test = time_split(sources.indexed_interactions(spark, d))[2].where("rating >= 4").select("user_idx", "item_idx").toPandas()
    rows = asked[0].toPandas()
    assert len(test) > 500 and set(rows["user_idx"]) == set(test["user_idx"]) and len(rows) == 100 * len(test)
    rows = rows.merge(test.rename(columns={"item_idx": "hit"}), on="user_idx")
    place = (rows["item_idx"] <= rows["hit"]).groupby(rows["user_idx"]).sum()
    assert got["R", 10] == pytest.approx((place <= 10).mean(), abs=1e-6)


def test_pairs_are_scored_by_blocks(spark, monkeypatch):
    """Any number of blocks gives the same; rows, columns and repeats stay, ids without a vector and null ones have no score."""
    from tastegrid.operators import blocks

    rng = np.random.default_rng(8)
    u, i = rng.normal(size=(30, 3)), rng.normal(size=(50, 3))
    tables = [spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(y) if k != 4], "id int, vector array<double>").repartition(3) for y in (u, i)]
    pairs = [(int(a), int(b), f"{a} {b}") for a, b in zip(rng.integers(0, 32, 400), rng.integers(0, 52, 400), strict=True)]
    pairs += [pairs[0], (None, 3, "x"), (3, None, "y")]
    df = spark.createDataFrame(pairs, "a int, b int, more string")
    want = sorted((str(p), None if None in p or 4 in p[:2] or p[0] > 29 or p[1] > 49 else float(u[p[0]] @ i[p[1]])) for p in pairs)
    for size in (4, 1000):
        monkeypatch.setattr(blocks, "VECTORS", size)
        found = blocks.pair_scores(df, [(F.col("a"), tables[0]), (F.col("b"), tables[1])], lambda x, y: (x * y).sum(axis=1), "s")
        assert found.columns == ["a", "b", "more", "s"]
        got = sorted((str((r.a, r.b, r.more)), r.s) for r in found.collect())
        assert [k for k, _ in got] == [k for k, _ in want]
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-12) for (_, x), (_, y) in zip(got, want, strict=True))
        assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_als_holds_no_lists_of_what_is_asked_for(monkeypatch):
    """What tasks ask each other for goes with the ratings, so it lies in a file and is read piece by piece."""
    from tastegrid.operators import als

    monkeypatch.setattr(als, "PIECE", 5000)
    monkeypatch.setattr(als, "CHUNK", 5000)
    peaks = []
    for many in (100_000, 400_000):
        held = als.Rows(als.RATING), als.Rows(als.RATING)
        for x in held:
            rows = np.zeros(many, dtype=als.RATING)
            rows["own"], rows["other"], rows["v"] = np.arange(many) * 20_000 // many, np.arange(many) * 7919 % 20_000, 1.5
            x.put(0, rows)
        tracemalloc.start()
        als.fitted(Beside(1).of(0), held, 4, 1, 0.1, 7)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 300_000 * 4 + peaks[0]  # two lists of four bytes for each rating more were held


def test_runs_are_found_by_table_and_by_search():
    from tastegrid.operators import products

    for held in ([], [0], [2, 2, 3, 9, 9, 9], [5, 10**8, 10**8], [-3, 1, 1]):
        held, wanted = np.array(held, dtype=np.int32), np.array([9, 2, 0, 1, 10, -3, -1, 10**8, 5], dtype=np.int32)
        first, count = products.runs_of(held, wanted)
        assert count.tolist() == [int((held == x).sum()) for x in wanted]
        assert all((held[a : a + n] == x).all() for a, n, x in zip(first, count, wanted, strict=True) if n)


def test_entries_of_scattered_users_are_written_once(spark, monkeypatch):
    """However many ranges or blocks there are, an entry is in one row of one file; it went to every pair of ranges, or a user's
    items to every block with a rater."""
    from tastegrid.operators import products

    rng = np.random.default_rng(6)
    rows = sorted({(u, int(i), float(1 + (u + i) % 5)) for u in range(120) for i in rng.integers(0, 600, 12)})
    train = spark.createDataFrame(rows, "user_idx int, item_idx int, rating double")
    knn = m.ItemKNN(5).fit(train)
    many, written = knn.matrix.count(), []
    for name in ("laid", "sized"):
        plain = getattr(products, name)

        def kept(df, folder, plain=plain):
            written.append(df.select(F.explode("items")).count() if "items" in df.columns else df.count())
            return plain(df, folder)

        monkeypatch.setattr(products, name, kept)
    monkeypatch.setattr(products, "RANGES", 30)
    monkeypatch.setattr(m, "FEW_USERS", 0)
    best = {(r.i, r.j): r.s for r in knn.most_similar(3).collect()}
    sims = {(r.i, r.j): round(r.sim, 10) for r in knn.similarity().collect()}
    assert best and all(abs(s - sims[k]) < 2e-10 for k, s in best.items())
    knn.predict(train).count()
    assert written == [many, many]


def test_the_split_is_stored_by_column(spark):
    """Of what was cached, pos and both ids took most, in memory or on executors' disks, for queries that read indexes and ratings only."""
    from tastegrid.plans import catalogue

    for part in catalogue._split(spark, "/root/testdata/sf0.001"):
        plan = part.groupBy("user_idx").agg(F.avg("rating"))._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and "movieId" not in plan.split("ReadSchema")[1]


def test_split_files_leave_no_copies(spark, tmp_path):
    """Lines that a file has in order are neither sorted nor written again to be numbered, and parts that one file has go before the others
    are joined."""
    from tastegrid.operators import splits
    from tastegrid.session import stored_dir
    from tastegrid.sources import textfiles

    source = tmp_path / "ratings.dat"
    source.write_bytes(b"".join(b"%d::%d::3\n" % (k % 4, k) for k in range(5000)))
    lines = sources.read_lines(spark, str(source), split=999)
    numbered = splits.number_rows(lines, ["pos"], "n", start=1)
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert [(r.n, bytes(r.line)) for r in numbered.orderBy("n").collect()] == list(enumerate(source.read_bytes().splitlines(), start=1))
    assert [r.n for r in splits.number_rows(lines.where("pos.offset > 99"), ["pos"], "n").orderBy("pos").collect()] == list(range(numbered.where("pos.offset > 99").count()))
    seen = []
    plain = textfiles._join

    def join(spark, jobs):
        held = [x for x in Path(stored_dir(spark)).glob("parts-*/file=*")]
        seen.append((sorted(name.rpartition("/")[2] for name, _ in jobs), len(held)))
        plain(spark, jobs)

    textfiles._join = join
    try:
        split_files(lines, str(tmp_path / "out"))
    finally:
        textfiles._join = plain
    assert [x for x, _ in seen][0] == ["ra.test", "ra.train", "rb.test", "rb.train"] and len(seen) == 2
    assert seen[1][1] == seen[0][1] - 4
