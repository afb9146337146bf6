"""Registered queries over the driver's tables, each with an independent SQL oracle where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import dot
from ..functions.permute import permuted_sql
from ..operators import evaluate as ev
from ..operators import models as m
from ..operators.encode import id_index
from ..operators.neural import Net, NeuralModel, perceptron_scores
from ..operators.saved import load_model, save_model
from ..operators.splits import allbut, kfold, split_files, time_split, with_rank
from ..session import stored, stored_dir
from ..sources.textfiles import write_ordered_text

FILE_ORDER = ["pos", "userId", "timestamp", "rating"]
#: The user whose recommendations are shown, and one that no table has.
USER, NOBODY = 7, -1


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return sources.indexed_interactions(spark, d)


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ranked = with_rank(_ratings(spark, d)).select("userId", "movieId", "user_idx", "item_idx", "rating", "timestamp", "pos", "rank")
    ranked = stored(ranked, "ranked")  # a third of what it takes in memory, and read by column
    return ranked.where("rank >= 2"), ranked.where("rank = 1"), ranked.where("rank = 0")


def _rows(df: DataFrame, *more: str) -> DataFrame:
    long = [F.col(c).cast("long").alias(a) for c, a in (("userId", "user_id"), ("movieId", "item_id"))]
    return df.select(*long, "rating", F.col("timestamp").cast("long").alias("ts"), F.col("pos.o").alias("o"), F.col("pos.l").alias("l"), *[F.col(c).cast("long").alias(c) if c in ("rank", "fold") else F.col(c) for c in more])


def _scored(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_idx").cast("long").alias("user_idx"), F.col("item_idx").cast("long").alias("item_idx"), "rating", F.round("prediction", 6).alias("prediction"))


def _metrics(df: DataFrame) -> DataFrame:
    return ev.rating_metrics(df).select(F.round("RMSE", 6).alias("rmse"), F.round("MAE", 6).alias("mae"))


def _ranking(model: m.Recommender, train: DataFrame, test: DataFrame, per_user: bool = False, max_users: int | None = 500) -> DataFrame:
    found = ev.user_metrics(model.predict(ev.ranking_candidates(train, test, max_users=max_users)))
    if per_user:
        return found.select(F.col("user_idx").cast("long").alias("user_idx"), F.col("k").cast("long").alias("k"), *[F.round(c, 6).alias(c.lower()) for c in ("P", "R", "NDCG")])
    return ev.ranking_metrics(found).select("metric", F.col("k").cast("long").alias("k"), F.round("value", 6).alias("value"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Bias-model predictions for the validation rows."""
    train, val, _ = _split(spark, d)
    return _scored(m.BiasModel().fit(train).predict(val))


def _with(split_part: str, f: Callable) -> Callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, val, test = _split(spark, d)
        return f(train, {"val": val, "test": test, "train": train}[split_part])

    return query


def _ratings_file(spark: SparkSession, d: str) -> str:
    """A folder with the interactions as `ratings.dat`, in file order."""
    rows, path = sources.interactions(spark, d), f"{stored_dir(spark)}/dat-{uuid.uuid4().hex}"
    line = F.concat_ws("::", "userId", "movieId", F.col("rating").cast("int"), "timestamp")
    write_ordered_text(rows.select(F.lit("ratings.dat").alias("name"), F.struct(*FILE_ORDER).alias("place"), line.alias("line")), path, ["ratings.dat"])
    return path


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """The interactions written as a `::` file and loaded; `start` is the byte where a line begins."""
    rows = sources.load_ratings(spark, _ratings_file(spark, d))
    long = [F.col(c).cast("long").alias(c) for c in ("user_idx", "item_idx")]
    return rows.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating", F.col("timestamp").alias("ts"), *long, F.col("pos.offset").alias("start"))


def _split_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that the split script makes of the interactions, read back: each line and the byte where it begins."""
    path = _ratings_file(spark, d)
    split_files(sources.read_lines(spark, f"{path}/ratings.dat"), f"{path}/split")
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ratings.dat")
    whole.getFileSystem(spark._jsc.hadoopConfiguration()).delete(whole, False)  # the query's own, not read again
    lines = sources.read_lines(spark, f"{path}/split")
    name = F.substring_index("pos.file", "/", -1).alias("name")
    return lines.select(name, F.col("pos.offset").alias("start"), F.col("line").cast("string").alias("line"))


def _saved(train: DataFrame, val: DataFrame) -> DataFrame:
    """Predictions of a model that was saved and loaded again."""
    path = f"{stored_dir(train.sparkSession)}/model-{uuid.uuid4().hex}"
    save_model(m.ItemKNN().fit(train), path, train)
    return _scored(load_model(train.sparkSession, path).predict(val))


def _bias(train: DataFrame, side: str) -> DataFrame:
    found = getattr(m.BiasModel().fit(train), f"{side}_bias")
    return found.select(F.col(f"{side}_idx").cast("long").alias(f"{side}_idx"), F.round(f"{side}_bias", 6).alias("bias"))


def _folds(mode: str) -> Callable:
    return lambda spark, d: _rows(kfold(sources.interactions(spark, d), FILE_ORDER, mode=mode), "fold", "part")


def _allbut(start: int, stop: int, cap: int) -> Callable:
    return lambda spark, d: _rows(allbut(sources.interactions(spark, d), FILE_ORDER, start, stop, cap), "part")


def _residual(train: DataFrame) -> DataFrame:
    return m.residuals(train, m.BiasModel().fit(train)).select(F.col("user_idx").cast("long").alias("user_idx"), F.col("item_idx").cast("long").alias("item_idx"), "rating", F.round("residual", 6).alias("residual"))


def _matrix(train: DataFrame) -> DataFrame:
    return m.residual_matrix(train, m.BiasModel().fit(train)).select(F.col("user_idx").cast("long").alias("user_idx"), F.col("item_idx").cast("long").alias("item_idx"), F.round("v", 6).alias("v"))


def _norms(train: DataFrame) -> DataFrame:
    return m.ItemKNN().fit(train).norms.select(F.col("item_idx").cast("long").alias("item_idx"), F.round("norm", 6).alias("norm"))


def _similar(train: DataFrame, val: DataFrame | None = None) -> DataFrame:
    """The 5 most similar items of each item, or of each item rated in val, by similarity over their common raters."""
    top = m.ItemKNN().fit(train).most_similar(5, val)
    return top.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("s", 6).alias("sim"), F.col("r").cast("long").alias("r"))


def _unseen(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = _split(spark, d)
    relevant = ev.relevant_items(test)
    return ev.unseen_items(relevant, train, relevant).select(*[F.col(c).cast("long").alias(c) for c in ("user_idx", "item_idx")])


def _negatives(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = _split(spark, d)
    found = ev.ranking_candidates(train, test).where("not is_relevant")
    return found.select(F.col("user_idx").cast("long").alias("user_idx"), F.col("item_idx").cast("long").alias("item_idx"), F.col("cand_pos").cast("long").alias("cand_pos"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    train, _, test = _split(spark, d)
    columns = [F.col(c).cast("long").alias(c) for c in ("user_idx", "item_idx", "cand_pos")]
    return ev.ranking_candidates(train, test).select(*columns, "is_relevant")


def _ranked(make: Callable, per_user: bool = False, max_users: int | None = 500) -> Callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, _, test = _split(spark, d)
        return _ranking(make().fit(train), train, test, per_user, max_users)

    return query


def _topn(make: Callable, user: int) -> Callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, _, _ = _split(spark, d)
        try:
            user_idx = ev.user_index(train, user)
        except ev.UnknownUser:
            return spark.createDataFrame([], "rank long, item_id long, title string, score double")
        found = ev.recommend(make().fit(train), user_idx, train, sources.items(spark, d))
        return found.select(F.col("rank").cast("long").alias("rank"), "item_id", "title", "score")

    return query


def _als_recommend(spark: SparkSession, d: str) -> DataFrame:
    train, _, _ = _split(spark, d)
    return m.ALSModel().fit(train).recommend(USER).select(F.col("item_idx").cast("long").alias("item_idx"), "score")


def _factor_dot(spark: SparkSession, d: str) -> DataFrame:
    """The score by factors of each interaction, with the fixed vectors as factors; a row without one scores 0."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    users, items = (v.select(F.col("vec_id").alias(f"{side}_idx"), F.col("embedding").alias(name)) for side, name in (("user", "u"), ("item", "i")))
    joined = _ratings(spark, d).join(users, "user_idx", "left").join(items, "item_idx", "left")
    return joined.select(F.col("user_idx").cast("long").alias("user_idx"), F.col("item_idx").cast("long").alias("item_idx"), F.col("pos.o").alias("o"), F.col("pos.l").alias("l"), F.round(dot(F.col("u"), F.col("i")), 5).alias("score"))


#: Widths of the network's layers, the joined embeddings first.
WIDTHS = (64, 64, 32, 16, 1)


def _mlp_forward(spark: SparkSession, d: str) -> DataFrame:
    """The network's value for each fixed vector, taken as joined embeddings, with weights given by a rule."""
    net = Net(0, 0, WIDTHS[0] // 2, WIDTHS[1:-1])
    for n, (a, b) in enumerate(zip(WIDTHS[:-1], WIDTHS[1:], strict=True)):
        j, k = np.arange(a)[:, None], np.arange(b)
        net.params[f"w{n}"], net.params[f"b{n}"] = ((7 * j + 3 * k + n) % 11 - 5) / 20, (k % 5 - 2) / 10
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return perceptron_scores(rows, net, "embedding", "value").select("vec_id", F.round("value", 6).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "interactions": lambda s, d: _rows(sources.interactions(s, d)),
    "interactions_half_star": lambda s, d: _rows(sources.interactions(s, d, half_stars=True)),
    "id_index_users": lambda s, d: id_index(sources.interactions(s, d), "userId", "user_idx").select(F.col("userId").alias("user_id"), F.col("user_idx").cast("long").alias("user_idx")),
    "id_index_items": lambda s, d: id_index(sources.interactions(s, d), "movieId", "item_idx").select(F.col("movieId").alias("item_id"), F.col("item_idx").cast("long").alias("item_idx")),
    "items_titles": lambda s, d: sources.items(s, d).select(F.col("movieId").alias("item_id"), "title", "genres"),
    "users_profile": lambda s, d: sources.users(s, d).select(F.col("userId").alias("user_id"), "segment", F.col("nation").cast("long").alias("nation")),
    "tag_counts": lambda s, d: sources.tags(s, d).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("userId").alias("n_users")),
    "time_split_train": lambda s, d: _rows(time_split(sources.interactions(s, d))[0], "rank"),
    "time_split_val": lambda s, d: _rows(time_split(sources.interactions(s, d))[1], "rank"),
    "time_split_test": lambda s, d: _rows(time_split(sources.interactions(s, d))[2], "rank"),
    "split_counts": lambda s, d: with_rank(sources.interactions(s, d)).groupBy(F.expr("case rank when 0 then 'test' when 1 then 'val' else 'train' end").alias("part")).agg(F.count("*").alias("n"), F.countDistinct("userId").alias("n_users")),
    "kfold_exact": _folds("exact"),
    "kfold_compat": _folds("compat"),
    "allbut_1_10": _allbut(1, 10, 0),
    "allbut_11_20": _allbut(11, 20, 0),
    "allbut_capped": _allbut(1, 10, 1000),
    "loaded_ratings": _loaded,
    "split_files": _split_files,
    "global_mean": _with("val", lambda train, val: m.GlobalMean().fit(train).predict(val).groupBy(F.round("prediction", 6).alias("prediction")).agg(F.count("*").alias("n"))),
    "user_bias": _with("train", lambda train, _: _bias(train, "user")),
    "item_bias": _with("train", lambda train, _: _bias(train, "item")),
    "bias_predict_val": flagship,
    "residuals": _with("train", lambda train, _: _residual(train)),
    "residual_matrix": _with("train", lambda train, _: _matrix(train)),
    "rating_metrics_global_mean": _with("val", lambda train, val: _metrics(m.GlobalMean().fit(train).predict(val))),
    "rating_metrics_bias": _with("val", lambda train, val: _metrics(m.BiasModel().fit(train).predict(val))),
    "item_norms": _with("train", lambda train, _: _norms(train)),
    "item_similarity_topk": _with("val", _similar),
    "item_similarity_all": _with("train", lambda train, _: _similar(train)),
    "knn_predict_val": _with("val", lambda train, val: _scored(m.ItemKNN().fit(train).predict(val))),
    "rating_metrics_knn": _with("val", lambda train, val: _metrics(m.ItemKNN().fit(train).predict(val))),
    "unseen_items": _unseen,
    "sampled_negatives": _negatives,
    "ranking_candidates": _candidates,
    "ranking_metrics_bias": _ranked(m.BiasModel),
    "ranking_per_user_bias": _ranked(m.BiasModel, per_user=True),
    "ranking_metrics_knn": _ranked(m.ItemKNN),
    "topn_bias": _topn(m.BiasModel, USER),
    "topn_knn": _topn(m.ItemKNN, USER),
    "topn_unknown_user": _topn(m.BiasModel, NOBODY),
    "factor_dot_score": _factor_dot,
    "mlp_forward": _mlp_forward,
    "saved_knn_predict_val": _with("val", _saved),
    "als_predict_val": _with("val", lambda train, val: _scored(m.ALSModel().fit(train).predict(val))),
    "als_recommend": _als_recommend,
    "ranking_metrics_als": _ranked(m.ALSModel, max_users=None),
    "neural_predict_val": _with("val", lambda train, val: _scored(NeuralModel().fit(train).predict(val))),
    "ranking_metrics_neural": _ranked(NeuralModel, max_users=None),
}

# --- the same in SQL, step by step -----------------------------------------------------------------------------

_INTER = """
inter AS (
  SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(l_partkey AS BIGINT) AS item_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ts, CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS l, CAST(l_partkey AS BIGINT) AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_RANKED = f"""{_INTER},
users_i AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM inter)),
items_i AS (SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM inter)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, o DESC, l DESC, p DESC) - 1 AS BIGINT) AS rank
  FROM inter JOIN users_i USING (user_id) JOIN items_i USING (item_id)),
train AS (SELECT * FROM ranked WHERE rank >= 2), val AS (SELECT * FROM ranked WHERE rank = 1), test AS (SELECT * FROM ranked WHERE rank = 0)"""
_BIAS = f"""{_RANKED},
mu AS (SELECT avg(rating) AS mu FROM train),
ub AS (SELECT user_idx, avg(rating) - (SELECT mu FROM mu) AS b FROM train GROUP BY user_idx),
ib AS (SELECT item_idx, avg(rating) - (SELECT mu FROM mu) AS b FROM train GROUP BY item_idx)"""


def _base(table: str) -> str:
    return f"SELECT t.*, (SELECT mu FROM mu) + coalesce(ub.b, 0) + coalesce(ib.b, 0) AS base FROM {table} t LEFT JOIN ub USING (user_idx) LEFT JOIN ib USING (item_idx)"


_BIAS_VAL = f"{_BIAS}, pred AS (SELECT *, least(5.0, greatest(0.5, base)) AS prediction FROM ({_base('val')}))"
_MATRIX = f"""{_BIAS},
mat AS (SELECT user_idx, item_idx, sum(rating - base) AS v FROM ({_base('train')}) GROUP BY user_idx, item_idx),
nz AS (SELECT * FROM mat WHERE v <> 0),
norms AS (SELECT item_idx, sqrt(sum(v * v)) AS norm FROM nz GROUP BY item_idx)"""


def _knn(targets: str) -> str:
    """Neighbour adjustments of the pairs in `targets`, then predictions as `knn_pred`."""
    return f"""
asked AS (SELECT DISTINCT t.user_idx, t.item_idx AS i, nz.item_idx AS j, nz.v FROM (SELECT DISTINCT user_idx, item_idx FROM {targets}) t JOIN nz USING (user_idx) WHERE t.item_idx <> nz.item_idx),
sims AS (
  SELECT a.item_idx AS i, b.item_idx AS j, round(sum(a.v * b.v) / (max(na.norm) * max(nb.norm)), 10) AS s
  FROM (SELECT DISTINCT i, j FROM asked) q JOIN nz a ON a.item_idx = q.i JOIN nz b ON b.item_idx = q.j AND b.user_idx = a.user_idx
  JOIN norms na ON na.item_idx = a.item_idx JOIN norms nb ON nb.item_idx = b.item_idx GROUP BY a.item_idx, b.item_idx),
near AS (
  SELECT *, row_number() OVER (PARTITION BY user_idx, i ORDER BY s DESC, j) AS r FROM asked JOIN sims USING (i, j) WHERE s > 0),
adj AS (SELECT user_idx, i AS item_idx, sum(s * v) / sum(s) AS adj FROM near WHERE r <= 20 GROUP BY user_idx, i),
knn_pred AS (SELECT b.*, least(5.0, greatest(0.5, base + coalesce(adj, 0))) AS prediction FROM ({_base(targets)}) b LEFT JOIN adj USING (user_idx, item_idx))"""


_CAND = f"""{_BIAS},
chosen AS (SELECT DISTINCT user_idx FROM test WHERE rating >= 4 ORDER BY user_idx LIMIT 500),
rel AS (SELECT user_idx, item_idx, 0 AS cand_pos FROM test WHERE rating >= 4 AND user_idx IN (SELECT user_idx FROM chosen)),
universe AS (SELECT unnest(range(0, (SELECT max(item_idx) + 1 FROM train))) AS item_idx),
unseen AS (
  SELECT p.user_idx, p.item_idx FROM (SELECT c.user_idx, u.item_idx FROM chosen c, universe u) p
  LEFT JOIN (SELECT user_idx, item_idx, true AS seen FROM train UNION SELECT user_idx, item_idx, true FROM rel) s
    ON s.user_idx = p.user_idx AND s.item_idx = p.item_idx
  WHERE s.seen IS NULL),
had AS (SELECT user_idx, item_idx FROM train WHERE user_idx IN (SELECT user_idx FROM chosen) UNION SELECT user_idx, item_idx FROM rel),
sized AS (SELECT max(item_idx) + 1 AS size FROM train),
sides AS (
  SELECT size, a, (size + a - 1) // a AS b FROM (SELECT size, unnest(range(CAST(greatest(1, floor(sqrt(size)) // 2) AS BIGINT), CAST(greatest(1, floor(sqrt(size))) AS BIGINT) + 1)) AS a FROM sized)
  ORDER BY a * ((size + a - 1) // a), a DESC LIMIT 1),
places AS (
  SELECT user_idx, a, b, size, unnest(range(least(a * b, 99 + a * b - size + coalesce(d, 0)))) AS p
  FROM chosen LEFT JOIN (SELECT user_idx, count(*) AS d FROM had GROUP BY user_idx) USING (user_idx), sides),
drawn AS ({permuted_sql("places")}),
hashed AS (
  SELECT user_idx, item_idx, row_number() OVER (PARTITION BY user_idx ORDER BY p) AS n FROM drawn
  WHERE item_idx < size AND NOT EXISTS (SELECT 1 FROM had h WHERE h.user_idx = drawn.user_idx AND h.item_idx = drawn.item_idx)),
neg AS (SELECT user_idx, item_idx, CAST(n AS BIGINT) AS cand_pos FROM (SELECT *, max(n) OVER (PARTITION BY user_idx) AS most FROM hashed) WHERE n <= 99 AND most >= 99),
cand AS (
  SELECT user_idx, item_idx, CAST(cand_pos AS BIGINT) AS cand_pos, true AS is_rel FROM rel WHERE user_idx IN (SELECT user_idx FROM neg)
  UNION ALL SELECT user_idx, item_idx, cand_pos, false FROM neg)"""
_CAND_BIAS = f"{_CAND}, scored AS (SELECT *, least(5.0, greatest(0.5, base)) AS prediction FROM ({_base('cand')}))"
_CAND_KNN = _CAND.replace(_BIAS, _MATRIX, 1) + f",{_knn('cand')}, scored AS (SELECT * FROM knn_pred)"
_PER_USER = """
placed AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY prediction DESC, cand_pos DESC) AS position FROM scored),
per_user AS (
  SELECT user_idx, k, sum(CASE WHEN is_rel AND position <= k THEN 1.0 ELSE 0 END) / k AS p, sum(CASE WHEN is_rel AND position <= k THEN 1.0 ELSE 0 END) / sum(CAST(is_rel AS INT)) AS r,
    sum(CASE WHEN is_rel AND position <= k THEN 1.0 / log2(position + 1) ELSE 0 END) AS ndcg
  FROM placed, (SELECT CAST(unnest([5, 10, 20]) AS BIGINT) AS k) GROUP BY user_idx, k)"""
_MEANS = "SELECT metric, k, round(value, 6) AS value FROM (SELECT 'P' AS metric, k, avg(p) AS value FROM per_user GROUP BY k UNION ALL SELECT 'R', k, avg(r) FROM per_user GROUP BY k UNION ALL SELECT 'NDCG', k, avg(ndcg) FROM per_user GROUP BY k)"
_ROW = "user_id, item_id, rating, ts, o, l"
_PREDICTED = "SELECT CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx, rating, round(prediction, 6) AS prediction FROM"
_ERRORS = "SELECT round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse, round(avg(abs(rating - prediction)), 6) AS mae FROM"
_NUMBERED = f"{_INTER}, numbered AS (SELECT *, row_number() OVER (ORDER BY o, l, p, user_id, ts, rating) AS n, (SELECT count(*) FROM inter) AS total FROM inter), folds AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS fold), sized AS (SELECT *, total // 5 AS s, total % 5 AS rest FROM numbered, folds)"
_IS_TEST = "(n BETWEEN (fold - 1) * s + 1 AND fold * s OR fold = 5 AND n > total - rest)"


def _allbut_sql(start: int, stop: int, cap: int) -> str:
    count = f"sum(CASE WHEN {start} <= nth AND nth <= {stop} THEN 1 ELSE 0 END) OVER (ORDER BY o, l, p, user_id, ts, rating ROWS UNBOUNDED PRECEDING)"
    capped = f" AND so_far <= {cap}" if cap else ""
    return f"WITH {_INTER}, nthed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, l, p, user_id, ts, rating) AS nth FROM inter), counted AS (SELECT *, {count} AS so_far FROM nthed) SELECT {_ROW}, CASE WHEN nth BETWEEN {start} AND {stop}{capped} THEN 'test' ELSE 'train' END AS part FROM counted"


_LINES = f"{_NUMBERED}, lines AS (SELECT *, user_id || '::' || item_id || '::' || CAST(rating AS INT) || '::' || ts AS line FROM numbered)"
_START = "CAST(sum(strlen(line) + 1) OVER ({}ORDER BY {} ROWS UNBOUNDED PRECEDING) - strlen(line) - 1 AS BIGINT) AS start"
_SPLIT_FILES = f"""WITH {_LINES}, by_fold AS (SELECT fold, n, s, rest, total, line FROM lines JOIN sized USING (n, total)),
nthed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS nth FROM lines),
placed AS (
  SELECT 'r' || fold || '.test' AS name, 0 AS run, n, line FROM by_fold WHERE {_IS_TEST}
  UNION ALL SELECT 'r' || fold || '.train', 1, n, line FROM by_fold WHERE n <= (fold - 1) * s
  UNION ALL SELECT 'r' || fold || '.train', 2, n, line FROM by_fold WHERE fold < 5 AND n > total - (5 - fold) * s
  UNION ALL SELECT 'r' || fold || '.train', 3, n, line FROM by_fold WHERE fold < 5 AND n > total - rest
  UNION ALL SELECT CASE WHEN nth BETWEEN 1 AND 10 THEN 'ra.test' ELSE 'ra.train' END, 0, n, line FROM nthed
  UNION ALL SELECT CASE WHEN nth BETWEEN 11 AND 20 THEN 'rb.test' ELSE 'rb.train' END, 0, n, line FROM nthed)
SELECT name, {_START.format("PARTITION BY name ", "run, n")}, line FROM placed"""


def _top_sql(ctes: str, scored: str, prediction: str) -> str:
    return f"""WITH {ctes},
me AS (SELECT DISTINCT user_idx FROM train WHERE user_id = {USER}),
cand AS (SELECT me.user_idx, CAST(u.item_idx AS BIGINT) AS item_idx FROM me, (SELECT unnest(range(0, (SELECT max(item_idx) + 1 FROM train))) AS item_idx) u
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_idx = me.user_idx AND t.item_idx = u.item_idx)){scored},
best AS (SELECT *, {prediction} AS score FROM {'knn_pred' if scored else f"({_base('cand')})"} ORDER BY score DESC, item_idx DESC LIMIT 10),
named AS (SELECT best.*, ids.item_id FROM best JOIN (SELECT DISTINCT item_idx, item_id FROM train) ids USING (item_idx))
SELECT row_number() OVER (ORDER BY score DESC, item_idx DESC) AS rank, item_id, coalesce(p_name, 'MovieID ' || item_id) AS title, round(score, 3) AS score
FROM named LEFT JOIN (SELECT DISTINCT p_partkey, p_name FROM part) ON p_partkey = item_id"""


ORACLE_SQL: dict[str, str] = {
    "interactions": f"WITH {_INTER} SELECT {_ROW} FROM inter",
    "interactions_half_star": f"WITH {_INTER.replace('ceil(l_quantity / 10) AS DOUBLE)', 'ceil(l_quantity / 5) AS DOUBLE) / 2')} SELECT {_ROW} FROM inter",
    "id_index_users": f"WITH {_RANKED} SELECT user_id, CAST(user_idx AS BIGINT) AS user_idx FROM users_i",
    "id_index_items": f"WITH {_RANKED} SELECT item_id, CAST(item_idx AS BIGINT) AS item_idx FROM items_i",
    "items_titles": "SELECT CAST(p_partkey AS BIGINT) AS item_id, p_name AS title, p_type || '|' || p_brand AS genres FROM part",
    "users_profile": "SELECT CAST(c_custkey AS BIGINT) AS user_id, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer",
    "tag_counts": "SELECT event_type AS tag, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "time_split_train": f"WITH {_RANKED} SELECT {_ROW}, rank FROM train",
    "time_split_val": f"WITH {_RANKED} SELECT {_ROW}, rank FROM val",
    "time_split_test": f"WITH {_RANKED} SELECT {_ROW}, rank FROM test",
    "split_counts": f"WITH {_RANKED} SELECT CASE rank WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT user_id) AS n_users FROM ranked GROUP BY 1",
    "kfold_exact": f"WITH {_NUMBERED} SELECT {_ROW}, fold, CASE WHEN {_IS_TEST} THEN 'test' ELSE 'train' END AS part FROM sized",
    "kfold_compat": f"WITH {_NUMBERED} SELECT {_ROW}, fold, 'test' AS part FROM sized WHERE {_IS_TEST} UNION ALL SELECT {_ROW}, fold, 'train' FROM sized WHERE n <= (fold - 1) * s UNION ALL SELECT {_ROW}, fold, 'train' FROM sized WHERE fold < 5 AND n > total - (5 - fold) * s UNION ALL SELECT {_ROW}, fold, 'train' FROM sized WHERE fold < 5 AND n > total - rest",
    "allbut_1_10": _allbut_sql(1, 10, 0),
    "allbut_11_20": _allbut_sql(11, 20, 0),
    "allbut_capped": _allbut_sql(1, 10, 1000),
    "loaded_ratings": f"""WITH {_LINES.replace(_INTER, _RANKED, 1)}
SELECT user_id, item_id, rating, ts, CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx, {_START.format("", "n")} FROM lines JOIN users_i USING (user_id) JOIN items_i USING (item_id)""",
    "split_files": _SPLIT_FILES,
    "global_mean": f"WITH {_BIAS} SELECT round((SELECT mu FROM mu), 6) AS prediction, count(*) AS n FROM val",
    "user_bias": f"WITH {_BIAS} SELECT CAST(user_idx AS BIGINT) AS user_idx, round(b, 6) AS bias FROM ub",
    "item_bias": f"WITH {_BIAS} SELECT CAST(item_idx AS BIGINT) AS item_idx, round(b, 6) AS bias FROM ib",
    "bias_predict_val": f"WITH {_BIAS_VAL} {_PREDICTED} pred",
    "residuals": f"WITH {_BIAS} SELECT CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx, rating, round(rating - base, 6) AS residual FROM ({_base('train')})",
    "residual_matrix": f"WITH {_MATRIX} SELECT CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx, round(v, 6) AS v FROM mat",
    "rating_metrics_global_mean": f"WITH {_BIAS} {_ERRORS} (SELECT rating, (SELECT mu FROM mu) AS prediction FROM val)",
    "rating_metrics_bias": f"WITH {_BIAS_VAL} {_ERRORS} pred",
    "item_norms": f"WITH {_MATRIX} SELECT CAST(item_idx AS BIGINT) AS item_idx, round(norm, 6) AS norm FROM norms",
    "item_similarity_topk": f"""WITH {_MATRIX},
sims AS (SELECT a.item_idx AS i, b.item_idx AS j, round(sum(a.v * b.v) / (max(na.norm) * max(nb.norm)), 10) AS s FROM nz a JOIN nz b ON a.user_idx = b.user_idx AND a.item_idx <> b.item_idx
  JOIN norms na ON na.item_idx = a.item_idx JOIN norms nb ON nb.item_idx = b.item_idx WHERE a.item_idx IN (SELECT item_idx FROM val) GROUP BY a.item_idx, b.item_idx),
top AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM sims WHERE s > 0)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(s, 6) AS sim, r FROM top WHERE r <= 5""",
    "knn_predict_val": f"WITH {_MATRIX},{_knn('val')} {_PREDICTED} knn_pred",
    "rating_metrics_knn": f"WITH {_MATRIX},{_knn('val')} {_ERRORS} knn_pred",
    "unseen_items": f"WITH {_CAND} SELECT CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx FROM unseen",
    "sampled_negatives": f"WITH {_CAND} SELECT CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx, cand_pos FROM neg",
    "ranking_candidates": (
        f"WITH {_CAND} SELECT CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx, cand_pos, "
        "is_rel AS is_relevant FROM cand"
    ),
    "ranking_metrics_bias": f"WITH {_CAND_BIAS}, {_PER_USER} {_MEANS}",
    "ranking_per_user_bias": f"WITH {_CAND_BIAS}, {_PER_USER} SELECT CAST(user_idx AS BIGINT) AS user_idx, k, round(p, 6) AS p, round(r, 6) AS r, round(ndcg, 6) AS ndcg FROM per_user",
    "ranking_metrics_knn": f"WITH {_CAND_KNN}, {_PER_USER} {_MEANS}",
    "topn_bias": _top_sql(_BIAS, "", "least(5.0, greatest(0.5, base))"),
    "topn_knn": _top_sql(_MATRIX, f",{_knn('cand')}", "prediction"),
    "topn_unknown_user": "SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS item_id, '' AS title, CAST(0 AS DOUBLE) AS score WHERE false",
    "factor_dot_score": f"WITH {_RANKED} SELECT CAST(user_idx AS BIGINT) AS user_idx, CAST(item_idx AS BIGINT) AS item_idx, o, l, round(coalesce(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 0.0), 5) AS score FROM ranked LEFT JOIN embeddings a ON a.vec_id = user_idx LEFT JOIN embeddings b ON b.vec_id = item_idx",
}
#: The same over all items of train.
ORACLE_SQL["saved_knn_predict_val"] = ORACLE_SQL["knn_predict_val"]
ORACLE_SQL["item_similarity_all"] = ORACLE_SQL["item_similarity_topk"].replace(" WHERE a.item_idx IN (SELECT item_idx FROM val)", "")


def _mlp_sql() -> str:
    """One step a layer: products with the weights, added up for each output."""
    steps = ["x0 AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, unnest(range(0, 64)) AS j, unnest(embedding) AS x FROM embeddings)"]
    for n, width in enumerate(WIDTHS[1:]):
        value = f"sum(CAST(x AS DOUBLE) * ((7 * j + 3 * k + {n}) % 11 - 5) / 20) + any_value((k % 5 - 2) / 10)"
        value = value if n == len(WIDTHS) - 2 else f"greatest(0, {value})"
        steps.append(f"x{n + 1} AS (SELECT vec_id, k AS j, {value} AS x FROM x{n}, (SELECT unnest(range(0, {width})) AS k) GROUP BY vec_id, k)")
    return f"WITH {', '.join(steps)} SELECT vec_id, round(x, 6) AS value FROM x{len(WIDTHS) - 1}"


ORACLE_SQL["mlp_forward"] = _mlp_sql()
