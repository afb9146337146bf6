"""Rating predictors: global mean, biases, residuals, matrix factorisation and item neighbours."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clip, dot, or_zero
from .als import implicit_als
from .blocks import pair_scores
from .products import by_ranges, dots_of, item_ranges, met_ranges, most_similar


class Recommender(ABC):
    """fit learns from rows (user_idx, item_idx, rating); predict adds `prediction` and keeps all rows and columns.

    What fit leaves: VALUES, attributes that JSON can hold, TABLES, data frames, and PARTS, models of their own.
    """

    VALUES: tuple[str, ...] = ()
    TABLES: tuple[str, ...] = ()
    PARTS: tuple[str, ...] = ()

    @abstractmethod
    def fit(self, train: DataFrame) -> Recommender: ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame: ...


class GlobalMean(Recommender):
    """The mean rating for every row, not clipped."""

    VALUES = ("mu",)

    def fit(self, train: DataFrame) -> GlobalMean:
        self.mu = train.agg(F.avg("rating")).first()[0]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.mu).cast("double"))


class BiasModel(Recommender):
    """clip(mu + user bias + item bias); unseen ids have bias 0."""

    VALUES = ("mu",)
    TABLES = ("user_bias", "item_bias")

    def fit(self, train: DataFrame) -> BiasModel:
        self.mu = train.agg(F.avg("rating")).first()[0]
        self.user_bias = train.groupBy("user_idx").agg((F.avg("rating") - F.lit(self.mu)).alias("user_bias"))
        self.item_bias = train.groupBy("item_idx").agg((F.avg("rating") - F.lit(self.mu)).alias("item_bias"))
        return self

    def with_base(self, df: DataFrame, name: str = "_base") -> DataFrame:
        """`df` with mu + user bias + item bias. Left joins on unique keys keep every row; rows lie by user afterwards."""
        joined = df.join(self.item_bias, "item_idx", "left").join(self.user_bias, "user_idx", "left")
        base = F.lit(self.mu).cast("double") + or_zero(F.col("user_bias")) + or_zero(F.col("item_bias"))
        return joined.select(*[df[c] if c not in ("user_idx", "item_idx") else F.col(c) for c in df.columns], base.alias(name))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.with_base(df).withColumn("prediction", clip(F.col("_base"))).drop("_base")


def residuals(train: DataFrame, bias: BiasModel) -> DataFrame:
    """Rows with rating minus mean and biases, as `residual`."""
    return bias.with_base(train).withColumn("residual", F.col("rating") - F.col("_base")).drop("_base")


def residual_matrix(train: DataFrame, bias: BiasModel) -> DataFrame:
    """(user_idx, item_idx, v): residuals of repeated pairs added up."""
    return residuals(train, bias).groupBy("user_idx", "item_idx").agg(F.sum("residual").alias("v"))


class ALSModel(Recommender):
    """Biases plus a factorisation of the residuals. `implicit` feedback takes the sign of a residual as preference
    and its size as confidence; `explicit` fits the residuals themselves. Unseen ids add 0."""

    VALUES = ("factors", "iterations", "regularization", "feedback", "seed", "workers")
    TABLES = ("matrix", "user_factors", "item_factors")
    PARTS = ("bias",)

    def __init__(self, factors: int = 50, iterations: int = 20, regularization: float = 0.1, feedback: str = "implicit", seed: int = 42, workers: int | None = None):
        if feedback not in ("implicit", "explicit"):
            raise ValueError("feedback is implicit or explicit")
        self.factors, self.iterations, self.regularization, self.feedback, self.seed = factors, iterations, regularization, feedback, seed
        self.workers = workers

    def fit(self, train: DataFrame) -> ALSModel:
        self.bias = BiasModel().fit(train)
        self.matrix = residual_matrix(train, self.bias).cache()
        if self.feedback == "implicit":
            options = self.factors, self.iterations, self.regularization, self.seed, self.workers
            self.user_factors, self.item_factors = implicit_als(self.matrix, *options)
            return self
        from pyspark.ml.recommendation import ALS

        # ALS reads its input often and asks for the same order each time.
        rows = self.matrix.repartition("user_idx").sortWithinPartitions("user_idx", "item_idx").cache()
        als = ALS(rank=self.factors, maxIter=self.iterations, regParam=self.regularization, userCol="user_idx", itemCol="item_idx", ratingCol="v", coldStartStrategy="nan", seed=self.seed)
        model = als.fit(rows)
        self.user_factors, self.item_factors = model.userFactors, model.itemFactors
        return self

    def _factors(self) -> tuple[DataFrame, DataFrame]:
        users = self.user_factors.select(F.col("id").cast("int").alias("user_idx"), F.col("features").alias("_u"))
        return users, self.item_factors.select(F.col("id").cast("int").alias("item_idx"), F.col("features").alias("_i"))

    def predict(self, df: DataFrame) -> DataFrame:
        sides = [(F.col(c), x.select("id", F.col("features").alias("vector"))) for c, x in (("user_idx", self.user_factors), ("item_idx", self.item_factors))]
        scored = pair_scores(self.bias.with_base(df), sides, lambda u, i: (u.astype(float) * i).sum(axis=1), "_dot")
        return scored.withColumn("prediction", clip(F.col("_base") + or_zero(F.col("_dot")))).select(*df.columns, "prediction")

    def recommend(self, user_idx: int, n: int = 10) -> DataFrame:
        """(item_idx, score): the n best items by factors alone, without those the user has in train."""
        users, items = self._factors()
        user = users.where(F.col("user_idx") == user_idx).limit(1)
        seen = self.matrix.where(F.col("user_idx") == user_idx).select("item_idx")
        scored = items.join(seen, "item_idx", "left_anti").join(F.broadcast(user)).select("item_idx", dot(F.col("_u"), F.col("_i")).alias("score"))
        return scored.orderBy(F.col("score").desc(), F.col("item_idx").desc()).limit(n)


#: Ratings of one user on the left side of the similarity self-join in one salt; users whose items' neighbours may be looked
#: up item by item; ids that are broadcast.
USER_ROWS, FEW_USERS, FEW_IDS = 1000, 100, 100_000


class ItemKNN(Recommender):
    """Biases plus the weighted mean residual of the k most similar items that the user has rated.

    Similarity is the cosine of residual columns over all raters. Positive neighbours count; negative ones enter
    only where the catalogue is so small that fewer than k items are left without them.
    """

    VALUES = ("k", "n_items", "tiny")
    TABLES = ("matrix", "norms")
    PARTS = ("bias",)

    def __init__(self, k: int = 20):
        self.k = k

    def fit(self, train: DataFrame) -> ItemKNN:
        self.bias = BiasModel().fit(train)
        self.matrix = residual_matrix(train, self.bias).where("v <> 0").cache()
        self.n_items = (train.agg(F.max("item_idx")).first()[0] or 0) + 1
        self.norms = self.matrix.groupBy("item_idx").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        most = self.matrix.groupBy("user_idx").count().agg(F.max("count")).first()[0] or 0
        self.tiny = self.n_items - most < self.k
        return self

    def similarity(self, lefts: DataFrame | None = None, rights: DataFrame | None = None, matrix: DataFrame | None = None) -> DataFrame:
        """(i, j, sim) for all ordered pairs of different items with a common rater, or only for `lefts` (i) and `rights` (j).
        `matrix` has all rows of their common raters, if given.

        The self-join is on users; both sides are pruned by their items before it grows. The left rows of a user with many
        ratings are dealt by a salt, which the right rows repeat."""
        matrix = self.matrix if matrix is None else matrix
        salts = matrix.groupBy("user_idx").agg(F.ceil(F.count("*") / USER_ROWS).cast("int").alias("salts"))
        rows = matrix.join(salts, "user_idx")
        left = rows.select("user_idx", F.col("item_idx").alias("i"), F.col("v").alias("vi"), F.pmod(F.hash("item_idx"), F.col("salts")).alias("salt"))
        every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        right = rows.select("user_idx", F.col("item_idx").alias("j"), F.col("v").alias("vj"), every)
        if lefts is not None:
            left = left.join(lefts, "i", "left_semi")
        if rights is not None:
            right = right.join(rights, "j", "left_semi")
        joined = left.join(right, ["user_idx", "salt"]).where("i <> j")
        dots = joined.groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("d"))
        a, b = self.norms.withColumnsRenamed({"item_idx": "i", "norm": "ni"}), self.norms.withColumnsRenamed({"item_idx": "j", "norm": "nj"})
        return dots.join(a, "i").join(b, "j").select("i", "j", F.when(F.col("ni") * F.col("nj") > 0, F.col("d") / (F.col("ni") * F.col("nj"))).otherwise(0.0).alias("sim"))

    def most_similar(self, n: int, items: DataFrame | None = None) -> DataFrame:
        """(i, j, s, r): the n most similar items of each item, or of each in `items` (item_idx), s being the cosine at 10
        places; those of 0 and less are none. Pairs are ranked where they are multiplied: n an item are shuffled."""
        norms = self.norms.withColumn("asked", F.lit(True))
        if items is not None:
            norms = self.norms.join(items.select("item_idx", F.lit(True).alias("asked")).distinct(), "item_idx", "left").fillna(False)
        ends = item_ranges(self.matrix)
        entries = by_ranges(self.matrix, norms.drop("asked"), ends).join(norms.select("item_idx", "asked"), "item_idx")
        found = most_similar(entries, met_ranges(self.matrix, ends), n)
        return found.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.col("s").desc(), "j"))).where(F.col("r") <= n)

    def _near(self, wanted: DataFrame) -> DataFrame:
        """(user_idx, i, j, vj, s): for each pair in `wanted` the other items the user has rated, if similar or, s being
        negative, dissimilar.

        Pairs of items are multiplied where some users' entries are, and only sums of pairs asked for are shuffled. Of a few users who
        ask for much, all neighbours of their items are found instead, if these are fewer."""
        rated = self.matrix.select("user_idx", F.col("item_idx").alias("j"), F.col("v").alias("vj"))
        pairs = wanted.select("user_idx", F.col("item_idx").alias("i")).distinct()
        users = pairs.groupBy("user_idx").count()
        if users.limit(FEW_USERS + 1).count() <= FEW_USERS:
            own = rated.join(F.broadcast(users), "user_idx")
            many, asked, most = own.agg(F.countDistinct("user_idx"), F.sum("count"), F.count("*")).first()
            few = F.broadcast if most <= FEW_IDS else lambda df: df
            lefts, rights = pairs.select("i").distinct(), few(own.select("j").distinct())
            # Only rows of those who rated an item of these users count: they are found without a shuffle of the others.
            raters = rated.join(rights, "j", "left_semi").groupBy("user_idx").agg(F.count("*").alias("b"))
            near = self.matrix.join(F.broadcast(raters) if raters.count() <= FEW_IDS else raters, "user_idx")
            products = near.agg(F.sum("b")).first()[0] or 0
            if many * products <= (asked or 0):
                sims = self.similarity(lefts, rights, near.drop("b")).select("i", "j", F.round("sim", 10).alias("s")).where("s <> 0")
                return own.drop("count").join(sims, "j").join(pairs, ["user_idx", "i"], "left_semi").select("user_idx", "i", "j", "vj", "s")
        dots = dots_of(pairs, self.matrix)
        a, b = self.norms.withColumnsRenamed({"item_idx": "i", "norm": "ni"}), self.norms.withColumnsRenamed({"item_idx": "j", "norm": "nj"})
        sim = F.when(F.col("ni") * F.col("nj") > 0, F.round(F.col("d") / (F.col("ni") * F.col("nj")), 10)).otherwise(0.0)
        return dots.join(a, "i").join(b, "j").select("user_idx", "i", "j", "vj", sim.alias("s")).where("s <> 0")

    def adjustments(self, wanted: DataFrame) -> DataFrame:
        """(user_idx, item_idx, adjustment) for the pairs in `wanted` that have neighbours."""
        near = self._near(wanted).where("s <> 0" if self.tiny else "s > 0")
        own = W.partitionBy("user_idx", "i")
        near = near.withColumn("r", F.row_number().over(own.orderBy(F.col("s").desc(), "j")))
        if self.tiny:
            zeros = F.lit(self.n_items) - F.count("*").over(own)
            near = near.withColumn("r", F.col("r") + F.when(F.col("s") < 0, zeros).otherwise(0))
        near = near.where(F.col("r") <= self.k).groupBy("user_idx", "i").agg(F.sum(F.col("s") * F.col("vj")).alias("num"), F.sum("s").alias("den"))
        return near.where("den <> 0").select("user_idx", F.col("i").alias("item_idx"), (F.col("num") / F.col("den")).alias("adjustment"))

    def predict(self, df: DataFrame) -> DataFrame:
        joined = self.bias.with_base(df).join(self.adjustments(df), ["user_idx", "item_idx"], "left")
        return joined.withColumn("prediction", clip(F.col("_base") + or_zero(F.col("adjustment")))).select(*df.columns, "prediction")
