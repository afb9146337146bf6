"""Delimited rating files and the interaction tables derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import with_both_indexes
from .delimited import read_delimited, read_lines, rejected_lines

__all__ = ["interactions", "items", "load_10m", "load_1m", "load_movies", "load_ratings", "read_delimited", "read_lines", "rejected_lines", "tags", "users"]

RATINGS = "userId long, movieId long, rating double, timestamp long"
MOVIES = "movieId long, title string, genres string"
USERS = "userId long, gender string, age int, occupation int, zip string"
TAGS = "userId long, movieId long, tag string, timestamp long"


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    """`ratings.dat` of a folder with pos, user_idx and item_idx; rows without a user or an item are left out."""
    df = read_delimited(spark, f"{path}/ratings.dat", RATINGS, position=True).where("userId is not null and movieId is not null")
    return with_both_indexes(df)


def load_movies(spark: SparkSession, path: str = "ml-1m", encoding: str = "ISO-8859-1") -> DataFrame:
    return read_delimited(spark, f"{path}/movies.dat", MOVIES, encoding)


def load_1m(spark: SparkSession, path: str = "ml-1m") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratings, movies, users); movie titles are Latin-1. Ratings carry pos, user_idx and item_idx."""
    return load_ratings(spark, path), load_movies(spark, path), read_delimited(spark, f"{path}/users.dat", USERS)


def load_10m(spark: SparkSession, path: str = "ml-10M100K") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratings, movies, tags), all UTF-8, with half-star ratings."""
    return load_ratings(spark, path), load_movies(spark, path, "UTF-8"), read_delimited(spark, f"{path}/tags.dat", TAGS)


def interactions(spark: SparkSession, sf_dir: str, half_stars: bool = False) -> DataFrame:
    """Orders joined with their lines as ratings: userId, movieId, rating, timestamp, pos.

    pos is (order, line, part), which breaks all ties of a user and a day.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    rating = F.ceil(F.col("l_quantity") / 5).cast("double") / 2 if half_stars else F.ceil(F.col("l_quantity") / 10).cast("double")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("long").alias("userId"),
        F.col("l_partkey").cast("long").alias("movieId"),
        rating.alias("rating"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("timestamp"),
        F.struct(F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("long").alias("l"), F.col("l_partkey").cast("long").alias("p")).alias("pos"),
    )


def indexed_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_both_indexes(interactions(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as movies: movieId, title, genres."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("movieId"), F.col("p_name").alias("title"), F.concat_ws("|", "p_type", "p_brand").alias("genres"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("userId"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("nation"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("userId"), F.col("event_type").alias("tag"), "ts")
