"""Fitted models as folders: a table for each of a model's tables, and a manifest that is written last.

The manifest holds a model's kind and its numbers; models within a model (the biases of a factorisation) are folders in
its folder. With the ids of train beside it, a model serves recommendations without its training data.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import ALSModel, BiasModel, GlobalMean, ItemKNN, Recommender
from .neural import NeuralModel

KINDS = {x.__name__: x for x in (GlobalMean, BiasModel, ALSModel, ItemKNN, NeuralModel)}
FORMAT = 1
IDS = ("userId", "movieId", "user_idx", "item_idx")


class NoModel(ValueError):
    pass


def save_model(model: Recommender, path: str, train: DataFrame | None = None) -> None:
    """Write a fitted model to the new folder `path`; an existing folder is an error.

    `train` adds the distinct (userId, movieId, user_idx, item_idx) it was fitted on, which tie its indices to ids and
    say what a user has seen. Whatever stops before the end leaves a folder without manifest, which doesn't load.
    """
    kind = type(model).__name__
    if KINDS.get(kind) is not type(model):
        raise TypeError(f"no way to save a {kind}")
    path = path.rstrip("/")
    for name in model.TABLES:
        getattr(model, name).write.parquet(f"{path}/{name}")
    for name in model.PARTS:
        save_model(getattr(model, name), f"{path}/{name}")
    if train is not None:
        train.select(*IDS).distinct().write.parquet(f"{path}/ids")
    manifest = {"format": FORMAT, "kind": kind, "values": {x: getattr(model, x) for x in model.VALUES}, "ids": train is not None}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_manifest(spark: SparkSession, path: str) -> dict:
    """What save_model wrote last; NoModel where that is missing, unfinished or of another format."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder.suffix("/_SUCCESS")):
        raise NoModel(f"{path} holds no whole model")
    found = json.loads(spark.read.text(folder.toString()).first()[0])
    if found["format"] != FORMAT or found["kind"] not in KINDS:
        raise NoModel(f"{path} is a {found['kind']} in format {found['format']}, which this version doesn't know")
    return found


def load_model(spark: SparkSession, path: str) -> Recommender:
    """The model in `path`; it predicts what the saved one did. Its tables are read when asked for."""
    manifest, path = load_manifest(spark, path), path.rstrip("/")
    kind = KINDS[manifest["kind"]]
    model = kind.__new__(kind)
    for name, x in manifest["values"].items():
        setattr(model, name, x)
    for name in kind.TABLES:
        setattr(model, name, spark.read.parquet(f"{path}/{name}"))
    for name in kind.PARTS:
        setattr(model, name, load_model(spark, f"{path}/{name}"))
    return model


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids saved with a model, which stand for its train rows in `recommend` and `user_index`."""
    if not load_manifest(spark, path)["ids"]:
        raise NoModel(f"{path} was saved without the ids of its training rows")
    return spark.read.parquet(f"{path.rstrip('/')}/ids").select(*map(F.col, IDS))
