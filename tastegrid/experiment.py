"""The full experiment: rating metrics of five models on val, ranking metrics of three on test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators.evaluate import evaluate_ranking, evaluate_rating
from .operators.models import ALSModel, BiasModel, GlobalMean, ItemKNN
from .operators.neural import NeuralModel
from .operators.splits import time_split

MODELS: dict[str, Callable] = {"GlobalMean": GlobalMean, "BiasModel": BiasModel, "ALS": ALSModel, "ItemKNN": ItemKNN, "NeuMF": NeuralModel}
RANKED = ("ALS", "ItemKNN", "NeuMF")


def run_experiment(ratings: DataFrame, models: dict[str, Callable] | None = None, ranked: tuple[str, ...] = RANKED, show: Callable = print) -> dict[str, dict[str, float]]:
    """{model: {metric: value}}; `show` gets each line as it is known."""
    train, val, test = (x.cache() for x in time_split(ratings))
    fitted, out = {}, {}
    for name, make in (models or MODELS).items():
        fitted[name] = make().fit(train)
        out[name] = evaluate_rating(fitted[name], val).first().asDict()
        show(f"{name}: {out[name]}")
    for name in ranked:
        if name in fitted:
            found = {f"{r['metric']}@{r['k']}": r["value"] for r in evaluate_ranking(fitted[name], train, test).orderBy("k").collect()}
            show(f"{name}: {found}")
            out[name] |= found
    return out
