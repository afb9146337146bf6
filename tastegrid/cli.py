"""python -m tastegrid.cli --user ID [--model als|knn|neumf] [--topn N] [--data FOLDER] [--save FOLDER | --fitted FOLDER]"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from .operators.evaluate import UnknownUser, recommend, user_index
from .operators.models import ALSModel, ItemKNN
from .operators.neural import NeuralModel
from .operators.saved import NoModel, load_ids, load_model, save_model
from .operators.splits import time_split
from .session import get_session
from .sources import load_movies, load_ratings

MODELS = {"als": ALSModel, "knn": ItemKNN, "neumf": NeuralModel}


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(description="Top-N recommendations for a user")
    parser.add_argument("--user", type=int, required=True, help="user id")
    parser.add_argument("--model", choices=sorted(MODELS), help="als unless --fitted says otherwise")
    parser.add_argument("--topn", type=int, default=10, help="how many")
    parser.add_argument("--data", default="ml-1m", help="folder of ratings.dat, movies.dat and users.dat")
    stored = parser.add_mutually_exclusive_group()
    stored.add_argument("--save", metavar="FOLDER", help="keep the fitted model in this new folder")
    stored.add_argument("--fitted", metavar="FOLDER", help="use the model in this folder instead of fitting one")
    args = parser.parse_args(argv)
    if args.topn < 0:
        parser.error("--topn must not be negative")
    spark = spark or get_session()
    movies, model = load_movies(spark, args.data), None
    if args.fitted:
        try:
            model, train = load_model(spark, args.fitted), load_ids(spark, args.fitted)
        except NoModel as e:
            print(e)
            return 1
        names = [k for k, x in MODELS.items() if x is type(model)]
        if not names or args.model not in (None, *names):
            parser.error(f"{args.fitted} holds a model of class {type(model).__name__}")
        name = names[0]
    else:
        name, train = args.model or "als", time_split(load_ratings(spark, args.data))[0].cache()
    try:
        user = user_index(train, args.user)
    except UnknownUser as e:
        print(e)
        return 1
    if model is None:
        model = MODELS[name]().fit(train)
        if args.save:
            save_model(model, args.save, train)
    found = recommend(model, user, train, movies, args.topn).collect()
    print(f"Top {args.topn} recommendations for User {args.user} ({name.upper()}):")
    for r in found:
        print(f"  {r['rank']:2}. {r['title']}  (score: {r['score']})")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
