"""Grid and random search with cross validation. Gram blocks are built once per fold and weighting, then solved per trial."""

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.weighting import weigh
from veldt.operators.linear import blocks, places, solve
from veldt.operators.metrics import NothingKnown, evaluate, mean_metrics, per_user_metrics
from veldt.operators.recommenders import SequenceRecommender, TwoTowerRecommender
from veldt.operators.splits import row_folds, user_folds
from veldt.session import cut, hint, release

#: The axes of each family with their defaults.
AXES = {
    "linear": {"alpha": 1.0, "beta": 1.0, "lam": 100.0, "meta_weight": 0.0, "decay_rate": 0.0, "ips_alpha": 0.0, "threshold": 0.0},
    "sequence": {"dim": 64, "heads": 2, "layers": 2, "dropout": 0.2, "rate": 1e-3, "epochs": 50},
    "two_tower": {"dim": 32, "temperature": 0.05, "rate": 0.01, "id_dropout": 0.1},
}


@dataclass
class Trial:
    params: dict[str, float]
    fold_scores: list[float]
    metric: str

    @property
    def mean_score(self) -> float:
        return sum(self.fold_scores) / len(self.fold_scores) if self.fold_scores else 0.0


def grid(space: dict[str, list[float]]) -> list[dict[str, float]]:
    """All combinations, the last axis fastest."""
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def sample(space: dict[str, list[float]], n: int, seed: int = 42) -> list[dict[str, float]]:
    """n independent choices from each axis."""
    rng = random.Random(seed + 1)
    return [{k: rng.choice(v) for k, v in space.items()} for _ in range(n)]


def search(interactions: DataFrame, trials: list[dict[str, float]], user_features: DataFrame | None = None, item_features: DataFrame | None = None, n_folds: int = 3, k: int = 10, seed: int = 42, fold_by: str = "user", threads: int = 4, family: str = "linear", **fixed) -> list[Trial]:
    """Every trial on every fold, by NDCG at k; the best is best(trials). Folds hold whole users, or rows of each user.

    family is linear, sequence or two_tower; `fixed` goes to the training of the neural ones (length, batch, patience;
    epochs of the towers). These train on the ids of the interactions alone. Test users of a user fold have no training
    rows: the linear model scores them by their features, the others as unknown users. A fold in which no test user and
    item is known scores 0; any other fault raises.
    """
    axes = AXES[family]
    if unknown := {x for t in trials for x in t} - set(axes):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    rows = cut(interactions.join(user_folds(interactions, n_folds, seed), "user_id") if fold_by == "user" else row_folds(interactions, n_folds, seed))
    full = [axes | t for t in trials]
    part = lambda fold, inside: rows.filter(F.col("fold") == fold if inside else F.col("fold") != fold).drop("fold")
    key = (lambda t: (t["decay_rate"], t["ips_alpha"])) if family == "linear" else (lambda t: ())

    def build(fold: int, w: tuple[float, ...]):
        """What trials share: the Gram blocks of a fold and weighting, and its known()."""
        b = blocks(weigh(part(fold, False), decay_rate=w[0], ips_alpha=w[1]), user_features, item_features) if w else None
        return b, known(fold, b.items) if b and fold_by == "user" else None

    def known(fold: int, items: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Test users of a fold, their items among those of the model, and how many each has."""
        test = part(fold, True).select(F.col("user_id").cast("string"), "item_id")
        relevant = cut(test.join(F.broadcast(places(test.sparkSession, items, "item_id")), "item_id", "left_semi").select("user_id", "item_id").distinct())
        return cut(test.select("user_id").distinct()), relevant, cut(relevant.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel")))

    def fitted(fold: int, t: dict, b):
        if family == "linear":
            return solve(b, t["alpha"], t["beta"], t["lam"], t["meta_weight"], t["threshold"])
        return (SequenceRecommender if family == "sequence" else TwoTowerRecommender).train(part(fold, False), seed=seed, **fixed, **t)

    def score(fold: int, t: dict, b, found) -> float:
        model, test, train = fitted(fold, t, b), part(fold, True), part(fold, False)
        try:
            if fold_by == "row":
                return float(evaluate(model, train, test, user_features if family == "linear" else None, (k,), True)[0].first()["ndcg"])
            users, relevant, n_rel = found or known(fold, model.items)
            feats = user_features.join(users, "user_id", "left_semi") if user_features is not None and family == "linear" else None
            ranked = cut(model.recommend(test.limit(0), feats, k, users=users))
            near = relevant.join(hint(ranked.select("item_id").distinct()), "item_id", "left_semi")  # only these can be hit
            row = mean_metrics(per_user_metrics(ranked, near, [k], True, n_rel)).first()
            release(ranked)
            return float(row["ndcg"]) if row else 0.0
        except NothingKnown:
            return 0.0

    with ThreadPoolExecutor(threads) as pool:
        built = {(f, w): pool.submit(build, f, w) for f in range(n_folds) for w in {key(t) for t in full}}
        built = {key_: x.result() for key_, x in built.items()}
        cells = [[pool.submit(score, f, t, *built[f, key(t)]) for f in range(n_folds)] for t in full]
        return [Trial(t, [c.result() for c in row], f"ndcg@{k}") for t, row in zip(trials, cells)]


def grid_search(interactions: DataFrame, space: dict[str, list[float]], family: str = "linear", **options) -> list[Trial]:
    return search(interactions, grid(space), family=family, **options)


def random_search(interactions: DataFrame, space: dict[str, list[float]], n_trials: int = 10, family: str = "linear", seed: int = 42, **options) -> list[Trial]:
    return search(interactions, sample(space, n_trials, seed), family=family, seed=seed, **options)


def best(trials: list[Trial]) -> Trial:
    """The highest mean score, the earliest of equal ones."""
    return max(enumerate(trials), key=lambda t: (t[1].mean_score, -t[0]))[1]
