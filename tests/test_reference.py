"""Reference operators on small literal cases with known values."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.functions import features as ft
from veldt.functions import weighting as wt
from veldt.operators import affinity, ann, linear, mappings, metrics, quality, recommenders, sequences, splits, tuning
from veldt.operators.neural import SequenceModel, TwoTower
from veldt.sources import io, persist

I3 = [("u0", "G0", 5.0), ("u0", "G2", 4.0), ("u1", "G1", 6.0)]
XS = "user_id string, item_id string, value double"
UFS = "user_id string, feature_name string, value double"
IFS = "item_id string, feature_name string, value double"


def frames(spark):
    u = spark.createDataFrame([("u0", "region_US", 1.0), ("u1", "region_EMEA", 1.0), ("u2", "region_APAC", 1.0)], UFS)
    t = spark.createDataFrame([(f"G{i}", "a", 1.0) for i in range(4)], IFS)
    return spark.createDataFrame(I3, XS), u, t


def test_known_scores(spark):
    x, u, t = frames(spark)
    model = linear.train(x, u, t, lam=10.0)
    got = {r["item_id"]: r["score"] for r in model.scores(spark.createDataFrame([("q", "G0", 3.0)], XS), spark.createDataFrame([("q", "region_US", 1.0)], UFS)).collect()}
    for item, want in {"G0": 0.09625649452209473, "G2": 2.323416233062744, "G1": 0.012090153992176056, "G3": 0.05165792629122734}.items():
        assert abs(got[item] - want) < 1e-6
    assert model.validate()["passed"]
    cold = model.recommend(x.limit(0), u.filter("user_id = 'u1'")).collect()
    assert len(cold) == 4 and cold[0]["score"] != 0
    warm = [r["item_id"] for r in model.recommend(x, u, 10).filter("user_id = 'u0'").orderBy("rank").collect()]
    assert set(warm) == {"G1", "G3"}
    assert model.similar("nope").count() == 0 and model.similar("G0").count() == 3


def test_solve_matches_numpy_and_prunes(spark):
    rng = np.random.default_rng(3)
    g = rng.random((6, 6))
    g = g @ g.T
    s = linear.closed_form(g, 2.0)
    p = np.linalg.inv(g + 2 * np.eye(6))
    assert np.allclose(s, -p / np.diag(p) * (1 - np.eye(6))) and np.allclose(np.diag(s), 0)
    assert (np.abs(linear.closed_form(g, 2.0, 0.05)[linear.closed_form(g, 2.0, 0.05) != 0]) >= 0.05).all()


def test_negative_rates_and_duplicates(spark):
    x, *_ = frames(spark)
    with pytest.raises(ValueError):
        linear.train(x, decay_rate=-1)
    g = {(r["i"], r["j"]): r["g"] for r in linear.gram(spark.createDataFrame([("u", "a", 1.0), ("u", "a", 2.0), ("u", "b", 1.0)], XS), "user_id", "item_id").collect()}
    assert g == {("a", "a"): 9.0, ("a", "b"): 3.0, ("b", "b"): 1.0}


def test_save_and_load(spark, tmp_path):
    x, u, t = frames(spark)
    model = linear.train(x, u, t, lam=10.0)
    persist.save(model, str(tmp_path))
    back = persist.load(spark, str(tmp_path))
    key = lambda m: sorted((r["r"], r["c"], r["w"]) for r in m.weights.collect())
    assert key(model) == key(back) and back.items == model.items
    s = np.frombuffer(persist.payload(model)["s"], "<f8")
    assert len(s) == 4 * 7
    q, scale = persist.quantise(s.reshape(4, 7), "int8")
    assert np.abs(q * scale[:, None] - s.reshape(4, 7)).max() <= scale.max()
    req = spark.createDataFrame([(0, {"G0": 3.0}, {"region_US": 1.0})], "user_row int, interactions map<string,double>, features map<string,double>")
    top = persist.serve(model, req, 4, 100.0).orderBy("rank").collect()
    assert top[0]["item_guid"] == "G2" and top[-1]["item_guid"] == "G0"


def test_weighting(spark):
    rows = [("u0", "G0", 1.0, "purchase", 0.0), ("u0", "G1", 1.0, "click", 100.0), ("u1", "G1", 1.0, None, None), ("u1", None, 1.0, "click", 1.0)]
    df = spark.createDataFrame(rows, XS + ", event_type string, days_ago double")
    got = {(r[0], r[1]): r[2] for r in wt.weigh(df, {"purchase": 5.0}, 0.01).collect()}
    assert got["u0", "G0"] == 5.0 and math.isclose(got["u0", "G1"], math.exp(-1)) and got["u1", "G1"] == 1.0 and len(got) == 3
    ips = {(r[0], r[1]): r[2] for r in wt.weigh(df, ips_alpha=1.0).collect()}
    assert ips["u0", "G0"] == 2.0 and ips["u0", "G1"] == 1.0


def test_features(spark):
    t = ft.Transform().add_categorical("plan", "plan_").add_numeric("days", "tenure", [0, 7, 30, 90], ["0d", "7d", "30d", "90d", "90d+"])
    t = ft.Transform.from_json(t.to_json())
    df = spark.createDataFrame([("a", "Premium", "45"), ("b", None, "15"), ("c", "x", "zz"), ("d", "x", "90"), ("e", "x", "90.5")], "id string, plan string, days string")
    got = {}
    for r in t.apply(df, "id").collect():
        got.setdefault(r["id"], set()).add(r["feature_name"])
    assert got == {"a": {"plan_Premium", "tenure_90d"}, "b": {"plan_unknown", "tenure_30d"}, "c": {"plan_x", "tenure_unknown"}, "d": {"plan_x", "tenure_90d"}, "e": {"plan_x", "tenure_90d+"}}
    with pytest.raises(ValueError):
        ft.check_buckets([1, 1], ["a", "b", "c"])
    with pytest.raises(ValueError):
        ft.check_buckets([1], ["a"])
    assert ft.melt(df, "id", []).count() == 0 and ft.melt(df, "id", ["plan"]).count() == 4
    with pytest.raises(ValueError):
        io.validate(df, {"nope": "string"})
    with pytest.raises(ValueError):
        io.read(spark, "x.json")


def test_metrics_literals():
    rec = [1, 2, 3, 4, 5]
    assert metrics.precision_at_k(rec, {1, 3, 5, 7}, 3) == 2 / 3 and metrics.recall_at_k(rec, {1, 3, 5, 7}, 3) == 0.5
    assert math.isclose(metrics.ndcg_at_k(rec, {3, 5}, 5), (0.5 + 1 / math.log2(6)) / (1 + 1 / math.log2(3)))
    assert math.isclose(metrics.mean_average_precision(rec, {1, 3, 5}), (1 + 2 / 3 + 3 / 5) / 3)
    assert metrics.coverage([[0, 1, 2], [2, 3, 4], [4, 5]], 10) == 0.6
    assert metrics.hit_rate_at_k([10, 20, 30], {20, 40}, 3) == 1 and metrics.hit_rate_at_k([10, 20, 30, 40], {40}, 2) == 0
    assert metrics.precision_at_k([1, 2], {1, 2, 3}, 5) == 0.4 and metrics.precision_at_k(rec, {1}, 0) == 0


def test_metric_frames_match_functions(spark):
    rng = np.random.default_rng(5)
    ranked, rel = [], []
    for u in range(20):
        items = rng.permutation(15)[: rng.integers(0, 12)]
        ranked += [(f"u{u}", f"i{x}", r + 1) for r, x in enumerate(items)]
        rel += [(f"u{u}", f"i{x}") for x in rng.permutation(15)[: rng.integers(1, 9)]]
    got = metrics.per_user_metrics(spark.createDataFrame(ranked, "user_id string, item_id string, rank int"), spark.createDataFrame(rel, "user_id string, item_id string"), [3, 10]).collect()
    assert len(got) == 40
    for r in got:
        items = [i for u, i, _ in ranked if u == r["user_id"]]
        mine = {i for u, i in rel if u == r["user_id"]}
        for name, f in (("precision", metrics.precision_at_k), ("recall", metrics.recall_at_k), ("ndcg", metrics.ndcg_at_k), ("hit_rate", metrics.hit_rate_at_k)):
            assert math.isclose(r[name], f(items, mine, r["k"]), abs_tol=1e-12)
        assert math.isclose(r["map"], metrics.mean_average_precision(items[: r["k"]], mine), abs_tol=1e-12)


def test_splits_partition(spark):
    df = spark.createDataFrame([(u, f"i{k}", float(k)) for u, n in (("u1", 4), ("u2", 3), ("u3", 5), ("u4", 1)) for k in range(n)] + [(None, "i0", 0.0)], "user_id string, item_id string, days_ago double")
    for s in (splits.random_split(df, 0.2), splits.leave_k_out(df, 2), splits.temporal_split(df, 1.0)):
        assert sorted(map(tuple, s.train.union(s.test).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    test = {r[0]: r[1] for r in splits.random_split(df, 0.2).test.groupBy("user_id").count().collect()}
    assert test == {"u1": 1, "u2": 1, "u3": 1}
    assert {r[0]: r[1] for r in splits.leave_k_out(df, 2).test.groupBy("user_id").count().collect()} == {"u1": 2, "u2": 2, "u3": 2}
    folds = splits.user_folds(df, 3).collect()
    assert sorted(r["fold"] for r in folds) == [0, 0, 1, 2]
    assert splits.row_folds(df, 2).count() == 13
    with pytest.raises(ValueError):
        splits.temporal_split(df.withColumn("days_ago", F.lit(None).cast("double")), 1)


def test_tuning_and_evaluation(spark):
    rows = [(f"u{u}", f"G{i}", 1.0) for u, pair in enumerate([(0, 1), (1, 2), (0, 2), (2, 3), (0, 3), (1, 3)]) for i in pair]
    x = spark.createDataFrame(rows, XS)
    u = spark.createDataFrame([(f"u{k}", f"plan_{'AB'[k % 2]}", 1.0) for k in range(6)], UFS)
    trials = tuning.search(x, tuning.grid({"lam": [10.0, 100.0]}), u, n_folds=2, k=10)
    assert len(trials) == 2 and all(len(t.fold_scores) == 2 and t.metric == "ndcg@10" for t in trials)
    assert tuning.best(trials).mean_score == max(t.mean_score for t in trials)
    assert all(0 <= s <= 1 for t in trials for s in t.fold_scores)
    with pytest.raises(ValueError):
        tuning.search(x, [{"nope": 1}])
    assert tuning.sample({"lam": [1.0, 2.0]}, 5) == tuning.sample({"lam": [1.0, 2.0]}, 5)


def test_quality(spark):
    h = {"users": [100, 105, 98, 102, 101], "items": [50, 52, 49, 51, 50], "interactions": [1000, 1050, 980, 1020, 1010], "new": [1]}
    assert quality.validate_counts(h, {"users": 103, "items": 51, "interactions": 1030})["passed"]
    assert not quality.validate_counts(h, {"users": 500, "items": 51, "interactions": 1030})["passed"]


def test_affinity(spark):
    df = spark.createDataFrame([("u_rep", "G0")] * 4 + [("u_new", f"G{k}") for k in range(3)], "user_id string, item_id string")
    got = {r["user_id"]: r["rho"] for r in affinity.repeat_affinity(df).collect()}
    assert math.isclose(got["u_rep"], 1 - (3 + 30 / 7) / 14) and math.isclose(got["u_new"], 1 - (30 / 7) / 13)
    with pytest.warns(UserWarning):
        affinity.repeat_affinity(df, vocabulary=spark.createDataFrame([("zz",)], "item_id string"))


def test_sequences(spark):
    df = spark.createDataFrame([(u, i, float(4 - k)) for u, items in (("u0", "ABCD"), ("u2", "DCBA"), ("u3", "A")) for k, i in enumerate(items)], "user_id string, item_id string, days_ago double")
    m = mappings.index((df, "item_id"))
    got = {r["user_id"]: (r["input"], r["target"]) for r in sequences.padded_sequences(df, m, 5).collect()}
    assert got == {"u0": ([0, 0, 1, 2, 3], [0, 0, 2, 3, 4]), "u2": ([0, 0, 4, 3, 2], [0, 0, 3, 2, 1])}
    assert {r["user_id"]: r["input"] for r in sequences.padded_sequences(df, m, 2).collect()}["u0"] == [2, 3]
    pairs, users, items = sequences.positive_pairs(df)
    assert pairs.count() == 9 and users.agg(F.min("idx")).first()[0] == 1 and items.agg(F.min("idx")).first()[0] == 0


def test_neighbours(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1])], "id bigint, v array<double>")
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "id bigint, v array<double>")
    assert [r["item_id"] for r in ann.top_k(ask, items, 1).collect()] == [0]
    assert [r["item_id"] for r in ann.top_k(ask, items, 1, exclude_self=True).collect()] == [2]
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(16)]) for i in range(400)], "id bigint, v array<double>")
    exact = ann.top_k(v, v, 5, cosine=True)
    assert ann.mean_recall(exact, exact) == 1.0
    assert ann.mean_recall(ann.top_k(v, v, 5, cosine=True, codes=True), exact) > 0.95
    assert ann.mean_recall(ann.hyperplane_top_k(v, v, 5, 16, bits=4, tables=16), exact) > 0.7


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_hyperplanes_recall(spark, size):
    from veldt.plans import queries

    d = f"/root/testdata/{size}"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    exact = ann.top_k(*queries._vectors(spark, d), 10, cosine=True)
    recall = ann.mean_recall(queries.knn_hyperplanes(spark, d), exact)
    print("recall@10", size, recall)
    assert recall >= 0.9


def test_probes_of_hyperplanes(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(64)]) for i in range(300)], "id bigint, v array<double>")
    exact = ann.top_k(v, v, 5, cosine=True)
    got = [ann.mean_recall(ann.hyperplane_top_k(v, v, 5, 64, **p), exact) for p in ({"probes": 1}, {}, {"probes": 256})]
    assert got[0] < 0.6 and 0.9 <= got[1] <= 1 and got[2] == 1.0
    assert ann.hyperplane_top_k(v.limit(0), v, 5, 64).count() == 0


def test_towers_learn_and_round_trip(tmp_path):
    pairs = np.array([(u, i) for u in range(1, 9) for i in range(8) if u % 2 == i % 2])
    model = TwoTower(9, 8, dim=8, seed=1)
    losses = model.fit(pairs, epochs=40, batch=32)
    assert losses[-1] < losses[0]
    model.save(str(tmp_path / "m"))
    ids = np.arange(8)
    assert np.allclose(TwoTower.load(str(tmp_path / "m.npz")).vectors("i", ids), model.vectors("i", ids))
    assert np.allclose(np.linalg.norm(model.vectors("u", np.arange(9)), axis=1), 1)


def test_gradients_match_differences():
    model = SequenceModel(5, dim=4, length=3, heads=2, layers=1, seed=2)
    x, y = np.array([[0, 1, 2], [3, 4, 1]]), np.array([1, 2, 3, 4, 1, 2])
    from veldt.operators.neural import Tape, cross_entropy

    def loss():
        z = model.forward(x)
        return cross_entropy(Tape(z.data.reshape(-1, 5), (z,), lambda g: (g.reshape(2, 3, 5),)), y, np.ones(6))

    first = loss()
    first.backward()
    for name in ("e", "pos", "q0.1", "m0.0", "f0", "scale_a0", "shift_b0", "out"):
        t, at = model.p[name], (0,) * model.p[name].data.ndim
        at = (1, *at[1:]) if name == "e" else at
        want, old = t.grad[at], t.data[at]
        t.data[at] = old + 1e-6
        up = float(loss().data)
        t.data[at] = old - 1e-6
        down = float(loss().data)
        t.data[at] = old
        assert abs((up - down) / 2e-6 - want) < 1e-5, name


def test_sequence_model_learns_order(spark):
    df = spark.createDataFrame([(f"u{u}", i, float(9 - k)) for u in range(8) for k, i in enumerate("ABCDE"[: 2 + u % 4])], "user_id string, item_id string, days_ago double")
    rec = recommenders.SequenceRecommender.train(df, dim=16, length=5, layers=1, epochs=60, rate=0.01, patience=60)
    assert rec.losses[-1] < 0.5 * rec.losses[0] and rec.predict(["A", "B"], 1)[0][0] == "C" and rec.validate()
    assert rec.predict([], 2) and rec.similar("zz") == []
    got = rec.recommend(df.filter("user_id = 'u0'"), k=1).collect()
    assert {r["item_id"] for r in got} == {"C"}


def test_registry_and_two_tower(spark, tmp_path):
    df = spark.createDataFrame([(f"u{u}", i, 1.0) for u in range(3) for i in "ABCD"], XS)
    u = spark.createDataFrame([("u0", "plan_free", 1.0), ("u1", "plan_premium", 1.0), ("u1", "age", 2.0)], UFS)
    rec = recommenders.TwoTowerRecommender.train(df, u, epochs=3, dim=8)
    assert len(rec.predict("u0", {"plan_free": 1.0, "age": 3.0})) == 4 and len(rec.predict("nobody", top_k=2)) == 2 and rec.validate()
    rec.save(str(tmp_path / "t"))
    assert recommenders.TwoTowerRecommender.load(str(tmp_path / "t")).predict("u1") == rec.predict("u1")
    reg = recommenders.Registry("global")
    reg.register("global", rec)
    assert reg.predict("mars", "u0") == rec.predict("u0") and len(reg) == 1 and reg.unregister("global") and not reg
    with pytest.raises(KeyError):
        reg.predict("mars", "u0")


def test_registry_answers_every_territory(spark):
    class Fixed:
        def __init__(self, item):
            self.item = item

        def recommend(self, interactions, features=None, k=100):
            return interactions.select("user_id").distinct().select("user_id", F.lit(1).alias("rank"), F.lit(self.item).alias("item_id"), F.lit(1.0).alias("score"))

    n = 10_100
    requests = spark.createDataFrame([(f"u{i}", f"t{i}") for i in range(n)] + [("u0", "DE"), ("u1", None), ("u2", "global")], "user_id string, territory string")
    seen = spark.createDataFrame([(f"u{i}", "A", 1.0) for i in range(n)], XS)
    reg = recommenders.Registry("global")
    reg.register("DE", Fixed("D"))
    reg.register("FR", Fixed("F"))
    with pytest.raises(KeyError):
        reg.recommend(requests, seen)
    reg.register("global", Fixed("G"))
    got = [(r["user_id"], r["territory"], r["item_id"]) for r in reg.recommend(requests, seen).collect()]
    assert len(got) == n + 3 and {("u0", "DE", "D"), ("u1", None, "G"), ("u2", "global", "G"), ("u10099", "t10099", "G")} <= {*got}
    assert {x for _, _, x in got} == {"D", "G"}
    assert reg.recommend(requests.limit(0), seen) is None
