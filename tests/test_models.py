"""Models over DataFrames, their files, hot users, and blocks of every kind, against plain Python and each other."""

import json
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt import session as sessions
from veldt.__main__ import main as command_line
from veldt.functions.features import Transform
from veldt.operators import ann, linear, mappings, metrics, recommenders, sequences, splits, tuning
from veldt.operators.neural import SequenceModel
from veldt.sources import binary, persist
from veldt.streaming.counts import windowed_scores

XS = "user_id string, item_id string, value double"
UFS = "user_id string, feature_name string, value double"


def made(spark, users=30, items=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"u{u}", f"i{i:02d}", float(rng.integers(1, 6))) for u in range(users) for i in rng.permutation(items)[: rng.integers(1, 7)]]
    return rows, spark.createDataFrame(rows, XS)


def brute(model, rows, features=(), k=5, skip=True, digits=9):
    s, m = persist.dense(model), len(model.items)
    at = {x: i for i, x in enumerate(model.items)}
    fat = {x: m + i for i, x in enumerate(model.features)}
    z, seen = defaultdict(lambda: np.zeros(s.shape[1])), defaultdict(set)
    for u, i, v in rows:
        z[u]
        if i in at:
            z[u][at[i]] += v or 0
            seen[u].add(at[i])
    for u, f, v in features:
        z[u][fat[f]] += v
    out = set()
    for u, x in z.items():
        sc = np.round(s @ x, digits)
        for r, i in enumerate(sorted((i for i in range(m) if not (skip and i in seen[u])), key=lambda i: (-sc[i], i))[:k], 1):
            out.add((u, r, model.items[i]))
    return out


@pytest.mark.parametrize("block", [64_000_000, 300])
def test_recommend_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(linear, "BLOCK_BYTES", block)
    rows, x = made(spark)
    features = [(f"u{u}", f"f{u % 3}", 1.0) for u in range(30)]
    u = spark.createDataFrame(features, UFS)
    model = linear.train(x, u, lam=5.0)
    top = lambda df: {(r["user_id"], r["rank"], r["item_id"]) for r in df.collect()}
    assert top(model.recommend(x, u, 5, digits=9)) == brute(model, rows, features)
    assert top(model.recommend(x, k=99, exclude_seen=False, digits=9)) == brute(model, rows, k=99, skip=False)
    odd = x.unionByName(spark.createDataFrame([(None, "i00", 1.0), ("u0", None, 1.0), ("u0", "zz", 1.0), ("new", "zz", 1.0), ("nan", "i00", float("nan")), ("nil", "i01", None)], XS)).withColumn("k", F.lit(7))
    got = top(model.recommend(odd, k=3, digits=9))
    assert {u for u, _, _ in got} == {f"u{k}" for k in range(30)} | {"new", "nan", "nil"}
    assert [i for u, _, i in sorted(got) if u == "new"] == model.items[:3] and [i for u, _, i in sorted(got) if u == "nan"] == model.items[1:4]
    assert model.recommend(x.limit(0), k=3).count() == 0 and model.recommend(x, k=0).count() == 0
    assert model.scores(x).count() == 30 * len(model.items)


def test_penalties_masks_and_raw(spark, tmp_path):
    rows, x = made(spark)
    model = linear.train(x, lam=5.0)
    plain = {(r["user_id"], r["item_id"]): r["score"] for r in model.recommend(x, k=99, exclude_seen=False).collect()}
    rho = spark.createDataFrame([("u0", 3.0)], "user_id string, rho double")
    seen = spark.createDataFrame([("u1", "i05")], "user_id string, item_id string")
    mask = model.item_frame().select("item_id", F.when(F.col("item_id") == "i02", 0.0).otherwise(1.0).alias("mask"))
    old = {(u, i) for u, i, _ in rows} | {("u1", "i05")}
    for r in model.recommend(x, k=99, exclude_seen=False, rho=rho, mask=mask, seen=seen).collect():
        want = plain[r["user_id"], r["item_id"]] - (3.0 if r["user_id"] == "u0" and ("u0", r["item_id"]) in old else 0) - (1e9 if r["item_id"] == "i02" else 0)
        assert abs(r["score"] - want) < 1e-6
    assert ("u1", "i05") not in {(r["user_id"], r["item_id"]) for r in model.recommend(x, k=99, seen=seen).collect()}
    u = spark.createDataFrame([(f"u{k}", "age", float(k)) for k in range(30)], UFS)
    model = linear.train(x, u, lam=5.0)
    raw = spark.createDataFrame([("q", "7", "red", True), ("p", "x", "red", False)], "user_id string, age string, colour string, flag boolean")
    a = {(r[0], r[2]): r[3] for r in model.recommend_raw(x.limit(0), raw, 3).collect()}
    b = {(r[0], r[2]): r[3] for r in model.recommend(x.limit(0), spark.createDataFrame([("q", "age", 7.0)], UFS), 3, users=raw).collect()}
    assert a == b and {u for u, _ in a} == {"q", "p"}
    model.transform = Transform().add_categorical("colour", "colour_")
    persist.save(model, str(tmp_path / "m"))
    assert persist.load(spark, str(tmp_path / "m")).transform == model.transform


def test_saved_versions(spark, tmp_path):
    _, x = made(spark)
    model = linear.train(x, lam=5.0)
    old = tmp_path / "old"
    model.weights.write.parquet(f"{old}/weights")
    (old / "meta.json").write_text(json.dumps({"version": 1, "family": "linear", "items": model.items, "features": [], "beta": 1.0}))
    assert np.allclose(persist.dense(persist.load(spark, str(old))), persist.dense(model))
    persist.save(model, str(tmp_path / "m"))
    for change in ({"version": 9}, {"family": "other"}, {"items": model.items[:-1]}, {"features": ["f"]}):
        persist.write_meta(spark, str(tmp_path / "m"), {"version": 3, "family": "linear", "items": model.items, "features": [], "beta": 1.0} | change)
        with pytest.raises(ValueError):
            persist.load(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        persist.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        persist.quantised(model, "int8", least=1.1)


@given(st.integers(0, 3), st.integers(0, 3), st.sampled_from([1, 2, 3]), st.booleans(), st.lists(st.text(max_size=4), min_size=9, max_size=9))
@settings(max_examples=40, deadline=None)
def test_framed_files(m, k, version, events, names):
    f = binary.Framed(np.arange((m + k) ** 2, dtype=float).reshape(m + k, m + k), {"user": names[:2], "item": names[2 : 2 + m], "user_feature": names[5 : 5 + k], "item_feature": names[8:]}, {"alpha": 1.0, "beta": 0.5, "lambda": 9.0, "meta_weight": 0.0}, version)
    f.weighting = {"event_weights": {"buy": 2.0} if events else None, "decay_rate": 0.1, "ips_alpha": 0.0, "sparsity_threshold": 0.0} if version > 1 else None
    f.tail = b"\0" if version > 2 else b""
    data = binary.encode(f)
    g = binary.decode(data)
    assert np.array_equal(f.weights, g.weights) and (f.ids, f.numbers, f.version, f.weighting, f.tail) == (g.ids, g.numbers, g.version, g.weighting, g.tail)
    for bad in (b"NOPE" + data[4:], data[:4] + b"\x09\0\0\0" + data[8:], data[: len(data) // 2], data[:8] + b"\x07" + data[9:]):
        with pytest.raises(ValueError):
            binary.decode(bad)


def test_hot_groups_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("hot" if k % 3 else f"u{k % 7}", f"i{rng.integers(40)}", float(rng.integers(60)), k) for k in range(900)] + [(None, "i1", 1.0, 1000 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, days_ago double, n int")
    one = lambda: [
        {r["n"] for r in splits.random_split(df, 0.2, row=["n"]).test.collect()}, {r["n"] for r in splits.leave_k_out(df, 3, row=["n"]).test.collect()},
        {(r["n"], r["fold"]) for r in splits.row_folds(df, 4, row=["n"]).collect()}, sorted(map(tuple, sequences.next_items(df, ties=("n",)).collect())),
        {(r["i"], r["j"]): r["g"] for r in linear.gram(df.dropna(), "user_id", "item_id", "days_ago").collect()},
        {(r["i"], r["j"]): r["g"] for r in linear.cross_gram(df.dropna(), "item_id", df.dropna().limit(300), "n", "user_id", "days_ago").collect()},
    ]
    small = df.dropna().orderBy("n").limit(300)
    one_ = lambda: one()[:5] + [{(r["i"], r["j"]): r["g"] for r in linear.cross_gram(df.dropna(), "item_id", small, "n", "user_id", "days_ago").collect()}]
    plain = one_()
    monkeypatch.setattr(splits, "HOT", 50)
    monkeypatch.setattr(sequences, "HOT", 50)
    monkeypatch.setattr(sequences, "SPANS", 8)
    monkeypatch.setattr(linear, "GROUP_PAIRS", 100)
    assert one_() == plain


def test_index_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mappings, "RANGE", 7)
    ids = [f"ü{k}" if k % 5 == 0 else f"x{k}" for k in range(60)]
    got = {r["id"]: r["idx"] for r in mappings.index((spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "a string"), "a")).collect()}
    assert got == {x: k for k, x in enumerate(sorted(ids, key=str.encode))}


@pytest.fixture(scope="module")
def histories_(spark):
    return spark.createDataFrame([(f"u{u}", f"{'ABCDEFG'[(u + k) % 7]}", 1.0, float(9 - k)) for u in range(20) for k in range(2 + u % 4)], XS + ", days_ago double")


def test_sequence_tables(spark, histories_, tmp_path):
    rec = recommenders.SequenceRecommender.train(histories_, dim=8, length=4, layers=1, epochs=3, dropout=0.2)
    got = defaultdict(list)
    for r in rec.recommend(histories_, k=3, users=spark.createDataFrame([("nobody",)], "user_id string")).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append((r["item_id"], r["score"]))
    for u in range(20):
        want = rec.predict(["ABCDEFG"[(u + k) % 7] for k in range(2 + u % 4)], 3)
        assert [i for i, _ in got[f"u{u}"]] == [i for i, _ in want] and np.allclose([s for _, s in got[f"u{u}"]], [s for _, s in want])
    assert [i for i, _ in got["nobody"]] == [i for i, _ in rec.predict([], 3)]
    rec.save(str(tmp_path / "s"))
    assert recommenders.SequenceRecommender.load(str(tmp_path / "s")).predict(["A"], 2) == rec.predict(["A"], 2)
    with pytest.raises(ValueError):
        recommenders.TwoTowerRecommender.load(str(tmp_path / "s"))
    near = {(r["item"], r["item_id"]) for r in rec.neighbours(spark, 2).collect()}
    assert near == {(i, j) for i in rec.items for j, _ in rec.similar(i, 2)}
    report, summary = metrics.evaluate(rec, histories_, histories_, ks=(3,))
    assert report.count() == 1 and summary.first()["n_users"] == 20


def test_dropout_is_seeded():
    x, y = np.array([[0, 1, 2], [3, 4, 1]]), np.array([[1, 2, 3], [4, 1, 2]])
    fit = lambda p: SequenceModel(5, 4, 3, 2, 1).fit(x, y, epochs=3, dropout=p)
    assert fit(0.5) == fit(0.5) != fit(0.0)
    with pytest.raises(ValueError):
        fit(1.0)


def test_two_tower_tables(spark, histories_, monkeypatch):
    u = spark.createDataFrame([(f"u{k}", f"plan_{k % 2}", 1.0) for k in range(20)] + [(f"u{k}", "age", float(k)) for k in range(0, 20, 3)], UFS)
    rec = recommenders.TwoTowerRecommender.train(histories_, u, dim=8, epochs=3)
    monkeypatch.setattr(recommenders, "WIDTH", 3)
    features = {f"u{k}": {f"plan_{k % 2}": 1.0} | ({"age": float(k)} if k % 3 == 0 else {}) for k in range(20)}
    ask = u.unionByName(spark.createDataFrame([("cold", "plan_1", 1.0), ("cold", "nothing", 1.0), ("cold", "plan_0", 0.0)], UFS))
    got = defaultdict(list)
    for r in rec.recommend(histories_, ask, 4, exclude_seen=False).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append((r["item_id"], r["score"]))
    for user, f in (features | {"cold": {"plan_1": 1.0}}).items():
        want = rec.predict(user, f, 4)
        assert [i for i, _ in got[user]] == [i for i, _ in want] and np.allclose([s for _, s in got[user]], [s for _, s in want])
    dense = {(r["user_id"], r["rank"]): r["item_id"] for r in rec.recommend(histories_, ask, 2).collect()}
    for kind in ("exact", "codes", "hyperplanes"):
        found = {(r["user_id"], r["rank"]): r["item_id"] for r in rec.enable_index(kind).recommend(histories_, ask, 2).collect()}
        assert sum(found.get(k) == v for k, v in dense.items()) >= 0.9 * len(dense), kind
    with pytest.raises(ValueError):
        rec.enable_index("tree")
    again = recommenders.TwoTowerRecommender.of_payload(rec.enable_index(None).payload())
    assert again.predict("u1", features["u1"]) == rec.predict("u1", features["u1"])
    monkeypatch.setattr(recommenders, "MODEL_BYTES", 100)
    with pytest.raises(ValueError):
        recommenders.TwoTowerRecommender.train(histories_, dim=8)


def test_registry_names_the_right_call(spark, histories_):
    reg = recommenders.Registry("any")
    reg.register("any", linear.train(histories_, lam=5.0))
    reg.register("DE", recommenders.TwoTowerRecommender.train(histories_, dim=8, epochs=1))
    assert reg.family("FR") == "linear" and reg.predict_linear("FR", histories_, k=1).count() == 20
    with pytest.raises(TypeError, match="predict_two_tower"):
        reg.predict_linear("DE", histories_)
    with pytest.raises(TypeError, match="predict_linear"):
        reg.predict_sequence("FR", ["A"])
    assert len(reg.predict_two_tower("DE", "u1", k=2)) == 2


def test_search_faults_show(spark, histories_):
    with pytest.raises(ValueError):
        tuning.search(histories_, [{"dim": 9, "heads": 2}], family="sequence", n_folds=2)
    with pytest.raises(KeyError):
        tuning.search(histories_, [{}], family="other")
    got = tuning.grid_search(histories_, {"lam": [1.0, 9.0]}, n_folds=2, fold_by="row", k=3)
    assert len(got) == 2 and all(0 <= s <= 1 for t in got for s in t.fold_scores)


def test_stored_codes(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(15)]) for i in range(300)], "id bigint, v array<double>")
    stored = ann.pack_codes(v, cosine=True)
    assert {len(r["code"]) for r in stored.collect()} == {8}
    exact = ann.top_k(v, v, 5, cosine=True)
    assert ann.mean_recall(ann.top_k(v, stored, 5, cosine=True, codes=True), exact) > 0.95
    assert ann.top_k(v.limit(0), stored, 5, codes=True).count() == 0


def test_streamed_scores_equal_the_table(spark, tmp_path):
    rows = [("u", f"i{k % 3}", float(k), f"2024-01-0{1 + k % 4} 10:00:00") for k in range(40)] + [(None, "i0", 1.0, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, XS + ", at string").withColumn("loaded_at", F.col("at").cast("timestamp")).drop("at")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_scores(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("scores").collect())) == sorted(map(tuple, windowed_scores(df).collect()))


def test_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        sessions.shared_dir(Fake())
    held = sessions.cut(spark.range(3))
    path = held._veldt_path
    assert path in sessions._written
    sessions.release(held)
    assert path not in sessions._written


def not_whole(*args):
    raise AssertionError("the whole model on the driver")


def with_features(spark):
    _, x = made(spark)
    return linear.train(x, spark.createDataFrame([(f"u{k}", f"f{k % 3}", 1.0) for k in range(30)], UFS), lam=5.0, beta=0.5)


def test_quantised_in_workers(spark, monkeypatch):
    model = with_features(spark)
    want = {kind: persist.quantise(persist.dense(model), kind) for kind in ("fp16", "int8")}
    monkeypatch.setattr(persist, "dense", not_whole)
    for kind, (q, scale) in want.items():
        rows = {r["r"]: r["w"] for r in persist.quantised(model, kind).rows.collect()}
        assert np.array_equal([rows[k] for k in range(len(q))], q.astype(float) * scale[:, None])
    with pytest.raises(ValueError):
        persist.quantised(model, "int4")


def test_neighbours_by_slices(spark, monkeypatch):
    s = np.random.default_rng(4).integers(-2, 3, (9, 9)) / 4.0
    model = linear.LinearModel(spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(s)], "r int, w array<double>"), [f"i{k}" for k in range(9)], [])
    want = {(f"i{c}", n, f"i{r}") for c in range(9) for n, r in enumerate(sorted((r for r in range(9) if r != c), key=lambda r: (-s[r, c], r))[:3], 1)}
    for size in (256, 2):
        monkeypatch.setattr(linear, "SLICE", size)
        for digits in (None, 1, 6):
            got = {(r["item"], r["rank"], r["item_id"]) for r in model.neighbours(3, digits=digits).collect()}
            assert len(got) == 27 and (got == want or digits == 1)


def test_payload_by_rows(spark, monkeypatch):
    model = with_features(spark)
    whole = persist.payload(model)
    monkeypatch.setattr(persist, "dense", not_whole)
    rows = persist.payload_rows(model).orderBy("item").collect()
    assert [r["item"] for r in rows] == list(range(len(model.items))) and b"".join(bytes(r["s"]) for r in rows) == whole["s"]


@pytest.mark.parametrize("piece", [16_000_000, 300])
def test_binary_file_in_pieces(spark, monkeypatch, tmp_path, piece):
    model = with_features(spark)
    want, n = persist.dense(model), len(model.items) + len(model.features)
    monkeypatch.setattr(binary, "dense", not_whole, raising=False)
    for module in (linear, binary):
        monkeypatch.setattr(module, "PIECE_BYTES", piece)
    binary.write_binary(model, str(tmp_path / "m.bin"), lambda_=5.0)
    f = binary.decode((tmp_path / "m.bin").read_bytes())
    assert f.weights.shape == (n, n) and not f.weights[len(model.items) :].any() and f.numbers["lambda"] == 5.0
    back = binary.read_binary(spark, str(tmp_path / "m.bin"))
    assert np.array_equal(persist.dense(back), want) and (back.items, back.features, back.beta) == (model.items, model.features, 0.5)
    (tmp_path / "short.bin").write_bytes((tmp_path / "m.bin").read_bytes()[:400])
    with pytest.raises(ValueError):
        binary.read_binary(spark, str(tmp_path / "short.bin"))


def test_rows_step_as_the_whole_table():
    from veldt.operators.neural import Adam, RowAdam, Tape

    rng = np.random.default_rng(5)
    start = rng.standard_normal((40, 3))
    whole, few = Tape(start.copy()), Tape(start.copy())
    a, b = Adam({"x": whole}, 0.01), RowAdam(few, 0.01)
    for t in range(900):
        at = np.unique(rng.integers(0, 30 if t % 300 else 40, 2))
        g = rng.standard_normal((len(at), 3)) * 10.0 ** rng.integers(-6, 2)
        assert np.allclose(b.rows(at), whole.data[at], rtol=0, atol=1e-10)
        whole.grad = np.zeros_like(start)
        whole.grad[at] = g
        a.step()
        b.step(at, g)
    b.rows(np.arange(40))
    assert np.allclose(few.data, whole.data, rtol=0, atol=1e-10)


def test_towers_train_beyond_the_bound_of_histories(spark, histories_, monkeypatch):
    monkeypatch.setattr(recommenders, "MOST_ROWS", 10)
    u = spark.createDataFrame([(f"u{k}", "age", float(k)) for k in range(20)] + [(f"u{k}", "plan", 1.0) for k in range(0, 20, 2)], UFS)
    rec = recommenders.TwoTowerRecommender.train(histories_, u, dim=8, epochs=2)
    again = recommenders.TwoTowerRecommender.train(histories_.orderBy(F.rand(1)), u, dim=8, epochs=2)
    assert rec.users == sorted(f"u{u}" for u in range(20)) and rec.predict("u3", {"age": 3.0}) == again.predict("u3", {"age": 3.0})
    assert recommenders.TwoTowerRecommender.train(histories_.limit(0), dim=8, epochs=1).items == []
    monkeypatch.setattr(recommenders, "MOST_PAIRS", 10)
    with pytest.raises(ValueError):
        recommenders.TwoTowerRecommender.train(histories_, dim=8)


@pytest.mark.parametrize("users_a_task", [20_000, 3])
def test_solved_by_components(spark, monkeypatch, tmp_path, users_a_task):
    rng = np.random.default_rng(6)
    rows = [(f"u{g}{u}", f"i{i % 4}{g}", float(rng.integers(1, 6))) for g in range(4) for u in range(9) for i in rng.permutation(4)[: rng.integers(1, 4)]]
    rows += [("both", "i00", 2.0), ("solo", "j", 4.0)]
    x = spark.createDataFrame(rows, XS)
    more = x.unionByName(spark.createDataFrame([("both", "i01", 1.0), ("new", "zz", 1.0), ("nil", "i02", None)], XS))
    whole = linear.train(x, lam=5.0)
    monkeypatch.setattr(linear, "USERS", users_a_task)
    monkeypatch.setattr(linear, "WHOLE_BYTES", 0)
    monkeypatch.setattr(linear, "SOLVE_BYTES", 24 * 4 * 4)  # no component is larger
    model = linear.train(x, lam=5.0)
    monkeypatch.setattr(linear, "SOLVE_BYTES", 3_000_000_000)
    assert model.parted and not whole.parted and model.items == whole.items
    assert np.allclose(persist.dense(model), persist.dense(whole), atol=1e-12)
    persist.save(model, str(tmp_path / "m"))
    assert model.validate()["passed"] and persist.load(spark, str(tmp_path / "m")).parted
    flat = lambda df: sorted((*r[:-1], round(r[-1], 6)) for r in df.collect())
    rho = spark.createDataFrame([("u00", 3.0)], "user_id string, rho double")
    seen = spark.createDataFrame([("u01", "i13"), ("u02", "i00")], "user_id string, item_id string")
    mask = whole.item_frame().select("item_id", F.when(F.col("item_id").isin("i02", "i11"), 0.0).otherwise(1.0).alias("mask"))
    users = spark.createDataFrame([("nobody",)], "user_id string")
    for options in ({"k": 3}, {"k": 99, "exclude_seen": False, "rho": rho}, {"k": 5, "mask": mask, "seen": seen, "users": users}, {"k": 0}):
        a, b = (m.recommend(more, digits=9, **options) for m in (persist.load(spark, str(tmp_path / "m")), whole))
        assert flat(a) == flat(b), options
    assert flat(model.scores(more)) == flat(whole.scores(more))
    assert flat(model.weights) == flat(whole.weights.filter("abs(w) > 1e-15"))
    for k in (2, 30):
        assert flat(model.neighbours(k, digits=9)) == flat(whole.neighbours(k, digits=9))
    assert flat(model.similar("i11", 3)) == flat(whole.similar("i11", 3))
    assert np.allclose(persist.dense(persist.quantised(model, "fp16")), persist.dense(persist.quantised(whole, "fp16")))
    u = spark.createDataFrame([(f"u{g}{k}", f"f{g % 2}", 1.0) for g in range(4) for k in range(9)], UFS)
    monkeypatch.setattr(linear, "WHOLE_BYTES", 1_000_000_000)
    whole = linear.train(x, u, lam=5.0)
    monkeypatch.setattr(linear, "WHOLE_BYTES", 0)
    model = linear.train(x, u, lam=5.0)
    assert model.parted and np.allclose(persist.dense(model), persist.dense(whole), atol=1e-12)
    assert flat(model.recommend(more, u, 5, digits=9)) == flat(whole.recommend(more, u, 5, digits=9))
    monkeypatch.setattr(linear, "SOLVE_BYTES", 24 * 3 * 3)
    with pytest.raises(ValueError, match="connected"):
        linear.train(x, lam=5.0)


def shared_features(spark):
    """Four components of items that features of users and of items connect."""
    rng = np.random.default_rng(7)
    rows = [(f"u{g}{u}", f"i{i % 4}{g}", float(rng.integers(1, 6))) for g in range(4) for u in range(9) for i in rng.permutation(4)[: rng.integers(1, 4)]]
    x = spark.createDataFrame(rows + [("solo", "j", 4.0)], XS)
    u = spark.createDataFrame([(f"u{g}{k}", f"f{k % 3}", 1.0 + g) for g in range(4) for k in range(9)] + [("new", "f1", 2.0), ("new", "f2", 1.0), ("like", "f1", 2.0), ("like", "f2", 1.0)], UFS)
    t = spark.createDataFrame([(f"i{i}{g}", f"t{(i + g) % 3}", 1.0 + i) for g in range(4) for i in range(4)] + [("j", "t0", 1.0), ("unsold", "t1", 2.0), ("i00", "t0", 1.0)], "item_id string, feature_name string, value double")
    return x, u, t


def bordered(monkeypatch, train):
    """A model solved as a whole, and with a border, where no more than four items may be connected."""
    whole = train()
    monkeypatch.setattr(linear, "WHOLE_BYTES", 0)
    monkeypatch.setattr(linear, "SOLVE_BYTES", 24 * 4 * 4)
    model = train()
    assert isinstance(model, linear.BorderedModel) and not whole.parted and (model.items, model.features) == (whole.items, whole.features)
    return model, whole


def flat(df):
    return sorted((*r[:-1], round(r[-1], 6)) for r in df.collect())


@pytest.mark.parametrize("block", [64_000_000, 300])
def test_features_join_components(spark, monkeypatch, block):
    x, u, t = shared_features(spark)
    monkeypatch.setattr(linear, "BLOCK_BYTES", block)
    model, whole = bordered(monkeypatch, lambda: linear.train(x, u, t, lam=5.0, alpha=0.7, beta=0.5, meta_weight=2.0))
    for k in (3, 99):
        assert flat(model.recommend(x.limit(0), u, k, digits=9)) == flat(whole.recommend(x.limit(0), u, k, digits=9))
    assert "rows" not in vars(model)  # features alone do not need them
    assert np.allclose(persist.dense(model), persist.dense(whole), rtol=0, atol=1e-12)
    more = x.unionByName(spark.createDataFrame([("u00", "i01", 1.0), ("u00", "i13", 2.0), ("new2", "zz", 1.0), ("nil", "i02", None)], XS))
    rho = spark.createDataFrame([("u00", 3.0)], "user_id string, rho double")
    seen = spark.createDataFrame([("u01", "i13"), ("u02", "i00"), ("like", "i11")], "user_id string, item_id string")
    mask = whole.item_frame().select("item_id", F.when(F.col("item_id").isin("i02", "i11"), 0.0).otherwise(1.0).alias("mask"))
    users = spark.createDataFrame([("nobody",)], "user_id string")
    for options in ({"k": 3}, {"k": 99, "exclude_seen": False, "rho": rho}, {"k": 5, "mask": mask, "seen": seen, "users": users}, {"k": 0}):
        assert flat(model.recommend(more, u, digits=9, **options)) == flat(whole.recommend(more, u, digits=9, **options)), options
    assert flat(model.scores(more, u)) == flat(whole.scores(more, u))
    for k in (2, 30):
        assert flat(model.neighbours(k, digits=9)) == flat(whole.neighbours(k, digits=9))
    assert flat(model.weights.filter("abs(w) > 1e-13")) == flat(whole.weights.filter("abs(w) > 1e-13"))
    a, b = model.validate(), whole.validate()
    assert a["passed"] and b["passed"] and abs(a["largest"] - b["largest"]) < 1e-12
    assert np.allclose(persist.dense(persist.quantised(model, "fp16")), persist.dense(persist.quantised(whole, "fp16")))


def test_no_border_without_lambda_or_with_a_threshold(spark, monkeypatch):
    x, u, t = shared_features(spark)
    for options in ({"lam": 5.0, "threshold": 0.02}, {"lam": 5.0, "threshold": 0.02, "alpha": 0.0}):
        monkeypatch.setattr(linear, "WHOLE_BYTES", 1_000_000_000)
        whole = linear.train(x, u, t, **options)
        monkeypatch.setattr(linear, "WHOLE_BYTES", 0)
        assert np.allclose(persist.dense(linear.train(x, u, t, **options)), persist.dense(whole), atol=1e-12)
    monkeypatch.setattr(linear, "BORDER_BYTES", 8 * 10)
    assert np.allclose(persist.dense(linear.train(x, u, t, **options)), persist.dense(whole), atol=1e-12)


def test_bordered_models_are_saved(spark, monkeypatch, tmp_path):
    x, u, t = shared_features(spark)
    model, whole = bordered(monkeypatch, lambda: linear.train(x, u, t, lam=5.0))
    raw = spark.createDataFrame([("a", "0"), ("b", "2"), ("c", None), ("d", "2")], "user_id string, f string")
    for m, name in ((model, "m"), (whole, "w")):
        m.transform = Transform().add_categorical("f", "f")
        persist.save(m, str(tmp_path / name))
    back, other = (persist.load(spark, str(tmp_path / name)) for name in "mw")
    assert isinstance(back, linear.BorderedModel) and not other.parted and back.transform == model.transform
    assert flat(back.recommend_raw(x.limit(0), raw, 5, digits=9)) == flat(other.recommend_raw(x.limit(0), raw, 5, digits=9))
    assert flat(back.recommend(x, u, 5, digits=9)) == flat(other.recommend(x, u, 5, digits=9))
    persist.write_arrays(spark, str(tmp_path / "m"), model.border | {"lift": model.border["lift"][:-1]})
    with pytest.raises(ValueError, match="border"):
        persist.load(spark, str(tmp_path / "m"))


def test_search_with_features_that_join_components(spark, monkeypatch):
    x, u, _ = shared_features(spark)
    found, kinds = [], []
    solve = tuning.solve
    monkeypatch.setattr(tuning, "solve", lambda *a: (kinds.append(type(m := solve(*a))), m)[1])
    for bytes_ in (1_000_000_000, 0):
        monkeypatch.setattr(linear, "WHOLE_BYTES", bytes_)
        found.append([s for t in tuning.search(x, tuning.grid({"lam": [5.0, 50.0]}), u, n_folds=2, k=5) for s in t.fold_scores])
        monkeypatch.setattr(linear, "SOLVE_BYTES", 24 * 4 * 4)
    assert np.allclose(*found) and kinds == 4 * [linear.LinearModel] + 4 * [linear.BorderedModel]


def test_gram_with_a_border_makes_no_pairs(spark, monkeypatch):
    x, u, t = shared_features(spark)
    whole = persist.dense(linear.train(x, u, t, lam=5.0, beta=0.5))
    made, paired = [], linear._paired
    monkeypatch.setattr(linear, "_paired", lambda *a: (made.append((y := paired(*a)).count()), y)[1])
    monkeypatch.setattr(linear, "WHOLE_BYTES", 0)
    for tile, pairs in ((64_000_000, 100_000_000), (8 * 9, 1)):
        monkeypatch.setattr(linear, "TILE_BYTES", tile)
        monkeypatch.setattr(linear, "TILE_PAIRS", pairs)
        assert np.allclose(persist.dense(linear.train(x, u, t, lam=5.0, beta=0.5)), whole, rtol=0, atol=1e-12)
    assert made == [44, 44]  # the features of users; interactions make none


def test_gram_without_features_makes_no_pairs(spark, monkeypatch):
    x, _, _ = shared_features(spark)
    whole = [persist.dense(linear.train(x, lam=5.0, threshold=t)) for t in (0.0, 0.02)]
    made, paired = [], linear._paired
    monkeypatch.setattr(linear, "_paired", lambda *a: (made.append(1), paired(*a))[1])
    monkeypatch.setattr(linear, "WHOLE_BYTES", 0)
    monkeypatch.setattr(linear, "TILE_BYTES", 8 * 9)
    monkeypatch.setattr(linear, "TILE_PAIRS", 1)
    for t, want in zip((0.0, 0.02), whole):
        model = linear.train(x, lam=5.0, threshold=t)
        assert model.parted and np.allclose(persist.dense(model), want, rtol=0, atol=1e-12)
    joined = x.unionByName(spark.createDataFrame([("all", f"i{i}{g}", 1.0) for g in range(4) for i in range(4)], XS))  # one component: solved as a whole
    model = linear.train(joined, lam=5.0)
    monkeypatch.setattr(linear, "WHOLE_BYTES", 1_000_000_000)
    assert not made and not model.parted and np.allclose(persist.dense(model), persist.dense(linear.train(joined, lam=5.0)), rtol=0, atol=1e-12)


def test_command_line_keeps_a_running_session(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        made(spark, users=5, items=3)[1].write.parquet(str(tmp_path / "x.parquet"))
        command_line(["--interactions", str(tmp_path / "x.parquet"), "--output", str(tmp_path / "m")])
        assert spark.conf.get("spark.sql.shuffle.partitions") == "5" and len(persist.load(spark, str(tmp_path / "m")).items) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_metrics_with_known_numbers_of_relevant_items(spark):
    ranked = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "user_id string, rank int, item_id string")
    rel = spark.createDataFrame([("a", "y"), ("a", "w"), ("b", "z"), ("c", "w")], "user_id string, item_id string")
    n = rel.groupBy("user_id").agg(F.count("*").alias("n_rel"))
    assert sorted(metrics.per_user_metrics(ranked, rel, [1, 2], True).collect()) == sorted(metrics.per_user_metrics(ranked, rel.filter("item_id <> 'w'"), [1, 2], True, n).collect())
