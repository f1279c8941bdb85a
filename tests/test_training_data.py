"""Key statistics, packed fields and wide tables against brute force, with the awkward cases of each."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veldt.operators import delimited, skew
from veldt.operators.delimited import split_packed, split_rule
from veldt.operators.skew import heavy_keys, key_stats
from veldt.operators.wide import resolve_attribute, to_long, to_wide


def test_key_stats_match_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 1e3), rng.expovariate(1e-6), 0.0, -3.5])) for _ in range(4000)]
    rows += [(f"k{i % 37}", float(rng.randint(-5, 5))) for i in range(900)] + [("odd", None), ("odd", math.nan), ("odd", math.inf), (None, 1.0), ("one", 7.0)]
    qs = (0.01, 0.25, 0.5, 0.99, 1.0)
    got = {r["key_value"]: r for r in key_stats(spark.createDataFrame(rows, "`a.key` string, v double").repartition(5), "a.key", "v", qs).collect()}
    by = defaultdict(list)
    for k, v in rows:
        if k is not None:
            by[k].append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        good = sorted(v for v in vs if v is not None and math.isfinite(v))
        r = got[k]
        assert (r["n"], r["n_values"]) == (len(vs), len(good)) and math.isclose(r["share"], len(vs) / len(rows))
        for i, q in enumerate(qs):
            assert r[f"q{i}"] == (good[max(1, math.ceil(q * len(good))) - 1] if good else None)
    assert got["odd"]["total"] is None


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0)] * 60 + [("b", 2.0)] * 2 + [(None, 1.0)] * 38, "k string, v double").withColumn("bin", F.lit(0)).withColumn("n", F.lit("x"))
    assert [r["key_value"] for r in heavy_keys(df, "k", "v", 0.02).orderBy("key_value").collect()] == ["a", "b"]
    assert [r["key_value"] for r in heavy_keys(df, "k", "v", 0.021).collect()] == ["a"]
    assert heavy_keys(df.limit(0), "k", "v").count() == 0 and key_stats(df.limit(0), "k", "v").count() == 0


def test_split_rules():
    assert split_rule("a,a") == [(1, 1, ""), (3, 1, "")]
    assert split_rule('"a,a"ba') == [(1, 3 - 0 - 0, "")] or split_rule('"a,a",a') == [(2, 3, "csv"), (7, 1, "")]
    assert split_rule('["a",b"a"]') == [(3, 1, "list"), (8, 1, "list")]
    assert split_rule("b,b") == [] and split_rule("[]") == []


def test_split_packed_notations(spark):
    cases = {
        "g1": ("Action, Drama", ["Action", "Drama"]),
        "g2": ('"Food, Travel & Craft"; x ;', ["Food, Travel & Craft", "x"]),
        "g3": ('["A", "say \\"hi\\""]', ["A", 'say "hi"']),
        "g4": ("['A', \"Children's\"] ", ["A", "Children's"]),
        "g5": ("rock, paper, rivalry|Sci-Fi/Fantasy", ["rock, paper, rivalry", "Sci-Fi", "Fantasy"]),
        "g6": ('"""Golden"" Classics",Action/Adventure', ['"Golden" Classics', "Action/Adventure"]),
        "g7": ('"Golden" Classics\tx\ny、z', ['"Golden" Classics', "x", "y", "z"]),
        "g8": (" ; ,\t", []), "g9": (None, []), "g10": ("", []), "g11": ('" ",a', ["a"]), "g12": ("x" * 50_000 + "|b", ["x" * 50_000, "b"]),
    }
    names = spark.createDataFrame([(x,) for x in ("Food, Travel & Craft", "Rock, Paper, Rivalry", '"Golden" Classics', "Action/Adventure", "Children's", "Action")], "genre string")
    rows = [(k, v, "z") for k, (v, _) in cases.items()] * 2 + [(None, "a,b", "z"), (" ", "a", "z")]
    df = spark.createDataFrame(rows, "media_guid string, media_genres string, units string")
    got = defaultdict(dict)
    for r in (out := split_packed(df, "media_guid", "media_genres", names)).collect():
        assert r["pos"] not in got[r["media_guid"]]
        got[r["media_guid"]][r["pos"]] = r["value"]
    assert {k: [v[p] for p in sorted(v)] for k, v in got.items()} == {k: v for k, (_, v) in cases.items() if v}
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and out.columns == ["media_guid", "pos", "value"]
    assert split_packed(df.limit(0), "media_guid", "media_genres", names.limit(0)).count() == 0


CATALOGUE = [("plan", "category"), ("plan_tier", "category"), ("days", "number")]


def test_wide_matches_rules(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [
        ("u1", "Plan: Free", 1.0, t(1)), ("u1", "plan_Premium", 1.0, t(2)), ("u1", "plan_x", 0.0, t(3)), ("u1", "plan", 1.0, t(9)),
        ("u1", "plan_tier_gold", 1.0, t(1)), ("u1", "DAYS", 12.0, t(1)), ("u1", "days_old", 9.0, t(9)), ("u1", "days", math.nan, t(9)),
        ("u1", "days", math.inf, t(9)), ("u1", "days", None, t(9)), ("u2", "planner_a", 1.0, t(1)), (" ", "plan_a", 1.0, t(1)),
        (None, "plan_a", 1.0, t(1)), ("u3", None, 1.0, t(1)), ("u4", "plan_a", 1.0, None), ("u5", "days", 1e300, t(1)),
    ]
    df = spark.createDataFrame(rows * 3, "user_id string, feature_name string, value double, at string").withColumn("loaded_at", F.col("at").cast("timestamp")).withColumn("entity", F.lit(1))
    cat = spark.createDataFrame(CATALOGUE, "attribute string, kind string")
    wide = to_wide(df, cat)
    assert dict(wide.dtypes) == {"user_id": "string", "days": "bigint", "plan": "string", "plan_tier": "string"}
    got = {(r[0], r[1]): r[2] for r in to_long(wide).collect()}
    assert got == {("u1", "plan"): "premium", ("u1", "plan_tier"): "gold", ("u1", "days"): "12", ("u4", "plan"): "a"}
    assert to_wide(df.limit(0), cat).count() == 0 and to_wide(df, cat.limit(0)).count() == 0


def test_wide_rounds_numbers(spark):
    rows = [("a", 2.7), ("b", 2.5), ("c", -2.5), ("d", 3.5), ("e", -0.4), ("f", 1e15 + 0.25)]
    df = spark.createDataFrame([(u, "days", v, "x") for u, v in rows], "user_id string, feature_name string, value double, s string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r["user_id"]: r["days"] for r in to_wide(df, spark.createDataFrame(CATALOGUE, "attribute string, kind string")).collect()}
    assert got == {"a": 3, "b": 2, "c": -2, "d": 4, "e": 0, "f": 10**15}


def test_key_stats_by_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 50)) for _ in range(3000)] + [(f"k{i % 9}", rng.random()) for i in range(400)]
    monkeypatch.setattr(skew, "HOT", 100)
    monkeypatch.setattr(skew, "small", lambda df, rows=0: False)
    got = {r["key_value"]: r["q0"] for r in key_stats(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.3,)).collect()}
    for k in {k for k, _ in rows}:
        vs = sorted(v for x, v in rows if x == k)
        assert got[k] == vs[max(1, math.ceil(0.3 * len(vs))) - 1]


def test_names_without_signs_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_NAMES", 2)
    names = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("a,b",), ("c|d",)], "genre string")
    df = spark.createDataFrame([("g", "n1;a,b,c|d")], "k string, f string")
    assert sorted((r["pos"], r["value"]) for r in split_packed(df, "k", "f", names).collect()) == [(1, "n1"), (2, "a,b"), (3, "c|d")]
    with pytest.raises(ValueError):
        split_packed(df, "k", "f", names.union(spark.createDataFrame([("e/f",)], "genre string")))


def test_wide_many_entities(spark):
    df = spark.range(30_000).select(F.concat(F.lit("u"), F.col("id") % 9000).alias("user_id"), F.lit("days").alias("feature_name"), F.col("id").cast("double").alias("value"), F.timestamp_seconds("id").alias("loaded_at"))
    got = to_wide(df, spark.createDataFrame(CATALOGUE, "attribute string, kind string"))
    assert got.count() == got.select("user_id").distinct().count() == 9000
    assert got.filter("user_id = 'u5'").first()["days"] == 27005


def test_resolve_attribute(spark):
    names = [("plan",), ("plan_tierx",), ("plan_tier_a_b",), ("planx",), ("",)]
    a, r = resolve_attribute(F.col("n"), [c for c, _ in CATALOGUE])
    got = [(x[0], x[1]) for x in spark.createDataFrame(names, "n string").select(a, r).collect()]
    assert got == [("plan", ""), ("plan", "tierx"), ("plan_tier", "a_b"), (None, ""), (None, "")]
