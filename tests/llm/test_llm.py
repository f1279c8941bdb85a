"""The llm operators against brute force, round trips and held-out accuracy, with the awkward cases of each."""

import math
import random
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.llm import bpe, groupsplit, knn, langid, leaks, pairs, topn


def rows(df):
    return sorted(map(tuple, df.collect()))


# 1. Top N in groups.


def test_top_n_matches_brute_force(spark):
    rng = random.Random(4)
    data = {(f"u{int(rng.expovariate(0.2))}", f"i{rng.randint(0, 400)}"): rng.choice([1.0, 2.0, -1.0, rng.random()]) for _ in range(3000)}
    data |= {("hot", f"i{k}"): float(k % 7) for k in range(2000)}
    df = spark.createDataFrame([(*k, v) for k, v in data.items()], "`g` string, i string, s double").withColumn("band", F.lit(9)).repartition(6)
    want = []
    for g in {k[0] for k in data}:
        best = sorted(((-s, i) for (h, i), s in data.items() if h == g))[:5]
        want += [(g, r, i) for r, (_, i) in enumerate(best, 1)]
    assert rows(topn.top_n(df, "g", "i", "s", 5)) == sorted(want)
    assert topn.top_n(df, "g", "i", "s", 0).count() == 0 and topn.top_n(df.limit(0), "g", "i", "s", 5).count() == 0


def test_top_n_nulls(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", None, 1.0), (None, "x", 1.0), ("a", "y", math.nan), ("a", "z", 1.0), ("a", "w", 1.0)], "g string, i string, s double")
    assert rows(topn.top_n(df, "g", "i", "s", 5)) == [("a", 1, "w"), ("a", 2, "z")]


# 3. Pairs.


@pytest.mark.parametrize("support,big", [(1, 0), (3, 0), (4, 700)])
def test_pairs_match_brute_force(spark, support, big):
    rng = random.Random(support)
    baskets = {f"b{k}": {f"i{int(rng.expovariate(0.05))}" for _ in range(rng.randint(1, 12))} for k in range(150)}
    for k in range(5 if big else 0):  # more large baskets than are set apart
        baskets[f"big{k}"] = {f"i{x}" for x in range(big - 60 * k)}
    df = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s] * 2 + [(None, "i1"), ("b1", None)], "b string, i string").withColumn("n", F.lit("x")).repartition(5)
    n, ab = Counter(), Counter()
    for s in baskets.values():
        n.update(s)
        ab.update(combinations(sorted(s), 2))
    want = {p: c for p, c in ab.items() if c >= support}
    got = {(r["item_a"], r["item_b"]): r for r in pairs.pair_association(df, "b", "i", support).collect()}
    assert set(got) == set(want)
    total = len(baskets)
    for (a, b), r in list(got.items())[:2000]:
        c = want[a, b]
        assert (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) == (c, n[a], n[b], total)
        odds = (c + 0.5) * (total - n[a] - n[b] + c + 0.5) / ((n[a] - c + 0.5) * (n[b] - c + 0.5))
        assert math.isclose(r["odds_ratio"], odds) and math.isclose(r["lift"], c * total / n[a] / n[b])


def test_pairs_with_many_large_baskets(spark):
    df = spark.range(80 * 300).select((F.col("id") % 80).alias("b"), (F.col("id") / 80).cast("int").alias("i"))
    got = pairs.pair_association(df, "b", "i", 80)
    assert got.agg(F.count(F.lit(1)), F.min("n_ab"), F.max("n_ab")).first() == (300 * 299 // 2, 80, 80)
    assert pairs.pair_association(df, "b", "i", 81).count() == 0


def test_pairs_empty_and_lift(spark):
    df = spark.createDataFrame([("b1", "x"), ("b1", "y"), ("b2", "x"), ("b3", "y"), ("b4", "z")], "b string, i string")
    assert pairs.pair_association(df.limit(0), "b", "i", 1).count() == 0
    assert pairs.pair_association(df, "b", "i", 1, 1.0).count() == 1 and pairs.pair_association(df, "b", "i", 1, 1.01).count() == 0


# 5. Neighbours.


def brute(data, k):
    ids = sorted(data, key=str.encode)
    x = np.array([data[i] for i in ids], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.argsort(-s[a], kind="stable")[: min(k, len(ids) - 1)]] for a, i in enumerate(ids)}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 32))
    data = {f"v{k}": [float(a) for a in centres[k % 20] + 0.3 * rng.standard_normal(32)] for k in range(2500)}
    same = data["v0"]
    data |= {f"copy{k}": same for k in range(900)}  # a group of equal vectors
    odd = [("n1", None), ("n2", [1.0] * 31), ("n3", [0.0] * 32), ("n4", [math.nan] * 32), ("n5", [None] * 32), (None, [1.0] * 32)]
    df = spark.createDataFrame([*data.items(), *list(data.items())[:50], *odd], "id string, vec array<float>").withColumn("q", F.lit(1)).withColumn("part", F.lit("x"))
    got = {r["id"]: r["ids"] for r in knn.nearest(df, "id", "vec", 10).collect()}
    want = brute(data, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (10 * len(want)) > 0.98
    assert got["copy7"] == want["copy7"] and got["v0"] == want["v0"]


def test_neighbours_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART", 40)
    monkeypatch.setattr(knn, "MOST_PARTS", 8)
    monkeypatch.setattr(knn, "SAMPLE", 700)
    monkeypatch.setattr(knn, "BLOCK", 90)
    monkeypatch.setattr(knn, "ASKING", 500)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 32))
    x = (centres[rng.integers(0, 60, 1500)] + 0.4 * rng.standard_normal((1500, 32))).astype(np.float32)
    ids = [f"v{k:05d}" for k in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>").repartition(3)
    got = {r["id"]: r["ids"] for r in knn.nearest(df, "id", "vec").collect()}
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = [{ids[j] for j in np.argsort(-s[k], kind="stable")[:10]} for k in range(len(x))]
    assert set(got) == set(ids) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(want[k] & set(got[i])) / 10 for k, i in enumerate(ids)]) > 0.95


def test_neighbours_small(spark):
    df = spark.createDataFrame([("a", [1.0] * 32), ("b", [2.0] * 32), ("c", [-1.0] * 32)], "id string, vec array<float>")
    assert {r["id"]: r["ids"] for r in knn.nearest(df, "id", "vec", 10).collect()} == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
    assert [tuple(r) for r in knn.nearest(df.limit(1), "id", "vec", 10).collect()] == [("a", [])]
    assert knn.nearest(df.limit(0), "id", "vec", 10).count() == 0
    assert rows(knn.neighbour_pairs(knn.nearest(df, "id", "vec", 1))) == [("a", "b"), ("a", "c")]


# 7. Splits by group.


def test_min_cost_flow():
    assert groupsplit.min_cost_flow(4, [(0, 1, 3, 0), (0, 2, 3, 1), (1, 3, 2, 0), (2, 3, 3, 0), (1, 2, 1, 0)], 0, 3, 4) == [3, 1, 2, 2, 1]


@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(1, 40), st.integers(1, 30)), min_size=1, max_size=12, unique_by=lambda b: b[:2]))
@settings(max_examples=60, deadline=None)
def test_allocation_is_whole_and_near(bundles):
    full = [(x, size, count, size * count) for x, size, count in bundles]
    got = groupsplit.allocate(full, (0.8, 0.1, 0.1))
    assert all(sum(g) == b[2] and min(g) >= 0 for g, b in zip(got, full))
    total = sum(b[3] for b in full)
    labels = len({b[0] for b in full})
    for s, share in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(g[s] * b[1] for g, b in zip(got, full)) - share * total) <= 3 * labels * max(b[1] for b in full) + 3


def test_components_and_split(spark):
    rng = random.Random(9)
    chain = [(f"c{k}", f"c{k + 1}") for k in range(20)]
    star = [("Hub", f" s{k} ") for k in range(40)]
    edges = [*chain, *star, *[(f"r{rng.randint(0, 90)}", f"R{rng.randint(0, 90)}") for _ in range(50)], ("", "c1"), (None, "c1"), (" ", "s1"), ("solo", "SOLO")]
    links = spark.createDataFrame(edges * 2, "user_id string, linked_id string").withColumn("l", F.lit(1))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = (a or "").strip().lower(), (b or "").strip().lower()
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent)}
    assert {r["node"]: r["comp"] for r in groupsplit.components(links, "user_id", "linked_id").collect()} == want
    records = [(u, rng.choice(["view", None, "click"])) for u in [f"c{k}" for k in range(0, 21, 2)] + [f"x{k}" for k in range(2000)] for _ in range(rng.randint(1, 4))] + [(None, "view"), (" ", "view")]
    df = spark.createDataFrame(records, "user_id string, event_type string").withColumn("split", F.lit(0)).withColumn("n", F.lit(0))
    users = groupsplit.group_split(df, "user_id", links, "user_id", "linked_id", "event_type")
    got = {r["user_id"]: r for r in users.collect()}
    assert set(got) == {u for u, _ in records if u and u.strip()}
    assert len({got[f"c{k}"]["split"] for k in range(0, 21, 2)}) == 1
    share = Counter()
    for r in got.values():
        share[r["split"]] += r["n"]
    assert abs(share["train"] / len(records) - 0.8) < 0.03 and abs(share["test"] / len(records) - 0.1) < 0.03
    assert groupsplit.linked_pairs(users, "user_id").count() == 11 * 10 // 2
    assert {r["user_id"]: r["split"] for r in groupsplit.group_split(df.repartition(7), "user_id", links, "user_id", "linked_id", "event_type").collect()} == {u: r["split"] for u, r in got.items()}
    placed = groupsplit.record_split(df.drop("split", "n"), "user_id", users)
    assert placed.count() == len(records) and placed.filter("split is null").count() == 0
    assert groupsplit.group_split(df.limit(0), "user_id", links.limit(0), "user_id", "linked_id", "event_type").count() == 0


def test_giant_component_is_spread(spark, monkeypatch):
    from veldt import session

    links = spark.createDataFrame([(f"n{k:04d}", f"n{k + 1:04d}") for k in range(0, 60)] + [("hub", f"x{k}") for k in range(300)] + [("a", "b")], "l string, r string")
    plain = {tuple(r) for r in groupsplit.components(links, "l", "r").collect()}
    monkeypatch.setattr(session, "HOT_ROWS", 20)
    assert {tuple(r) for r in groupsplit.components(links, "l", "r").collect()} == plain
    assert len({c for _, c in plain}) == 3


def test_split_keeps_quotas_of_labels_that_never_dominate(spark, monkeypatch):
    # All components have ten records, most of them views.
    mixes = [("cart", 4, 40), ("purchase", 3, 50), ("rating", 2, 60)]
    records = [(f"{x}{u}", y) for x, n, users in mixes for u in range(users) for y in ["view"] * (10 - n) + [x] * n] + [(f"v{u}", "view") for u in range(250) for _ in range(10)]
    df = spark.createDataFrame(records, "user_id string, event_type string")
    links = spark.createDataFrame([], "user_id string, linked_id string")
    for profiles in (groupsplit.PROFILES, 2):
        monkeypatch.setattr(groupsplit, "PROFILES", profiles)
        users = groupsplit.group_split(df, "user_id", links, "user_id", "linked_id", "event_type")
        got = Counter((r["split"], r["event_type"]) for r in groupsplit.record_split(df, "user_id", users).collect())
        assert sum(got.values()) == len(records)
        if profiles > 2:
            for x, n, k in mixes:
                assert [got[s, x] for s in groupsplit.SPLITS] == [n * k * 8 // 10, n * k // 10, n * k // 10]


def test_allocation_charges_every_label():
    bundles = [("a", 10, 1, 10), ("b", 10, 1, 10), ("c", 10, 8, 80)]
    got = groupsplit.allocate(bundles, (0.5, 0.5), [{"view": 6, "buy": 4}, {"view": 6, "buy": 4}, {"view": 80}])
    assert sorted(got[:2]) == [[0, 1], [1, 0]] and got[2] == [4, 4]


# 8. BPE.

ODD = ["", " ", "a", "Hello world's  end\n\n", "é" * 3000, "!" * 20_001, "ab" * 9000, "<|endoftext|>x", "日本語のテキスト。", "👩‍💻 ok", "\u0000​", "don't we'll I'M", "1234567 ½", "x" * 4097]


def reference_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.TOKENIZERS + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_corpus_ids(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(99, None), (None, "a")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("id", F.lit("x"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df, "doc_id", "text").collect()}
    assert got[99] == [] and got[0] == [] and len(got) == len(ODD) + 2
    assert [got[k] for k in range(len(ODD))] == reference_ids(ODD)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(bpe.TOKENIZERS + "/byte_bpe_50k.json")


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(vocabulary, text):
    base, merges = vocabulary
    q = bpe.RankQueue(max(m >> 20 for m in merges.values()))
    got = [i for w in regex.findall(bpe.PATTERN, text) for i in bpe.encode_bytes(w.encode("utf-8", "surrogatepass"), base, merges, q)]
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return
    assert got == reference_ids([text])[0] and not q.top and not q.at


def test_rank_queue_orders():
    q, rng = bpe.RankQueue(50_000), random.Random(2)
    ranks = [rng.randint(0, 50_000) for _ in range(500)]
    for k, r in enumerate(ranks):
        q.push(r, k)
    out = []
    while (got := q.pop())[0] >= 0:
        out += [(got[0], p) for p in got[1]]
    assert out == sorted((r, k) for k, r in enumerate(ranks))


# 9. Leaks.


def text_of(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_myers_matches_table():
    rng = random.Random(8)
    for m in (5, 27, 54, 64):
        p = ["".join(rng.choices("abc", k=m)) for _ in range(20)]
        t = [(x[: m // 2] + rng.choice("abcd") + x[m // 2 + rng.randint(0, 2) :] + "zzzz")[: m + 2].ljust(m + 2, "z") for x in p]
        got = leaks.myers(np.stack([leaks.codes(x) for x in p]), np.stack([leaks.codes(x) for x in t]))
        assert got.tolist() == [edit_distance(a, b) for a, b in zip(p, t)]


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    items = [(k, text_of(rng, 40)) for k in range(15)] + [(90, "short"), (91, None), (92, "")]
    docs = []
    for k in range(120):
        t = text_of(rng, 30)
        if k % 3 == 0:
            src = items[rng.randrange(15)][1]
            a = rng.randint(0, 60)
            piece = src[a : a + rng.randint(60, 140)].upper().replace(" ", rng.choice([" ", "\n", " - "]))
            t = t[:50] + " " + piece + " " + t[50:]
        docs.append((k, t))
    docs += [(200, None), (201, ""), (202, "?!"), (203, text_of(rng, 20_000) + items[0][1])]
    fold = lambda s: regex.sub(r"[^\p{L}\p{N}]+", "", unicodedata.normalize("NFKC", s or "").lower())
    runs = lambda t: {t[i : i + 80] for i in range(len(t) - 79)}
    grams, held = [(e, runs(fold(x))) for e, x in items], [(d, runs(fold(t))) for d, t in docs]
    want = {(d, e) for e, x in grams for d, t in held if x & t}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("run", F.lit("x")).repartition(3)
    i = spark.createDataFrame(items, "eval_id long, item_text string").withColumn("text", F.lit(1))
    for budget in (0, 1, 2):
        got = leaks.leaked_passages(d, "doc_id", "text", i, "eval_id", "item_text", 80, budget).collect()
        assert {(r["doc_id"], r["eval_id"]) for r in got if r["run"] >= 80} == want and want
        assert all(r["errors"] <= budget for r in got) and len({(r[0], r[1]) for r in got}) == len(got)
    assert leaks.leaked_passages(d.limit(0), "doc_id", "text", i, "eval_id", "item_text").count() == 0
    assert leaks.leaked_passages(d, "doc_id", "text", i.limit(0), "eval_id", "item_text").count() == 0


def test_leaks_with_errors_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    items = [(k, text_of(rng, 30)) for k in range(6)]
    flat = leaks.fold(items[2][1])[10:100]
    docs = [(1, "q" * 40 + flat[:33] + "Z" + flat[34:] + "q" * 40), (2, "q" * 40 + flat[:30] + flat[31:] + "q"), (3, "x" * 300)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "eval_id long, item_text string")
    want = {(1, 2), (2, 2)}
    for size in (10**9, 200):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", size)
        got = leaks.leaked_passages(d, "doc_id", "text", i, "eval_id", "item_text", 80, 1).collect()
        assert {(r["doc_id"], r["eval_id"]) for r in got} == want and all(r["errors"] == 1 and r["run"] == 0 for r in got)


# 10. Languages.

WORDS = {
    "en": "the house and this river is not with your friends today because they were walking", "de": "das haus und dieser fluss ist nicht mit deinen freunden heute weil sie gingen",
    "es": "la casa y este río no está con tus amigos hoy porque ellos caminaban", "fr": "la maison et cette rivière n'est pas avec tes amis aujourd'hui parce qu'ils marchaient",
    "it": "la casa e questo fiume non è con i tuoi amici oggi perché camminavano", "pt": "a casa e este rio não está com seus amigos hoje porque eles caminhavam",
    "ru": "дом и эта река сегодня не с твоими друзьями потому что они гуляли", "ja": "この家 と 川 は 今日 友達 と 一緒 では ない なぜなら 彼ら は 歩いて いた",
}


def sentence(rng, lang):
    words = rng.choices(WORDS[lang].split(), k=rng.randint(9, 14))
    return "".join(words) + "。" if lang == "ja" else " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def network():
    rng = random.Random(1)
    return langid.fit([(" ".join(sentence(rng, x) for _ in range(5)), x) for x in langid.LANGS for _ in range(50)])


def test_languages_held_out(network):
    rng = random.Random(77)
    texts, want = [], []
    for _ in range(120):
        seq = [rng.choice(langid.LANGS)]
        while rng.random() < 0.5:
            seq.append(rng.choice([x for x in langid.LANGS if x != seq[-1]]))
        texts.append(" ".join(sentence(rng, x) for x in seq for _ in range(2)))
        want.append(seq)
    got = defaultdict(list)
    for r in langid.detect(network, list(range(120)), texts).itertuples():
        assert 0 <= r.confidence <= 1 and r.seg_no == len(got[r.id]) + 1
        got[r.id].append(r.lang)
    assert sum(got[k] == want[k] for k in range(120)) / 120 > 0.95


def test_language_rows(spark, network):
    rng = random.Random(2)
    texts = {1: "", 2: None, 3: "  \n", 4: "123 !? ---", 5: sentence(rng, "fr"), 6: sentence(rng, "en") + " " + sentence(rng, "ru"), 7: sentence(rng, "de") * 4000, 8: sentence(rng, "it")}
    labels = {5: "fr-CA", 6: "en", 7: "german", 8: "xx"}
    df = spark.createDataFrame([(k, t, labels.get(k)) for k, t in texts.items()] + [(8, texts[8], "Italian")], "doc_id long, text string, lang string").withColumn("label_lang", F.lit(1))
    found = langid.language_segments(df, "doc_id", "text", "lang", network)
    assert {r["doc_id"] for r in found.collect()} == {5, 6, 7, 8}
    assert rows(langid.relabelled(found, "doc_id")) == [(6, 1, "en"), (6, 2, "ru"), (8, 1, "it")]
    assert langid.language_segments(df.limit(0), "doc_id", "text", "lang", network).count() == 0
    assert langid.language_segments(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_labels(spark):
    names = {"EN": "en", "en_GB": "en", " es-419": "es", "español": "es", "日本語": "ja", "und": None, "": None, None: None, "zh": None, "Deutsch": "de", "n/a": None}
    df = spark.createDataFrame([(k,) for k in names], "l string")
    assert [r[0] for r in df.select(langid.label_language(F.col("l"))).collect()] == list(names.values())


def test_path_keeps_runs():
    logp = np.log(np.full((5, 3), 0.05))
    for k, lang in enumerate([0, 0, 1, 1, 0]):
        logp[k, lang] = math.log(0.9)
    assert [s[:3] for s in langid.segments(logp, 1.0)] == [(0, 2, 0), (2, 2, 1), (4, 1, 0)]
    assert [s[:3] for s in langid.segments(logp, 9.0)] == [(0, 5, 0)]
