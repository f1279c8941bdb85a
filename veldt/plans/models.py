"""Queries of models, their files, serving, evaluation and search, with the SQL that each is checked against."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.features import Transform, check_buckets
from veldt.operators import affinity, ann, linear, metrics, quality, splits, tuning
from veldt.operators.recommenders import Registry, SequenceRecommender, TwoTowerRecommender
from veldt.plans.queries import BALANCE, LAMBDA, ORACLES, E, T, U, X, _rounded, _vectors, customer_features, events, orders, query, supplier_features
from veldt.session import cut, table
from veldt.sources import binary, io, persist


def _folder(spark, name: str) -> str:
    """A place in the shared folder for what a query writes and reads back; it goes with the other cut tables."""
    return cut(spark.createDataFrame([(name,)], "name string"))._veldt_path + f"/{name}"


def solved(p: str, lam: float, x: str = "x", uf: str | None = None, tf: str | None = None, beta: float = 1.0) -> str:
    """CTEs ending in {p}w (r, c, w): the weights of the linear model on x (u, i, v), user and item features, by Gauss-Jordan steps."""
    z = f"SELECT u, 'i:' || i AS c, v FROM {x}" + (f" UNION ALL SELECT user_id, 'f:' || feature_name, {beta} * sum(value) FROM {uf} GROUP BY 1, 2" if uf else "")
    t = f" UNION ALL SELECT 'i:' || a.item_id, 'i:' || b.item_id, sum(a.value * b.value) FROM {tf} a JOIN {tf} b USING (feature_name) GROUP BY 1, 2" if tf else ""
    return f"""
{p}z AS MATERIALIZED ({z}),
{p}g AS MATERIALIZED (SELECT l, r, sum(g) AS g FROM (SELECT a.c AS l, b.c AS r, sum(a.v * b.v) AS g FROM {p}z a JOIN {p}z b USING (u) GROUP BY 1, 2{t}) GROUP BY 1, 2),
{p}keys AS MATERIALIZED (SELECT l AS c, row_number() OVER (ORDER BY l) AS k FROM (SELECT DISTINCT l FROM {p}g)),
{p}rows AS (SELECT p.k AS r, list(coalesce(g.g, 0) + CASE WHEN p.k = q.k THEN {lam} ELSE 0.0 END ORDER BY q.k) AS rw
  FROM {p}keys p CROSS JOIN {p}keys q LEFT JOIN {p}g g ON g.l = p.c AND g.r = q.c GROUP BY p.k),
{p}gj(k, n, a) AS (
  SELECT 1, (SELECT count(*) FROM {p}keys), list(list_concat(rw, list_transform(range(1, (SELECT count(*) FROM {p}keys) + 1),
    lambda c: CASE WHEN c = r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY r) FROM {p}rows
  UNION ALL
  SELECT k + 1, n, list_transform(a, lambda rw, r: CASE WHEN r = k THEN list_transform(rw, lambda z: z / a[k][k])
    ELSE list_transform(rw, lambda z, c: z - rw[k] / a[k][k] * a[k][c]) END) FROM {p}gj WHERE k <= n),
{p}pr AS MATERIALIZED (SELECT n, unnest(range(1, n + 1)) AS r, unnest(list_transform(a, lambda rw: rw[n + 1:])) AS rw FROM {p}gj WHERE k = n + 1),
{p}p AS MATERIALIZED (SELECT r, unnest(range(1, n + 1)) AS c, unnest(rw) AS v FROM {p}pr),
{p}w AS MATERIALIZED (SELECT substr(a.c, 3) AS r, b.c AS c, -p.v / d.v AS w FROM {p}p p JOIN {p}p d ON d.r = p.c AND d.c = p.c
  JOIN {p}keys a ON a.k = p.r JOIN {p}keys b ON b.k = p.c WHERE p.r <> p.c AND a.c LIKE 'i:%')"""


def ranked_by(scores: str, k: int, by: str = "user_id", digits: int = 6) -> str:
    """The k best of each group of (by, item_id, score)."""
    return f"""SELECT {by}, CAST(r AS INTEGER) AS rank, item_id, score FROM (SELECT {by}, item_id, round(score, {digits}) AS score,
  row_number() OVER (PARTITION BY {by} ORDER BY round(score, {digits}) DESC, item_id) AS r FROM {scores}) WHERE r <= {k}"""


def measured(ranked: str, rel: str, ks: str, clamp: bool = False) -> str:
    """CTEs ending in per_user: the metrics of ranked (user_id, item_id, rank) against rel (user_id, item_id)."""
    best = "least(n_rel, k, coalesce(length, 0))" if clamp else "least(n_rel, k)"
    return f"""
nrel AS (SELECT user_id, count(*) AS n_rel FROM {rel} GROUP BY 1),
lengths AS (SELECT user_id, count(*) AS length FROM {ranked} GROUP BY 1),
ks AS (SELECT unnest([{ks}]) AS k),
hits AS (SELECT r.user_id, r.rank, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS h FROM {ranked} r JOIN {rel} USING (user_id, item_id)),
m AS (SELECT n.user_id, k, n_rel, any_value(length) AS length, count(h.rank) AS c, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg, coalesce(sum(h.h / h.rank::DOUBLE), 0) AS ap
  FROM nrel n CROSS JOIN ks LEFT JOIN lengths l ON l.user_id = n.user_id LEFT JOIN hits h ON h.user_id = n.user_id AND h.rank <= k GROUP BY 1, 2, 3),
ideal AS (SELECT g AS n, sum(1 / log2(g + 1)) OVER (ORDER BY g) AS idcg FROM (SELECT unnest(range(1, 101)) AS g)),
per_user AS (SELECT user_id, k, c / k::DOUBLE AS p, c / n_rel::DOUBLE AS r, coalesce(dcg / idcg, 0) AS ndcg, ap / n_rel AS map, CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END AS hr
  FROM m LEFT JOIN ideal ON n = {best})"""


MEANS = "SELECT k, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map, round(avg(hr), 6) AS hit_rate FROM per_user GROUP BY k"
_EVERYONE = "(SELECT DISTINCT u AS user_id FROM x) CROSS JOIN (SELECT DISTINCT i AS item_id FROM x)"
#: Scores of all unseen items of every user of x by the weights {p}w.
_UNSEEN = """sc AS (SELECT e.user_id, e.item_id, coalesce(sum(x.v * w.w), 0) AS score FROM (SELECT user_id, item_id FROM %s) e JOIN x ON x.u = e.user_id
  LEFT JOIN w ON w.c = 'i:' || x.i AND w.r = e.item_id GROUP BY 1, 2), unseen AS (SELECT sc.* FROM sc ANTI JOIN x ON x.u = sc.user_id AND x.i = sc.item_id)""" % _EVERYONE


def _six(report: DataFrame) -> DataFrame:
    return report.select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "map", "hit_rate")])


# Files.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(spark, d):
    """Nations through a CSV file, its types inferred from the text."""
    path = _folder(spark, "nation.csv")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.option("header", True).csv(path)
    return io.read(spark, path).select(*[F.col(c).cast(k) for c, k in n.dtypes])


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def parquet_sink(spark, d):
    """Customers written by segment and as a single file, each read back; both must hold all rows."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    many, one = _folder(spark, "many.parquet"), _folder(spark, "one.parquet")
    io.write(c, many, partition_by=["c_mktsegment"])
    io.write(c, one, single_file=True)
    return io.read(spark, many).select(*c.columns).intersectAll(io.read(spark, one))


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def catalogue_scan(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("veldt_supplier")
    return io.read_table(spark, "veldt_supplier").select("s_suppkey", "s_nationkey")


@query("""SELECT CAST(user_id AS VARCHAR) AS anonymous_id, json_extract_string(props, '$.k') AS view_media_id, value AS view_seconds_watched, event_type AS view_context_device_type,
  NULL::VARCHAR AS view_subscription_plan, NULL::VARCHAR AS view_country_code_view, NULL::VARCHAR AS account_country_code_account,
  TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id % 400 AS VARCHAR) END AS INTEGER) AS account_tenure_days,
  NULL::VARCHAR AS region_major_account, NULL::VARCHAR AS subscription_status FROM events""")
def engagement_validated(spark, d):
    """The wide engagement schema over events: values that cannot be cast become null, further columns go."""
    e = table(spark, d, "events")
    wide = e.select("*", F.col("user_id").alias("anonymous_id"), F.get_json_object("props", "$.k").alias("view_media_id"), F.col("value").cast("string").alias("view_seconds_watched"), F.col("event_type").alias("view_context_device_type"))
    wide = wide.withColumn("account_tenure_days", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.col("event_id") % 400).cast("string")))
    for c in ("view_subscription_plan", "view_country_code_view", "account_country_code_account", "region_major_account", "subscription_status"):
        wide = wide.withColumn(c, F.lit(None))
    return io.validate(wide, io.ENGAGEMENT)


@query(f"""WITH RECURSIVE {X}, {U}, {solved('', LAMBDA, uf='uf', beta=0.5)}
SELECT r AS item, c AS source, round(CASE WHEN c LIKE 'f:%' THEN 0.5 ELSE 1 END * w, 6) AS w FROM w""")
def payload_rows(spark, d):
    """The exported weights, row by row, beta folded into the columns of features; read from a saved and loaded model."""
    path = _folder(spark, "model")
    persist.save(linear.train(orders(spark, d), customer_features(spark, d), lam=LAMBDA, beta=0.5), path)
    model = persist.load(spark, path)
    n = len(model.items) + len(model.features)

    def cells(batches):
        for b in batches:
            for item, s in zip(b["item"].to_pylist(), b["s"].to_pylist()):
                w, c = np.round(np.frombuffer(s, "<f8"), 6), np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n - 1, item, np.int32)), pa.array(np.delete(c, item)), pa.array(np.delete(w, item))], ["r", "c", "w"])

    long = persist.payload_rows(model).mapInArrow(cells, "r int, c int, w double")
    items = linear.places(spark, model.items, "item").withColumnRenamed("k", "r")
    sources = linear.places(spark, [f"i:{x}" for x in model.items] + [f"f:{x}" for x in model.features], "source").withColumnRenamed("k", "c")
    return long.join(F.broadcast(items), "r").join(F.broadcast(sources), "c").select("item", "source", "w")


@query(f"WITH RECURSIVE {X}, {solved('', LAMBDA)} SELECT r, c, round(w, 6) AS w FROM w")
def cli_trained(spark, d):
    """The weights that the command line trains from a file and saves."""
    from veldt.__main__ import main

    path, file = _folder(spark, "model"), _folder(spark, "orders.parquet")
    orders(spark, d).write.parquet(file)
    main(["--interactions", file, "--output", path, "--lambda", str(LAMBDA)])
    return persist.load(spark, path).weights.select("r", "c", F.round("w", 6).alias("w"))


@query("SELECT 'item' AS kind, i AS name, CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS i FROM lineitem)")
def exported_vocabulary(spark, d):
    """vocab.json: the items of the model in index order."""
    path = persist.vocabulary(linear.train(orders(spark, d), lam=LAMBDA), _folder(spark, "export"))
    text = F.from_json("value", "item_index_to_guid array<string>, feature_index_to_key array<string>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(text["item_index_to_guid"]).alias("idx", "name"))
    return rows.select(F.lit("item").alias("kind"), "name", "idx")


@query(f"WITH RECURSIVE {X}, {U}, {solved('', LAMBDA, uf='uf', beta=0.5)} SELECT r, c, round(w, 6) AS w FROM w")
def binary_round_trip(spark, d):
    """The weights of a model with features after a way through the framed binary file."""
    path = _folder(spark, "model.bin")
    binary.write_binary(linear.train(orders(spark, d), customer_features(spark, d), lam=LAMBDA, beta=0.5), path, lambda_=LAMBDA)
    return binary.read_binary(spark, path).weights.select("r", "c", F.round("w", 6).alias("w"))


# The linear model.


@query(f"WITH RECURSIVE {X}, {solved('', LAMBDA)} SELECT r, c, round(w, 6) AS w FROM w WHERE abs(w) >= 0.02")
def ease_pruned(spark, d):
    return linear.train(orders(spark, d), lam=LAMBDA, threshold=0.02).weights.select("r", "c", F.round("w", 6).alias("w"))


@query(f"""WITH RECURSIVE {X}, {solved('', LAMBDA)} SELECT true AS passed, CAST(0 AS BIGINT) AS bad, 0.0::DOUBLE AS diagonal, round(max(abs(w)), 6) AS largest, true AS whole FROM w""")
def model_self_check(spark, d):
    found = linear.train(orders(spark, d), lam=LAMBDA).validate()
    return spark.createDataFrame([(found["passed"], found["bad"], found["diagonal"], round(found["largest"], 6), found["whole"])], "passed boolean, bad bigint, diagonal double, largest double, whole boolean")


@query(f"WITH RECURSIVE {X}, {solved('', LAMBDA)}, {_UNSEEN} {ranked_by('unseen', 5)}")
def predictor_top(spark, d):
    """The five best of every user by a saved model, through the loading helper; ids that no model knows are skipped."""
    path = _folder(spark, "model")
    x = orders(spark, d)
    persist.save(linear.train(x, lam=LAMBDA), path)
    unknown = x.select("user_id", F.lit("no such item").alias("item_id"), "value").limit(100)
    return persist.load_and_predict(spark, path, x.unionByName(unknown), k=5, digits=6)


@query(f"""WITH RECURSIVE {X}, {U}, {T}, {solved('', LAMBDA, uf='uf', tf='tf')},
sc AS (SELECT user_id, w.r AS item_id, sum(value * w.w) AS score FROM uf JOIN w ON w.c = 'f:' || feature_name GROUP BY 1, 2) {ranked_by('sc', 10)}""")
def ease_raw(spark, d):
    """Customers by raw columns alone, which the model's stored transform turns into features."""
    path = _folder(spark, "model")
    model = linear.train(orders(spark, d), customer_features(spark, d), supplier_features(spark, d), lam=LAMBDA)
    model.transform = Transform().add_categorical("c_mktsegment", "segment_").add_numeric("c_acctbal", "balance", *BALANCE)
    persist.save(model, path)
    raw = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), "c_mktsegment", "c_acctbal")
    return persist.load(spark, path).recommend_raw(orders(spark, d).limit(0), raw, 10, digits=6)


@query(f"""WITH RECURSIVE {X}, {solved('', LAMBDA)},
sc AS (SELECT e.user_id, e.item_id, coalesce(sum(x.v * w.w), 0) AS score FROM (SELECT user_id, item_id FROM {_EVERYONE}) e JOIN x ON x.u = e.user_id LEFT JOIN w ON w.c = 'i:' || x.i AND w.r = e.item_id GROUP BY 1, 2),
rho AS (SELECT user_id, CASE WHEN CAST(user_id AS BIGINT) % 3 = 0 THEN 0.5 WHEN CAST(user_id AS BIGINT) % 3 = 1 THEN 2.0 ELSE 0.25 END AS rho FROM (SELECT DISTINCT user_id FROM sc)),
fin AS (SELECT sc.user_id, sc.item_id, score - CASE WHEN x.i IS NULL THEN 0 ELSE rho END - CASE WHEN CAST(sc.item_id AS BIGINT) % 4 = 0 THEN 1e9 ELSE 0 END AS score
  FROM sc JOIN rho USING (user_id) LEFT JOIN x ON x.u = sc.user_id AND x.i = sc.item_id)
SELECT user_id AS user_row, CAST(r AS INTEGER) AS rank, item_id AS item_guid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM fin) WHERE r <= 5""")
def served_top(spark, d):
    """Requests as maps: the penalty of items seen is the request's, the user's, or the default; a quarter is not eligible."""
    x = orders(spark, d)
    model = linear.train(x, lam=LAMBDA)
    uid = F.col("user_id").cast("bigint")
    req = x.groupBy("user_id", "item_id").agg(F.sum("value").alias("value")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "value"))).alias("interactions"))
    req = req.withColumn("user_row", F.col("user_id")).withColumn("features", F.create_map().cast("map<string,double>")).withColumn("rho", F.when(uid % 3 == 0, 0.5))
    learned = req.filter(uid % 3 < 2).select("user_id", F.lit(2.0).alias("rho"))
    mask = model.item_frame().select("item_id", F.when(F.col("item_id").cast("bigint") % 4 != 0, 1.0).otherwise(0.0).alias("mask"))
    top = persist.serve(model, req, 5, learned, default_rho=0.25, mask=mask)
    return top.withColumn("score", F.round("score", 4))


@query("SELECT * FROM (VALUES ('fp16', true), ('int8', true)) AS t(kind, agrees)")
def quantised_agreement(spark, d):
    """Whether an item's ten nearest stay the same, for nine in ten of them on average, after the weights are rounded."""
    model = linear.train(orders(spark, d), lam=LAMBDA)
    rows = [(kind, persist.rank_agreement(model, persist.quantised(model, kind)).agg(F.avg("agreement")).first()[0] >= 0.9) for kind in ("fp16", "int8")]
    return spark.createDataFrame(rows, "kind string, agrees boolean")


@query(f"""WITH RECURSIVE {X}, t AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, r_name AS territory FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
{solved('a_', 50.0)}, {solved('b_', LAMBDA)},
w AS (SELECT 'EUROPE' AS model, * FROM a_w UNION ALL SELECT 'global', * FROM b_w),
e AS (SELECT DISTINCT u AS user_id, territory, i.item_id FROM x JOIN t ON t.user_id = u CROSS JOIN (SELECT DISTINCT i AS item_id FROM x) i),
sc AS (SELECT e.user_id, territory, e.item_id, coalesce(sum(x.v * w.w), 0) AS score FROM e JOIN x ON x.u = e.user_id
  LEFT JOIN w ON w.c = 'i:' || x.i AND w.r = e.item_id AND w.model = CASE WHEN territory = 'EUROPE' THEN 'EUROPE' ELSE 'global' END GROUP BY 1, 2, 3),
unseen AS (SELECT sc.* FROM sc ANTI JOIN x ON x.u = sc.user_id AND x.i = sc.item_id)
SELECT user_id, territory, CAST(r AS INTEGER) AS rank, item_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM unseen) WHERE r <= 3""")
def registry_top(spark, d):
    """Requests routed by territory: one has its own model, all others share the fallback."""
    x = orders(spark, d)
    r = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    requests = r.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("r_name").alias("territory")).join(x.select("user_id"), "user_id", "left_semi")
    blocks, registry = linear.blocks(x), Registry("global")
    registry.register("EUROPE", linear.solve(blocks, lam=50.0))
    registry.register("global", linear.solve(blocks, lam=LAMBDA))
    return registry.recommend(requests, x, k=3).withColumn("score", F.round("score", 4))


# Evaluation, splits, gates.

_HELD = f"""x0 AS (SELECT CAST(o_custkey AS VARCHAR) AS u, CAST(l_suppkey AS VARCHAR) AS i, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY md5(concat_ws('|', '42', u, i)), i) AS rn, count(*) OVER (PARTITION BY u) AS n FROM x0),
held AS (SELECT *, n >= 2 AND rn <= least(greatest(round(n * 0.2), 1), n - 1) AS test FROM placed),
x AS MATERIALIZED (SELECT u, i, v FROM held WHERE NOT test)"""


@query(f"""WITH {E}, ranked AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, item_id) AS rank FROM ev WHERE days_ago > 25 GROUP BY 1, 2 QUALIFY rank <= 10),
rel AS (SELECT DISTINCT user_id, item_id FROM ev WHERE days_ago <= 25), {measured('ranked', 'rel', '3, 10', True)} {MEANS}""")
def metrics_clamped(spark, d):
    """Metrics with the ideal list shortened to what was recommended."""
    e = events(spark, d)
    ranked = linear.rank_top(e.filter("days_ago > 25").groupBy("user_id", "item_id").agg(F.sum("value").alias("score")), 10)
    return _six(metrics.mean_metrics(metrics.per_user_metrics(ranked, e.filter("days_ago <= 25"), [3, 10], True)))


@query(f"""WITH {_HELD}, c AS (SELECT count(*) FILTER (NOT test) AS a, count(*) FILTER (test) AS b, count(DISTINCT u) FILTER (NOT test) AS c, count(DISTINCT u) FILTER (test) AS d FROM held)
SELECT a AS train_interactions, b AS test_interactions, c AS train_users, d AS test_users FROM c""")
def split_written(spark, d):
    """A random split written to files, and the counts of what the files hold."""
    x = orders(spark, d).groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))
    r = splits.random_split(x, 0.2, row=["item_id"]).write(folder=_folder(spark, "split"))
    return spark.createDataFrame([(r.train_interactions, r.test_interactions, r.train_users, r.test_users)], "train_interactions bigint, test_interactions bigint, train_users bigint, test_users bigint")


@query("""WITH r AS (SELECT DISTINCT * FROM split_stats), l AS (SELECT max(run_no) AS last FROM r),
v AS (SELECT run_no, unnest(['train_interactions', 'test_interactions', 'train_users', 'test_users']) AS label, unnest([train_interactions, test_interactions, train_users, test_users])::DOUBLE AS v FROM r),
h AS (SELECT label, avg(v) AS m, stddev_samp(v) AS s FROM v, l WHERE run_no < last AND v IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT label, max(v) AS v FROM v, l WHERE run_no = last GROUP BY 1)
SELECT label, v AS value, round(m - 5 * s, 3) AS low, round(m + 5 * s, 3) AS high, round(CASE WHEN s > 0 THEN abs(v - m) / s ELSE 0 END, 4) AS z_score, v BETWEEN m - 5 * s AND m + 5 * s AS passed FROM h JOIN c USING (label) WHERE v IS NOT NULL""")
def counts_validated(spark, d):
    """The latest split's counts against those of the runs before."""
    names = ["train_interactions", "test_interactions", "train_users", "test_users"]
    rows = table(spark, d, "split_stats").distinct().orderBy("run_no").collect()  # a fixed table of reports, one row a run
    last = max(r["run_no"] for r in rows)
    history = {c: [float(r[c]) for r in rows if r["run_no"] < last and r[c] is not None] for c in names}
    current = {c: max((float(r[c]) for r in rows if r["run_no"] == last and r[c] is not None), default=None) for c in names}
    known = {c: h for c, h in history.items() if current[c] is not None}
    found = quality.validate_counts(known, current)["checks"]
    out = [(c["label"], c["value"], round(c["low"], 3), round(c["high"], 3), round(c["z_score"], 4), c["passed"]) for c in found]
    return spark.createDataFrame(out, "label string, value double, low double, high double, z_score double, passed boolean")


@query("SELECT count(DISTINCT user_id)::DOUBLE AS users, count(DISTINCT item_id)::DOUBLE AS items, count(*)::DOUBLE AS interactions FROM interactions")
def current_counts(spark, d):
    c = quality.current_counts(table(spark, d, "interactions"))
    return spark.createDataFrame([(c["users"], c["items"], c["interactions"])], "users double, items double, interactions double")


@query("""WITH i AS (SELECT DISTINCT item_id FROM interactions), v AS (SELECT DISTINCT item_guid FROM item_matrix WHERE item_guid IS NOT NULL)
SELECT round(avg(CASE WHEN item_guid IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM i LEFT JOIN v ON item_id = item_guid""")
def vocabulary_overlap(spark, d):
    words = table(spark, d, "item_matrix").select(F.col("item_guid").alias("item_id"))
    share = affinity.vocabulary_share(table(spark, d, "interactions"), words)
    return spark.createDataFrame([(round(share, 6),)], "share double")


@query("""SELECT * FROM (VALUES ('unsupported suffix', 'ValueError'), ('missing columns', 'ValueError'), ('negative rate', 'ValueError'), ('labels and boundaries', 'ValueError'),
  ('boundaries ascend', 'ValueError'), ('one path of two', 'ValueError'), ('no model and no fallback', 'KeyError'), ('other family', 'TypeError'), ('all-zero model', 'ValueError'), ('unknown axis', 'ValueError')) AS t(what, error)""")
def refusals(spark, d):
    """Calls that must be refused, with the kind of error that each raises."""
    x = orders(spark, d)
    zero = linear.LinearModel(spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0])], "r int, w array<double>"), ["a", "b"], [])
    registry = Registry()
    calls = {
        "unsupported suffix": lambda: io.read(spark, "x.json"), "missing columns": lambda: io.validate(x, {"nope": "string"}), "negative rate": lambda: linear.train(x, decay_rate=-1.0),
        "labels and boundaries": lambda: check_buckets([1.0], ["a"]), "boundaries ascend": lambda: check_buckets([1.0, 1.0], ["a", "b", "c"]),
        "one path of two": lambda: splits.Split(x, x).write(train="t"), "no model and no fallback": lambda: registry.predict("mars", "u"),
        "other family": lambda: (registry.register("t", zero), registry.predict_sequence("t", [])), "all-zero model": lambda: persist.payload(zero), "unknown axis": lambda: tuning.search(x, [{"nope": 1.0}]),
    }
    rows = []
    for what, call in calls.items():
        try:
            call()
        except Exception as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")


@query("""SELECT * FROM (VALUES ('precision', round(2 / 3.0::DOUBLE, 6)), ('recall', 0.5), ('ndcg', round((1 / log2(4) + 1 / log2(6)) / (1 / log2(2) + 1 / log2(3)), 6)),
  ('ndcg, shortened', round((1 / log2(2)) / (1 / log2(2) + 1 / log2(3)), 6)), ('map', round((1 + 2 / 3.0::DOUBLE + 3 / 5.0::DOUBLE) / 3, 6)), ('coverage', 0.6), ('hit rate', 1.0), ('neighbours', 0.75)) AS t(name, value)""")
def metric_functions(spark, d):
    """The plain functions on short lists."""
    rec = [1, 2, 3, 4, 5]
    got = {
        "precision": metrics.precision_at_k(rec, {1, 3, 5, 7}, 3), "recall": metrics.recall_at_k(rec, {1, 3, 5, 7}, 3), "ndcg": metrics.ndcg_at_k(rec, {3, 5}, 5),
        "ndcg, shortened": metrics.ndcg_at_k([1, 9], {1, 2, 3}, 5, True), "map": metrics.mean_average_precision(rec, {1, 3, 5}),
        "coverage": metrics.coverage([[0, 1, 2], [2, 3, 4], [4, 5]], 10), "hit rate": metrics.hit_rate_at_k([10, 20, 30], {20, 40}, 3), "neighbours": metrics.neighbour_recall([1, 2, 3, 9], [1, 2, 3, 4]),
    }
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in got.items()], "name string, value double")


# Retrieval and the neural families.


@query("SELECT * FROM (VALUES ('codes', true), ('hyperplanes', true)) AS t(kind, reached)")
def knn_recall(spark, d):
    """Whether the approximate searches find nine in ten of the exact neighbours, averaged over the queries."""
    exact = cut(ann.top_k(*_vectors(spark, d), 10, cosine=True))
    found = {"codes": ann.top_k(*_vectors(spark, d), 10, cosine=True, codes=True), "hyperplanes": ann.hyperplane_top_k(*_vectors(spark, d), 10, dim=64)}
    return spark.createDataFrame([(k, ann.mean_recall(f, exact) >= 0.9) for k, f in found.items()], "kind string, reached boolean")


@query("""WITH b AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.id AS item, b.id AS item_id, round(list_cosine_similarity(q.v, b.v), 9) AS score FROM b q, b WHERE q.id <> b.id)
SELECT item, CAST(r AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, item_id) AS r FROM s) WHERE r <= 3""")
def model_neighbours(spark, d):
    """Similar items by the vectors of a model, here a given set of vectors, for every item."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("i"), "embedding").toPandas().sort_values("i")
    model = TwoTowerRecommender(None, [], v["i"].tolist(), {}, np.array(v["embedding"].tolist(), float), [])
    return _rounded(model.neighbours(spark, 3))


def _sequence(spark, d) -> SequenceRecommender:
    return SequenceRecommender.train(events(spark, d), dim=16, length=10, layers=1, epochs=2)


def _towers(spark, d) -> TwoTowerRecommender:
    return TwoTowerRecommender.train(orders(spark, d), customer_features(spark, d), supplier_features(spark, d), dim=16, epochs=1)


_WHOLE = "least(10, m - count(DISTINCT i)) AS n, CAST(1 AS INTEGER) AS first, CAST(least(10, m - count(DISTINCT i)) AS INTEGER) AS last, true AS falling, CAST(0 AS BIGINT) AS old"


def _shape(top: DataFrame, seen: DataFrame) -> DataFrame:
    """What any ranking must be: how many items a user got, from which to which rank, by falling scores, none of them seen."""
    old = seen.select(F.col("user_id").alias("u"), F.col("item_id").alias("i")).distinct().withColumn("old", F.lit(1))
    rows = top.join(old, (F.col("user_id") == F.col("u")) & (F.col("item_id") == F.col("i")), "left")
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    rows = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"), order.alias("s"), F.count("old").alias("old"))
    falling = F.col("s") == F.reverse(F.array_sort("s"))
    return rows.select("user_id", "n", "first", "last", falling.alias("falling"), "old").filter("n > 0")


@query(f"WITH {E}, e AS (SELECT user_id, item_id AS i FROM ev WHERE user_id IS NOT NULL AND item_id IS NOT NULL), c AS (SELECT count(DISTINCT i) AS m FROM e) SELECT * FROM (SELECT user_id, {_WHOLE} FROM e, c GROUP BY user_id, m) WHERE n > 0")
def sequence_top(spark, d):
    """The shape of the rankings of a sequence model, trained and applied to all histories."""
    e = events(spark, d)
    return _shape(_sequence(spark, d).recommend(e, k=10), e)


@query(f"WITH {X}, c AS (SELECT count(DISTINCT i) AS m FROM x) SELECT * FROM (SELECT u AS user_id, {_WHOLE} FROM x, c GROUP BY u, m) WHERE n > 0")
def two_tower_top(spark, d):
    """The shape of the rankings of a two-tower model, trained with features and applied to all customers with orders."""
    x = orders(spark, d)
    return _shape(_towers(spark, d).recommend(x, customer_features(spark, d).join(x.select("user_id"), "user_id", "left_semi"), k=10), x)


@query(f"WITH {X} SELECT DISTINCT u AS user_id, true AS same FROM x")
def indexed_top(spark, d):
    """Whether a two-tower model gives each customer the same items through its exact index as by scoring all items."""
    x = orders(spark, d)
    model = _towers(spark, d).enable_index("exact")
    pick = lambda top: top.groupBy("user_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    a, b = pick(model.recommend(x, k=5)), pick(model.recommend(x, k=5, exact=True)).withColumnRenamed("items", "others")
    both = x.select("user_id").distinct().join(a, "user_id", "left").join(b, "user_id", "left")  # some have seen everything
    return both.select("user_id", F.col("items").eqNullSafe(F.col("others")).alias("same"))


@query(f"""WITH {_HELD}, {E}, s AS (SELECT DISTINCT user_id FROM ev WHERE days_ago <= 7 AND user_id IN (SELECT user_id FROM ev WHERE days_ago > 7) AND item_id IN (SELECT item_id FROM ev WHERE days_ago > 7))
SELECT 'sequence' AS family, 10 AS k, (SELECT count(*) FROM s) AS n_users, true AS valid UNION ALL
SELECT 'two_tower', 10, count(DISTINCT u), true FROM held WHERE test AND u IN (SELECT u FROM x) AND i IN (SELECT i FROM x)""")
def evaluate_neural(spark, d):
    """The evaluation harness over both neural families: users evaluated, and whether all metrics lie in range."""
    rows = []
    late = splits.temporal_split(events(spark, d), 7)
    x = orders(spark, d).groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))
    held = splits.random_split(x, 0.2, row=["item_id"])
    for family, s, model in (
        ("sequence", late, SequenceRecommender.train(late.train, dim=8, length=10, layers=1, epochs=1)),
        ("two_tower", held, TwoTowerRecommender.train(held.train, dim=8, epochs=1).enable_index("hyperplanes")),
    ):
        report, summary = metrics.evaluate(model, s.train, s.test, ks=(10,))
        r = report.first()
        rows.append((family, r["k"], summary.first()["n_users"], all(0 <= r[c] <= 1 for c in ("precision", "recall", "ndcg", "map", "hit_rate"))))
    return spark.createDataFrame(rows, "family string, k int, n_users bigint, valid boolean")


@query("SELECT * FROM (VALUES ('sequence, saved', true), ('two_tower, saved', true), ('two_tower, payload', true)) AS t(model, same)")
def neural_round_trip(spark, d):
    """Whether saved and loaded models, and a scorer built from the exported payload, predict the same."""
    seq, two = _sequence(spark, d), _towers(spark, d)
    a, b = _folder(spark, "sequence"), _folder(spark, "towers")
    seq.save(a)
    two.save(b)
    near = lambda p, q: [x for x, _ in p] == [x for x, _ in q] and np.allclose([s for _, s in p], [s for _, s in q])
    ask = two.users[0], {"segment_BUILDING": 1.0}
    rows = [
        ("sequence, saved", near(seq.predict(seq.items[:3]), SequenceRecommender.load(a).predict(seq.items[:3]))),
        ("two_tower, saved", near(two.predict(*ask), TwoTowerRecommender.load(b).predict(*ask))),
        ("two_tower, payload", near(two.predict(*ask), TwoTowerRecommender.of_payload(two.payload()).predict(*ask))),
    ]
    return spark.createDataFrame(rows, "model string, same boolean")


@query(f"""WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment, c_acctbal, CASE WHEN c_custkey IN (SELECT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) THEN 1 ELSE 0 END AS known FROM customer)
SELECT user_id, known = 1 AS known, CAST(CASE WHEN c_mktsegment IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_cat, round(coalesce(c_acctbal, 0), 2) AS number FROM u""")
def tower_requests(spark, d):
    """What a two-tower model makes of raw requests: the user's row or the cold-start row, category slots and numbers."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.concat(F.lit("segment_"), F.col("c_mktsegment")).alias("feature_name"), "c_acctbal")
    features = c.select("user_id", "feature_name", F.lit(1.0).alias("value")).dropna().unionByName(c.select("user_id", F.lit("balance").alias("feature_name"), F.coalesce("c_acctbal", F.lit(0.0)).alias("value")))
    model = TwoTowerRecommender.train(orders(spark, d), features, dim=8, epochs=1)
    unknown = features.unionByName(c.select("user_id", F.lit("no such feature").alias("feature_name"), F.lit(1.0).alias("value")))
    rows = model.request(orders(spark, d).limit(0), unknown)
    return rows.select("user_id", (F.col("idx") > 0).alias("known"), F.size("cat").alias("n_cat"), F.round(F.col("dense")[0]["value"], 2).alias("number"))


@query("SELECT * FROM (VALUES ('linear', 2, true), ('sequence', 2, true), ('two_tower', 2, true)) AS t(family, folds, valid)")
def search_families(spark, d):
    """Grid and random search in every family: fold scores of a trial, and whether they are numbers from 0 to 1."""
    e, rows = events(spark, d), []
    for family, trials in (
        ("linear", tuning.random_search(orders(spark, d), {"lam": [50.0, 500.0]}, 1, n_folds=2)),
        ("sequence", tuning.grid_search(e, {"dim": [8], "layers": [1], "epochs": [1]}, "sequence", n_folds=2, length=5)),
        ("two_tower", tuning.grid_search(e, {"dim": [8]}, "two_tower", n_folds=2, epochs=1)),
    ):
        scores = tuning.best(trials).fold_scores
        rows.append((family, len(scores), all(0 <= s <= 1 for s in scores)))
    return spark.createDataFrame(rows, "family string, folds int, valid boolean")


# SQL of queries that stand in queries.py, by the same Gauss-Jordan steps.

ORACLES["ease_topk_cold"] = ORACLES["ease_raw"]

ORACLES["evaluate_ease"] = f"""WITH RECURSIVE {_HELD}, {solved('', LAMBDA)}, {_UNSEEN},
ranked AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM unseen QUALIFY rank <= 10),
rel AS (SELECT DISTINCT u AS user_id, i AS item_id FROM held WHERE test AND u IN (SELECT u FROM x) AND i IN (SELECT i FROM x)), {measured('ranked', 'rel', '5, 10')} {MEANS}"""


def _tuned(lams: tuple[float, ...], folds: int = 2, k: int = 10) -> str:
    """Mean NDCG of each lambda over user folds; test users are scored by their features."""
    ctes = [X, U, "us AS (SELECT u, row_number() OVER (ORDER BY md5(concat_ws('|', '42', u)), u) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT u FROM x))"]
    ctes.append(f"fold AS MATERIALIZED (SELECT u, CASE WHEN pos < (n % {folds}) * (n // {folds} + 1) THEN pos // (n // {folds} + 1) ELSE n % {folds} + (pos - (n % {folds}) * (n // {folds} + 1)) // (n // {folds}) END AS f FROM us)")
    cells = []
    for f in range(folds):
        ctes.append(f"x{f} AS MATERIALIZED (SELECT x.u, x.i, x.v FROM x JOIN fold USING (u) WHERE f <> {f})")
        ctes.append(f"rel{f} AS (SELECT DISTINCT x.u AS user_id, x.i AS item_id FROM x JOIN fold USING (u) WHERE f = {f} AND x.i IN (SELECT i FROM x{f}))")
        for j, lam in enumerate(lams):
            p = f"t{f}{j}_"
            ctes.append(solved(p, lam, f"x{f}", "uf"))
            ctes.append(f"{p}sc AS (SELECT user_id, w.r AS item_id, sum(value * w.w) AS score FROM uf JOIN fold ON u = user_id AND f = {f} JOIN {p}w w ON w.c = 'f:' || feature_name GROUP BY 1, 2)")
            ctes.append(f"{p}top AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM {p}sc QUALIFY rank <= {k})")
            ctes.append(f"""{p}u AS (SELECT user_id, count(*) AS n, coalesce(sum(1 / log2(t.rank + 1)), 0) AS dcg, any_value(l.length) AS length FROM rel{f} r
  LEFT JOIN {p}top t USING (user_id, item_id) LEFT JOIN (SELECT user_id, count(*) AS length FROM {p}top GROUP BY 1) l USING (user_id) GROUP BY 1)""")
            cells.append(f"SELECT {lam}::DOUBLE AS lam, avg(dcg / list_sum(list_transform(range(1, least(n, {k}, length) + 1), lambda r: 1 / log2(r + 1)))) AS ndcg FROM {p}u")
    return f"WITH RECURSIVE {', '.join(ctes)}, m AS (SELECT lam, avg(ndcg) AS ndcg FROM ({' UNION ALL '.join(cells)}) GROUP BY 1) SELECT lam, round(ndcg, 6) AS ndcg, ndcg = max(ndcg) OVER () AS best FROM m"


ORACLES["ease_tuned"] = _tuned((50.0, 500.0))
